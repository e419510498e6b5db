"""The jobs over growing input, twice, with odd rows, and from the command line."""

import hashlib
import json
import os
import subprocess
import sys

import pytest
from compare import rows as plain_rows

from jobs import index_documents, log_digest
from jobs.common import config_of
from jobs.registry import QUERIES, SQL
from lodestone.operators.lexical_index import LexicalIndex

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DOCS = "doc_id long, text string, lang string, source string, extra string, turn string"


def put(spark, folder, rows, name):
    """One file of documents with columns that clash with the job's."""
    spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS).coalesce(1).write.parquet(f"{folder}-tmp-{name}")
    part = next(f for f in os.listdir(f"{folder}-tmp-{name}") if f.endswith(".parquet"))
    os.makedirs(folder, exist_ok=True)
    os.rename(f"{folder}-tmp-{name}/{part}", f"{folder}/{name}.parquet")


def brute_chunks(docs, window):
    out = set()
    for i, (text, lang, source) in docs.items():
        lines = (text or "").split("\n")
        lines = lines[:-1] if lines[-1] == "" else lines
        for at in range(0, len(lines), window):
            content = "\n".join(lines[at : at + window])
            out.add((i, f"{source or 'unknown'}/{i}", lang, at + 1, min(at + window, len(lines)), hashlib.sha256(content.encode()).hexdigest()))
    return out


def got_chunks(df):
    return sorted((r.doc_id, r.path, r.lang, r.line_start, r.line_end, hashlib.sha256(r.content.encode()).hexdigest()) for r in df.collect())


def text(seed, n):
    return "\n".join(f"line {i} of text {seed} word{(seed * i) % 17}" for i in range(n))


def test_index_takes_only_what_is_new(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    os.makedirs(source)
    run = lambda: index_documents.run(spark, source, target, checkpoint, {"window_lines": 5, "files_per_turn": 1})
    assert run().count() == 0  # nothing came yet
    first = [(1, text(1, 12), "en", "a"), (2, text(2, 3), None, None), (3, None, "fr", "b"), (4, "", "", "b"), (None, text(9, 4), "en", "a"), (5, text(5, 5), "de", "01"), (5, text(5, 5), "de", "01")]
    put(spark, source, first, "one")
    docs = {r[0]: r[1:] for r in first if r[0] is not None}
    assert got_chunks(run()) == sorted(brute_chunks(docs, 5), key=lambda x: x[0:1] + x[3:4])
    before = {r.doc_id: r.turn for r in index_documents.known(spark, target).collect()}
    second = [(1, text(1, 12), "en", "a"), (2, text(20, 7), None, None), (5, "", "de", "01"), (6, text(6, 6), "en", "a")]
    put(spark, source, second, "two")
    docs |= {r[0]: r[1:] for r in second}
    want = sorted(brute_chunks(docs, 5), key=lambda x: x[0:1] + x[3:4])
    assert got_chunks(run()) == want
    after = {r.doc_id: r.turn for r in index_documents.known(spark, target).collect()}
    assert {i for i in after if after[i] != before.get(i)} == {2, 5, 6}  # 1 came again as it was
    again = run()  # nothing new
    assert got_chunks(again) == want and {r.doc_id: r.turn for r in index_documents.known(spark, target).collect()} == after
    assert all(r.n_words > 0 for r in again.collect())
    # The index that grew finds what one that is built at once finds.
    index = index_documents.index_at(spark, target, config_of("index_documents"))
    fresh = LexicalIndex(spark, f"{tmp_path}/fresh", index_documents.FIELDS, 16)
    from pyspark.sql import functions as F

    fresh.add(again.select(F.concat_ws("#", "doc_id", "line_start").alias("id"), F.col("doc_id").cast("string").alias("owner"), "path", "content"), 0)
    asked = spark.createDataFrame([(1, "text 20 word3"), (2, "line 6"), (3, "a 1")], "query_id int, query string")
    hits = lambda i: sorted(tuple(r) for r in i.search(asked, 5).collect())
    assert hits(index) == hits(fresh) and hits(index)


def test_a_turn_that_runs_again_changes_nothing(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    put(spark, source, [(i, text(i, 9), "en", "a") for i in range(6)], "one")
    config = {"window_lines": 4, "files_per_turn": 1}
    index_documents.run(spark, source, target, checkpoint, config)
    put(spark, source, [(i, text(i + 50, 9), "en", "a") for i in range(3)], "two")
    want = got_chunks(index_documents.run(spark, source, target, checkpoint, config))
    last = max(r.turn for r in index_documents.known(spark, target).collect())
    # As after a loss between the batch and its commit: the stream forgets the commit and runs the same batch again.
    for name in (str(last), f".{last}.crc"):
        os.remove(f"{checkpoint}/commits/{name}")
    assert got_chunks(index_documents.run(spark, source, target, checkpoint, config)) == want
    assert max(r.turn for r in index_documents.known(spark, target).collect()) == last


def test_digest_by_date(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    bad = "start\nfatal error: x.h\nundefined reference to y token=abc rest\n"
    rows = [(1, bad, None, "a"), (2, "all is well\nnothing", None, "a"), (3, None, None, None), (4, "", None, ""), (5, "FAILED one\nlast", None, "b"), (5, "FAILED one\nlast", None, "b"), (None, "FAILED", None, "b")]
    rows += [(100 + i, f"ok {i}", None, "a") for i in range(30)]
    put(spark, source, rows, "one")
    run = lambda day: {r.source: r for r in log_digest.run(spark, source, target, day).collect()}
    got = run("2026-02-01")
    assert got["a"].codes == ["MISSING_GENERATED_HEADER", "UNDEFINED_REFERENCE", "GENERIC_LOG_FAILURE"] and got["a"].severity == "high"
    assert (got["a"].logs, got["a"].known_failures, got["a"].first_high, got["a"].first_medium) == (32, 1, 1, 2) and len(got["a"].timeline) == 12
    assert got["a"].timeline[:2] == ["start", "undefined reference to y token=[REDACTED]"]
    assert (got["b"].logs, got["b"].severity, got["b"].codes) == (2, "medium", ["TEST_FAILURE"])
    assert got[None].severity == got[""].severity == "none" and got[None].logs == got[""].logs == 1 and got[None].codes == []
    assert run("2026-02-01") == got
    reports = spark.read.schema(log_digest.REPORTS).parquet(f"{target}/reports")
    assert reports.count() == 36 and "abc" not in reports.where("doc_id = 1").first().excerpt
    assert os.path.isdir(f"{target}/reports/run_date=2026-02-01/severity=high")
    # The date's rows are replaced, also those of a severity that is gone; another date's stay.
    run("2026-02-02")
    os.remove(f"{source}/one.parquet")
    put(spark, source, [(7, "fine\nnothing", None, "c")], "two")
    assert set(run("2026-02-01")) == {"c"}
    by_date = {str(r.run_date): r["count"] for r in spark.read.schema(log_digest.REPORTS).parquet(f"{target}/reports").groupBy("run_date").count().collect()}
    assert by_date == {"2026-02-01": 1, "2026-02-02": 36}
    with pytest.raises(ValueError):
        log_digest.run(spark, source, target, "yesterday")
    with pytest.raises(ValueError, match="unknown keys"):
        log_digest.run(spark, source, target, "2026-02-01", {"excerpts": 1})


def test_empty_table(spark, tmp_path):
    put(spark, str(tmp_path / "in"), [(1, "x", "en", "a")], "one")
    spark.read.parquet(str(tmp_path / "in")).limit(0).write.parquet(str(tmp_path / "none"))
    assert log_digest.run(spark, str(tmp_path / "none"), str(tmp_path / "o2"), "2026-02-01").count() == 0
    assert index_documents.run(spark, str(tmp_path / "none"), str(tmp_path / "o1"), str(tmp_path / "c1")).count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(name, spark, duck, sf_dir):
    before = dict(spark.conf.getAll)
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and plain_rows(got) == plain_rows(want)
    assert dict(spark.conf.getAll) == before


def test_command_lines(spark, tmp_path):
    put(spark, str(tmp_path / "in"), [(i, text(i, 9), "en", "a") for i in range(5)], "one")
    (tmp_path / "config.json").write_text(json.dumps({"window_lines": 3}))
    env = os.environ | {"SPARK_LOCAL_IP": "127.0.0.1"}
    calls = [["index_documents", "--source", f"{tmp_path}/in", "--target", f"{tmp_path}/t1", "--checkpoint", f"{tmp_path}/c1", "--config", f"{tmp_path}/config.json"], ["log_digest", "--source", f"{tmp_path}/in", "--target", f"{tmp_path}/t2", "--run-date", "2026-02-01"]]
    for name, *args in calls:
        done = subprocess.run([sys.executable, f"{ROOT}/jobs/{name}.py", *args], env=env, capture_output=True, text=True, timeout=300, cwd=str(tmp_path))
        assert done.returncode == 0, done.stderr[-2000:]
        assert "lodestone.jobs" in done.stderr and "read 5 rows" in done.stderr
    assert index_documents.current_chunks(spark, f"{tmp_path}/t1").count() == 15
    assert spark.read.parquet(f"{tmp_path}/t2/digest").count() == 1
