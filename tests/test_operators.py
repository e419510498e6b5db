"""Operators that SQL doesn't cover, on small inputs worked out by hand."""

import hashlib
import json
import random
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import classes as C
from lodestone.functions import text as T
from lodestone.functions.query import features
from lodestone.operators import chunking, evaluation, governance, incremental, inspection, jobs, lexical, results, retrieval, selection, summaries, vectors
from lodestone.sources import files, records
from lodestone.streaming import heartbeats, spool


def one(spark, column, **values):
    row = ", ".join(f"'{v}' AS {k}" if isinstance(v, str) else f"{v} AS {k}" for k, v in values.items())
    return spark.sql(f"SELECT {row or '1 AS x'}").select(column.alias("r")).first()["r"]


def of_text(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize("text,lines", [("", []), ("a\n", ["a"]), ("a\n\n", ["a", ""]), ("a\r\nb\rc\x0bd\x1ee\u2028f\x85g", list("abcdefg")), ("\n", [""]), ("x", ["x"])])
def test_lines_follow_every_break(spark, text, lines):
    assert of_text(spark, text, T.lines) == lines == text.splitlines()


@pytest.mark.parametrize("text", ["One. Two! Three", "Why? Yes! No", "plain words only", "a! b. c"])
def test_first_sentence_goes_by_priority(spark, text):
    want = next((text.split(s, 1)[0] + s.strip() for s in (". ", "! ", "? ") if s in text), text)
    assert of_text(spark, text, T.first_sentence) == want


def test_truncation_and_tokens(spark):
    assert of_text(spark, "x" * 50, lambda c: T.truncate(c, 10)) == "x" * 7 + "..."
    assert of_text(spark, "abcdef   zz", lambda c: T.truncate(c, 10)) == "abcdef..."
    assert of_text(spark, "", T.tokens_v1) == 1 and of_text(spark, "x" * 9, T.tokens_v1) == 2 and of_text(spark, "x" * 9, T.tokens_v2) == 3
    assert T.word_budget(384) == 48 and T.word_budget(384, "llama.cpp") == 54 and T.word_budget(16, "vllm") == 12


def test_redaction(spark):
    assert of_text(spark, "go Bearer abc token=1", T.redact_line) == "go Bearer [REDACTED]"
    assert of_text(spark, "TOKEN=abc&x Api-Key=q bearer  t.k", T.redact_log) == "TOKEN=[REDACTED]&x Api-Key=[REDACTED] bearer  [REDACTED]"
    assert bytes(of_text(spark, "é" * 30, lambda c: T.truncate_bytes(c, 40))).endswith(b"\n[TRUNCATED]\n")
    hidden = of_text(spark, json.dumps({"a": [{"path": "p", "content": "c", "content_list": 1, "paths": ["x", "y"]}], "excerpt": 3}), governance.redact_json)
    assert json.loads(hidden) == {"a": [{"path": "[REDACTED]", "content": "[REDACTED]", "content_list": 1, "paths": ["[REDACTED]", "[REDACTED]"]}], "excerpt": 3}
    assert of_text(spark, "no json", governance.redact_json) is None


def doc(spark, text, kind="file"):
    return spark.createDataFrame([("i", kind, "public", "a/b.py", text)], "input_id string, input_type string, classification string, path string, content string")


def test_fixed_windows_cover_all_lines(spark):
    text = "\n".join(f"line {i}" for i in range(81))
    got = chunking.fixed_windows(doc(spark, text, "log")).orderBy("line_start").collect()
    assert [(r.line_start, r.line_end) for r in got] == [(1, 80), (81, 81)]
    assert "\n".join(r.content for r in got) == text
    assert len(chunking.fixed_windows(doc(spark, text)).collect()) == 3 and chunking.fixed_windows(doc(spark, "")).count() == 0


def reference_regions(n, marks, size, overlap):
    starts = sorted({1: "", **dict(marks)}.items())
    for k, (begin, symbol) in enumerate(starts):
        end, at = starts[k + 1][0] - 1 if k + 1 < len(starts) else n, begin
        while at <= end:
            stop = min(end, at + size - 1)
            yield at, stop, symbol
            if stop >= end:
                break
            at = max(at + 1, stop - overlap + 1)


@pytest.mark.parametrize("n,marks", [(121, []), (120, []), (300, [(5, "f"), (130, "g")]), (40, [(1, "a"), (2, "b")]), (133, [])])
def test_region_windows(spark, n, marks):
    rows = doc(spark, "\n".join(f"l{i}" for i in range(n))).withColumn("m", F.array(*(F.struct(F.lit(a).alias("line"), F.lit(b).alias("symbol")) for a, b in marks)) if marks else F.lit(None).cast("array<struct<line:int,symbol:string>>"))
    got = chunking.region_windows(rows, "m" if marks else None).select("line_start", "line_end", "symbol").collect()
    assert sorted(map(tuple, got)) == sorted(reference_regions(n, marks, 120, 12))


def test_blank_regions_are_left_out_and_bytes_split_whole_characters(spark):
    assert chunking.region_windows(doc(spark, "\n \n\t\n")).count() == 0
    parts = chunking.split_bytes(doc(spark, "é" * 25).select("path", "content"), 9).orderBy("segment").collect()
    assert "".join(p.content for p in parts) == "é" * 25 and all(len(p.content.encode()) <= 9 for p in parts)


@pytest.mark.parametrize(
    "language,text,want",
    [
        ("python", "x\ndef f(a):\n  y\nclass K:\n  z\nasync def h():", [(2, "f"), (4, "K"), (6, "h")]),
        ("python", "class A:\n def m(self): pass\ndef f(): pass", [(1, "A"), (2, "A.m"), (3, "f")]),
        ("python", "def f(:\n  def g(", [(1, "f")]),
        ("go", "func (s *S) Run(x int) {\ntype T struct", [(1, "Run"), (2, "T")]),
        ("go", "package p\n\n\nfunc F() {}", [(3, "F")]),
        ("javascript", "export const h = (a) => {\nfunction f() {}\nvar x=1", [(1, "h"), (2, "f"), (3, "x")]),
        ("typescript", "export default class A {\ninterface I {\nlet q = 2", [(1, "A"), (2, "I"), (3, "q")]),
        ("java", "synchronized void f() {\n}\n public static int g(int x) {", [(1, "f"), (3, "g")]),
        ("c", "static int\nmain(int n) {\n}", [(1, "main")]),
        ("cpp", "template <class T> T id(T x) {", [(1, "id")]),
        ("rust", "pub(crate) fn a() {}\nimpl B {", [(1, "a"), (2, "B")]),
        ("ruby", "module M\n  def go!\n", [(1, "M"), (2, "go!")]),
        ("shell", "function run () {\n}\nstop() {", [(1, "run"), (3, "stop")]),
        ("prose", "def f(): pass", []),
        ("go", None, []),
    ],
)
def test_markers(spark, language, text, want):
    got = spark.createDataFrame([(text, language)], "t string, l string").select(chunking.markers_of(F.col("t"), F.col("l")).alias("m")).first().m
    assert [(x.line, x.symbol) for x in got] == want


def test_source_regions_begin_at_declarations(spark):
    rows = spark.createDataFrame([("a.py", "python", "import os\ndef f():\n  pass\nclass K:\n  def m(self):\n    pass")], "path string, language string, content string")
    got = [(r.line_start, r.line_end, r.symbol) for r in chunking.source_regions(rows).orderBy("line_start").collect()]
    assert got == [(1, 1, ""), (2, 3, "f"), (4, 4, "K"), (5, 6, "K.m")]


@given(st.text(alphabet="aé€😀 ", max_size=60), st.integers(1, 12))
def test_byte_pieces(text, most):
    pieces = chunking.byte_pieces(text, most)
    assert "".join(pieces) == text and all(len(p.encode()) <= most or len(p) == 1 for p in pieces)
    assert all(len((a + b[0]).encode()) > most for a, b in zip(pieces, pieces[1:]))


def slow_segments(text, most):
    """By the definition, a character at a time."""
    if len(text) <= most:
        return [text]
    out, rest = [], text
    while rest:
        edges = [i for i in range(most // 2 + 1, min(most, len(rest))) if rest[i] in " \n"]
        stop = len(rest) if len(rest) <= most else edges[-1] + 1 if edges else most
        out, rest = out + [rest[:stop].strip()], rest[stop:]
    return [p for p in out if p] or [text[:most]]


def test_segments_by_definition(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab é😀 \n") if rng.random() < w else "x" for _ in range(rng.randint(0, 500))) for w in (0.02, 0.2, 1.0) for _ in range(30)] + [" " * 200, "", "y" * 64, "y" * 65]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    got = {}
    for r in chunking.segments_for_embedding(rows, tokens=16).orderBy("id", "segment").collect():
        got.setdefault(r.id, []).append(r.segment_text)
    assert got == {i: slow_segments(t, 64) for i, t in enumerate(texts)}


def test_segments_and_batches(spark):
    text = ("word " * 300).strip()
    got = [r.segment_text for r in chunking.segments_for_embedding(spark.createDataFrame([(1, text)], "id int, content string"), tokens=16).orderBy("segment").collect()]
    assert " ".join(got) == text and max(map(len, got)) <= 64
    rows = spark.createDataFrame([("g", i, t) for i, t in enumerate([1000, 1000, 100, 2000, 60])], "g string, i int, token_estimate int")
    assert [r.batch for r in chunking.pack_batches(rows, "g", ["i"]).orderBy("i").collect()] == [0, 0, 1, 2, 3]


def test_prefix_budget_stops_and_greedy_skips(spark):
    rows = spark.createDataFrame([("q", i, f"c{i}", f"h{i}", t) for i, t in enumerate([50, 60, 100, 20, 5], 1)], "q string, place int, chunk_id string, chunk_hash string, token_estimate int")
    assert [r.chunk_id for r in selection.prefix_budget(rows, "place", 120).orderBy("n").collect()] == ["c1", "c2"]
    assert [r.chunk_id for r in selection.greedy_budget(rows, ["place"], 120, ["q"]).orderBy("place").collect()] == ["c1", "c2", "c5"]
    first = selection.prefix_budget(rows, "place", 10).collect()
    assert [r.chunk_id for r in first] == ["c1"]


def test_diverse_selection(spark):
    rows = spark.createDataFrame([("q", i, f"c{i}", p, "", h, 100) for i, (p, h) in enumerate([("a", "1"), ("a", "2"), ("b", "3"), ("a", "4"), ("c", "3"), ("a", "5")], 1)], "q string, rank int, chunk_id string, path string, namespace string, content_hash string, token_estimate int")
    pick = lambda **k: [r.chunk_id for r in selection.diverse(rows, ["q"], 10000, **k).orderBy("place").collect()]
    assert pick() == ["c1", "c3", "c2"]
    assert pick(named=["a"]) == ["c1", "c2", "c3", "c4", "c6"]
    assert len(pick(limit=2)) == 2


def slow_trim(excerpts, budget, least=96):
    tokens = lambda: max(1, (len(json.dumps([{"place": p, "excerpt": e} for p, e in kept], separators=(",", ":"))) + 2) // 3)
    kept = list(enumerate(excerpts, 1))
    while kept and tokens() > budget:
        n, i = max((len(e), i) for i, (_, e) in enumerate(kept))
        if n <= least:
            kept.pop()
        else:
            kept[i] = (kept[i][0], kept[i][1][: n - max(32, min(n - least, 4 * (tokens() - budget) + 16))].rstrip() + "...")
    return kept


@pytest.mark.parametrize("budget", [1, 40, 150, 400, 5000])
def test_trim_longest_keeps_to_the_budget(spark, budget):
    rng = random.Random(6)
    groups = {f"q{k}": ["".join(rng.choice('x y\n\t"\\é😀\x7f') for _ in range(rng.choice([3, 97, 300, 900]))) for _ in range(rng.randint(1, 9))] for k in range(12)}
    rows = spark.createDataFrame([(q, i, e) for q, es in groups.items() for i, e in enumerate(es, 1)], "q string, place int, excerpt string")
    got = {}
    for r in selection.trim_longest(rows, ["q"], budget).orderBy("q", "place").collect():
        got.setdefault(r.q, []).append((r.place, r.excerpt))
    assert got == {q: kept for q, es in groups.items() if (kept := slow_trim(es, budget))}


def test_fusion_does_not_depend_on_the_order_of_rankings(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("x", 3)], "chunk_id string, rank int")
    b = spark.createDataFrame([("y", 1), ("z", 2)], "chunk_id string, rank int")
    f = lambda r: {x.chunk_id: x.rrf_score for x in selection.reciprocal_rank_fusion(r).collect()}
    assert f([("a", a), ("b", b)]) == f([("b", b), ("a", a)]) == {"y": round(1 / 62 + 1 / 61, 10), "x": round(1 / 61, 10), "z": round(1 / 62, 10)}


def test_query_features(spark):
    f = features(spark, 'find retryLogic in broker/pkg/store.go "cache key" settings')
    assert f.quoted == ["cache key"] and "broker/pkg/store.go" in f.paths and "retryLogic" in f.identifiers
    assert f.direct_terms == ["cache key", "cache", "key", "broker/pkg/store.go", "broker", "pkg", "store", "go", "retryLogic", "retry", "logic", "find", "in", "settings"]
    assert f.terms == [*f.direct_terms, "setting"] and "in" not in f.lexical
    assert f.intent("configuration") and not f.intent("tests")
    assert features(spark, "the the").match_expression == '"the"'
    assert features(spark, "Authorized queries passing traces").terms == ["Authorized", "queries", "passing", "traces", "authorization", "auth", "authz", "access", "authoriz", "querie", "query", "pass", "trace"]
    assert features(spark, "") == type(f)() and features(spark, "say 'a \"b' (x_y)").match_expression.startswith('"a"')
    from lodestone.plans import retrieval_queries as plans

    assert features(spark, plans.LEX_QUERY) == plans.LEX


def test_strategies_and_plan(spark):
    assert retrieval.plan("summarize_logs", {"log"}, ["nope"]) == (["ripgrep", "bm25"], ["nope"])
    assert retrieval.plan("rag_compress", {"document"}, ["embeddings", "bm25"]) == (["embeddings"], ["bm25"])
    assert retrieval.Query("a Bb bb").terms == ["bb", "bb"]
    chunks = chunking.fixed_windows(doc(spark, "def bb():\n  todo")).withColumn("doc_id", F.lit(1))
    score = retrieval.candidates_of(chunks, retrieval.Query("bb bb", "propose_patch"), "bm25", ["doc_id"]).first().score
    assert score == 4.0
    assert retrieval.candidates_of(chunks, retrieval.Query("bb", "propose_patch"), "git_diff_history", ["doc_id"]).first().reasons == ["change_risk_marker"]
    tags = spark.createDataFrame([("a/b.py", 1, "BB"), ("a/b.py", 99, "x")], "path string, line int, name string")
    assert retrieval.tagged(chunks, tags, ["bb"]).first().score == 3.0
    assert retrieval.fallback(chunks, retrieval.Query("x", "inspect_repo"), ["doc_id"]).first().score == 3.0


def test_lexical_search_prefers_named_code(spark):
    rows = spark.createDataFrame([("c1", "src/store.go", "Get", "go", "func Get cache key"), ("c2", "tests/store_test.go", "TestGet", "go", "cache key cache key"), ("c3", "docs/readme.md", "", "markdown", "cache")], "chunk_id string, path string, symbol string, language string, content string")
    f = features(spark, "where is the cache key read in store.go")
    got = lexical.search(rows, "where is the cache key read in store.go", f).orderBy("rank").collect()
    assert got[0].chunk_id == "c1" and len(got) == 3
    assert lexical.search(rows, "which shell wrapper", features(spark, "which shell wrapper")).count() == 3
    assert lexical.references_of(spark.createDataFrame([("bin/run.sh", "exec store.go now"), ("src/store.go", "x")], "path string, content string")).collect()[0].target == "src/store.go"


def test_vectors(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [3.0, 4.0])], "vec_id int, embedding array<float>")
    got = vectors.top_k(v, [1.0, 0.0], 3).collect()
    assert [(r.vec_id, round(r.score, 6)) for r in got] == [(0, 1.0), (2, 0.6), (1, 0.0)]
    with pytest.raises(Exception, match="dimensions"):
        vectors.top_k(v, [1.0], 1).collect()
    asked = spark.createDataFrame([("a",), ("b",)], "chunk_id string")
    results = spark.createDataFrame([("a",), ("a",), ("q",)], "chunk_id string")
    assert sorted(map(tuple, vectors.unknown_or_repeated(results, asked).collect())) == [("a", "repeated"), ("q", "unknown")]


def test_jobs(spark):
    assert one(spark, C.scheduler_state(F.lit(" CANCELLED by 12"))) == "cancelled"
    assert one(spark, C.clock(F.lit(3725))) == "01:02:05"
    hosts = spark.createDataFrame([("n[01-03,7]x,m1",)], "h string")
    assert sorted(r.host for r in jobs.expand_hosts(hosts, "h").collect()) == ["m1", "n01x", "n02x", "n03x", "n7x"]
    now = F.lit("2024-01-01 00:10:00").cast("timestamp")
    s = spark.sql("SELECT 's' service_id, 't' tier, 'ready' state, '' scheduler_state, timestamp'2024-01-01 00:00:00' startup_deadline, timestamp'2024-01-02' lease_expires_at, timestamp'2024-01-03' absolute_lease_expires_at, timestamp'2024-01-01 00:09:00' heartbeat_at, 'e' endpoint")
    assert s.select(jobs.retirement_reason(now, ["t"]).alias("r")).first().r == "heartbeat_lost"
    assert s.select(jobs.retirement_reason(now, ["u"]).alias("r")).first().r == "profile_removed"
    assert jobs.routable(s, now).count() == 0 and jobs.routable(s, now, 3600).count() == 1
    assert jobs.bind(spark.createDataFrame([("d", "t"), ("e", "z")], "demand_id string, tier string"), s).orderBy("demand_id").select("action").collect() == [("bind",), ("launch",)]


def test_release_and_audit(spark):
    e = spark.createDataFrame([("c", i, str(i), "a", "r", "x", "ok", None) for i in range(3)], "c string, turn int, at string, actor string, role string, action string, outcome string, job_id string")
    good = governance.chained(e, "c", "turn")
    assert governance.verify(good, "c", "turn").first().valid
    bad = good.withColumn("prev_hash", F.when(F.col("turn") == 2, F.lit("z")).otherwise(F.col("prev_hash")))
    assert tuple(governance.verify(bad, "c", "turn").first())[2:] == (False, 3, "prev_hash mismatch")
    first = governance.chained(spark.createDataFrame([("c", 0, "2026-01-02T03:04:05Z", "a|b", "", "<x>&", "ok", "", {"z": "1", "b": "é"})], "c string, turn int, at string, actor string, role string, action string, outcome string, job_id string, fields map<string,string>"), "c", "turn").first()
    assert first.event_hash == hashlib.sha256('{"timestamp":"2026-01-02T03:04:05Z","actor":"a|b","action":"\\u003cx\\u003e\\u0026","outcome":"ok","fields":{"b":"é","z":"1"}}'.encode()).hexdigest()
    twins = spark.createDataFrame([("p", 0, "t", "a|b", "c", "x", "ok", ""), ("q", 0, "t", "a", "b|c", "x", "ok", "")], "c string, turn int, at string, actor string, role string, action string, outcome string, job_id string")
    assert len({r.event_hash for r in governance.chained(twins, "c", "turn").collect()}) == 2
    r = spark.createDataFrame([("bad_task", "answer", 100, 5, ["_x"])], "task_type string, mode string, final_pack_budget int, runtime_s int, params array<string>")
    assert r.select(governance.request_errors().alias("e")).first().e == ["task_type", "final_pack_budget", "reserved_key"]


@pytest.mark.parametrize(
    "value,want",
    [
        ({"paths": "a/b", "path": {"x": "secret"}}, {"paths": ["[REDACTED]"], "path": "[REDACTED]"}),
        ({"a": [{"Path": 1, "content": ["c", {"content": "d"}]}]}, {"a": [{"Path": "[REDACTED]", "content": ["c", {"content": "[REDACTED]"}]}]}),
        ({"related_paths": [{"x": 1}, 2], "excerpt": 3, "raw_excerpt": "s"}, {"related_paths": ["[REDACTED]"] * 2, "excerpt": 3, "raw_excerpt": "[REDACTED]"}),
        ([[{"source_text": "s"}]], [[{"source_text": "[REDACTED]"}]]),
    ],
)
def test_hidden(value, want):
    assert governance.hidden(value) == want


def test_origins_of_long_chains_and_cycles(spark):
    links = [(i, i - 1 if i else None) for i in range(300)] + [(1000, 999), (2000, 2001), (2001, 2000)]
    got = {r.job_id: r.origin for r in jobs.origins(spark.createDataFrame(links, "job_id long, source_id long")).collect()}
    assert got == {i: 0 for i in range(300)} | {1000: 1000, 2000: None, 2001: None}


def test_evaluation_and_incremental(spark):
    q = spark.createDataFrame([("a", 1.0, 0.5), ("b", 0.5, 1.0)], "query_id string, recall_at_10 double, reciprocal_rank double")
    m = evaluation.passed(evaluation.metrics(q, spark.createDataFrame([(9, 0, 1)], "valid int, invalid int, missing int"))).first()
    assert (m.recall_at_10, m.mrr, m.citation_precision, m.passed) == (0.75, 0.75, 0.9, False)
    new, old = spark.createDataFrame([("p", "x"), ("q", "y")], "path string, content string"), spark.createDataFrame([("p", "x")], "path string, content string")
    assert [r.path for r in incremental.unchanged_writes(new, old, "path", "content").collect()] == ["q"]
    kept = spark.sql("SELECT map('b', 1, '_p', 2, 'client_nonce', 3, 'a', 4) m").select(incremental.stable_params(F.col("m")).alias("r")).first().r
    assert [(x.key, x.value) for x in kept] == [("a", 4), ("b", 1)]


def test_child_outcomes(spark):
    c = spark.createDataFrame([("p", x) for x in "abcd"], "parent string, child string")
    out = summaries.child_outcomes(c, spark.createDataFrame([("a", "{}"), ("b", None)], "child string, payload string"), spark.createDataFrame([("c", "FAILED"), ("b", "failed")], "child string, state string"))
    assert {r.child: r.outcome for r in out.collect()} == {"a": "ready", "b": "pending", "c": "failed", "d": "pending"}


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.py").write_bytes(b"ok \xff\n")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "y.py").write_text("no")
    got = files.texts(spark, str(tmp_path)).collect()
    assert [(r.path, r.content) for r in got] == [("a/x.py", "ok \ufffd\n")]
    assert one(spark, files.file_path_of(F.lit("file:///a%20b+c"))) == "/a b+c"
    with pytest.raises(Exception, match="unsupported"):
        one(spark, files.file_path_of(F.lit("http://x/y")))
    assert one(spark, files.normalized_uri(F.lit("repo://h/x//y/"))) == "file:///h/x/y"
    assert tuple(one(spark, files.grep_line(F.lit("p:7:a:b")))) == ("p", 7, "a:b")
    n = files.nodes(spark.createDataFrame([("gpu*|n1|a|gpu:v100|IDLE",), ("bad|row",)], "line string")).collect()
    assert [tuple(r) for r in n] == [("gpu", "n1", "a", "gpu:v100", "idle")]
    assert one(spark, files.first_json(F.lit('noise {"a": 1} tail'))) == '{"a": 1}'


def test_streams_equal_their_batch_twins(spark, sf_dir, tmp_path):
    from lodestone.plans.job_queries import beats

    rows = beats(spark, sf_dir)
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = heartbeats.read(spark, str(tmp_path / "in"), rows.schema, files=1, fmt="parquet")
    held = {}
    q = heartbeats.upsert_batches(heartbeats.newest(stream), lambda b, i: held.update({r.job_id: tuple(r) for r in b.collect()}), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert sorted(held.values()) == sorted(map(tuple, heartbeats.newest(rows).collect()))
    q = heartbeats.into_table(heartbeats.timeouts(stream).select("job_id", "beats", "expired"), str(tmp_path / "out"), str(tmp_path / "ck2"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).select("job_id").distinct().count() == rows.select("job_id").distinct().count()


def test_inspection_end_to_end(spark):
    """Named code first, one excerpt a file before seconds, budgets kept; vectors and scores change what comes first."""
    rows = [(f"c{i}", f"src/store{i}.go", f"Get{i}", "go", f"func Get{i}() reads the cache key {'cache ' * (i % 3)}\n" + "line\n" * 40, 1, 41) for i in range(8)]
    rows += [("r1", "docs/readme.md", "", "markdown", "cache key", 1, 1), ("c0b", "src/store0.go", "More", "go", "cache key again", 42, 42)]
    chunks = spark.createDataFrame(rows, "chunk_id string, path string, symbol string, language string, content string, line_start int, line_end int")
    got = inspection.inspect(chunks, "where is the cache key read in store5.go", inspection.Budgets(16000, 6000, 700)).orderBy("place").collect()
    assert got[0].path == "src/store5.go" and {r.quality for r in got} == {"evidence_only"} and [r.place for r in got] == list(range(1, len(got) + 1))
    assert len(json.dumps([{"place": r.place, "excerpt": r.excerpt} for r in got], separators=(",", ":"))) <= 3 * 700
    index = spark.createDataFrame([(f"c{i}", [float(i == 3), 1.0]) for i in range(8)], "chunk_id string, embedding array<double>")
    scores = spark.createDataFrame([(f"c{i}", float(i == 6)) for i in range(8)], "chunk_id string, score double")
    both = inspection.inspect(chunks, "cache key", index=index, query_vector=[1.0, 0.0], scores=scores).orderBy("place").collect()
    assert both[0].path == "src/store6.go" and both[0].quality == "answer_ready" and max(Counter(r.path for r in both).values()) <= 2
    before = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 2)], "chunk_id string, rrf_score double, rank int")
    after = inspection.by_cross_encoder(before, spark.createDataFrame([("b", 2.0), ("a", 1.0)], "chunk_id string, score double"))
    report = inspection.rerank_report(before, after, spark.createDataFrame([("b",)], "chunk_id string")).orderBy("candidate_rank").collect()
    assert [tuple(r) for r in report] == [("a", 1, 2, False), ("b", 2, 1, True)]
    assert inspection.inspect(chunks.limit(0), "cache key").count() == 0


def test_records_of_odd_shapes(spark):
    f = spark.createDataFrame([(1, "[]"), (2, "no json"), (3, '{"id":"x","v":1}'), (4, None), (5, '{"a":{"v":2}}')], "file int, text string")
    assert sorted((r.file, r.id) for r in records.result_records(f.where("file in (1, 3, 5)"), "file").collect()) == [(3, "x"), (5, "a")]
    assert records.job_store(f.where("file in (2, 4)")).count() == 0
    un = lambda t: of_text(spark, t, records.unwrapped)
    assert un('{"content":[{"text":"{\\"result\\":{\\"payload\\":{\\"a\\":1}}}"}]}') == '{"a":1}' and un('{"result":{"b":2}}') == '{"b":2}' and un('{"c":3}') == '{"c":3}'
    there = spark.createDataFrame([("a", "no json"), ("b", '{"k":1}')], "path string, text string")
    assert {r.path: r.text for r in records.optional(spark.createDataFrame([("a",), ("b",), ("c",)], "path string"), there).collect()} == {"a": "{}", "b": '{"k":1}', "c": "{}"}
    v = spark.createDataFrame([(i, 100) for i in range(100)], "id int, size int")
    got = records.upload_batches(v, "id", F.col("size"), 2, most=8, most_bytes=650).groupBy("part", "batch").agg(F.count(F.lit(1)).alias("n")).collect()
    assert max(r.n for r in got) == 6 and sum(r.n for r in got) == 100


def test_results_checks(spark):
    with pytest.raises(Exception, match="must be positive"):
        spark.sql("SELECT map('retrieval_token_budget', '0') m").select(*results.token_budgets(F.col("m"))).collect()
    m = spark.createDataFrame([('{"children_total":4,"children_succeeded":3,"children_failed":1,"coverage_fraction":0.75}',)], "p string").select(results.reducer_metrics(F.col("p")).alias("r")).first().r
    assert tuple(m) == (4, 3, 1, 0.75)
    none = results.patch_plan(spark.createDataFrame([], "n int, path string, claim string, confidence double, evidence_id string")).first()
    assert none.confidence == 0.3 and none.target_path is None and none.evidence_refs == []


def test_spool_claims_each_file_once(spark, tmp_path):
    folder, out, held = tmp_path / "in", f"file://{tmp_path}/out", f"file://{tmp_path}/held"
    folder.mkdir()

    def run():
        stream = spool.requests(spark, f"file://{folder}", "id int, query string")
        spool.consume(stream, lambda b: b.select("id", F.upper("query").alias("answer"), "spool_file"), out, held).awaitTermination()
        return sorted((r.id, r.answer, r.spool_file) for r in spark.read.parquet(out).collect())

    (folder / "a.json").write_text('{"id": 1, "query": "x"}\n')
    assert run() == [(1, "X", "a.json")]
    (folder / "b.json").write_text('{"id": 2, "query": "y"}\n')
    assert run() == run() == [(1, "X", "a.json"), (2, "Y", "b.json")]


def test_artifact_owner_meets_one_holder_of_each_owner(spark):
    held = [(1, "user1", 1, [("a", "p1"), ("b", "q1")]), (2, "user1", 2, [("a", "p2")]), (3, "user2", 3, [("a", "p3")]), (4, None, 0, [("a", "p4")]), (5, " ", 0, [("b", "q5")]), (6, "user1", 9, [])]
    jobs_ = spark.createDataFrame(held, "job_id long, owner string, created_at int, artifacts array<struct<artifact_id:string,path:string>>")
    asked = [(1, "a", "user1", "user"), (2, "a", "user3", "user"), (3, "a", "x", "admin"), (4, "b", "user2", "user"), (5, "b", "user1", "user"), (6, "c", "user1", "admin"), (7, None, "user1", "admin"), (8, "a", None, None)]
    found = jobs.artifact_owner(spark.createDataFrame(asked, "request_id int, artifact_id string, user string, role string"), jobs_)
    assert {r.request_id: (r.job_id, r.path) for r in found.collect()} == {1: (2, "p2"), 2: (4, "p4"), 3: (3, "p3"), 4: (5, "q5"), 5: (1, "q1"), 6: (None, None), 7: (None, None), 8: (4, "p4")}
    many = spark.range(2000).select("id", F.concat(F.lit("user"), F.col("id") % 2).alias("owner"), F.col("id").alias("created_at"), F.array(F.struct(F.lit("a").alias("artifact_id"), F.lit("p").alias("path"))).alias("artifacts")).withColumnRenamed("id", "job_id")
    few = spark.createDataFrame([(i, "a", "user1", "user") for i in range(50)], "request_id int, artifact_id string, user string, role string")
    out = jobs.artifact_owner(few, many)
    assert {r.job_id for r in out.collect()} == {1999}
    # Holders are grouped before they meet a join.
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    generates = [i for i, x in enumerate(plan) if "Generate" in x]
    assert generates and all(any("Aggregate" in x for x in plan[max(j for j in range(i) if "Join" in plan[j]) : i]) for i in generates)


def test_words_alone_beside_letters_beyond_ascii(spark):
    texts = ["fail", "éfail", "testé", "a_test", "test1", "ein fail.", "classé", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.s for r in df.select(retrieval.log_signal(F.col("t")).alias("s")).collect()]
    assert got == [2.0, 2.0, 2.0, 0.0, 0.0, 2.0, 0.0, 0.0]
    assert [r.t for r in df.where(F.col("t").rlike(retrieval.alone("class|def"))).collect()] == ["classé"]


def test_fingerprint_of_a_group_is_the_hash_of_its_rows_in_order(spark):
    rows = [("s", f"p{i:03}", i) for i in range(300)] + [("t", "b", 1), ("t", "a", None), ("t", "c", 3), (None, "x", 1), ("u", "x", None)]
    got = {r.g: (r.entries, r.fingerprint) for r in incremental.fingerprint(spark.createDataFrame(rows[::-1], "g string, p string, n int").repartition(3), ["g"], "p", ["p", "n"]).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    chain = lambda g: sha("".join(sha(f"{p}\x1f{n}") for h, p, n in sorted(rows, key=str) if h == g and n is not None))
    assert got == {"s": (300, chain("s")), "t": (3, chain("t")), None: (1, chain(None)), "u": (1, None)}
    assert incremental.fingerprint(spark.createDataFrame([], "g string, p string, n int"), ["g"], "p", ["p", "n"]).count() == 0
