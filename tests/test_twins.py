"""Queries without SQL against slow Python over the whole tables; discovery, versions and passages on small trees."""

import collections
import hashlib
import math
import os
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F
from test_operators import slow_trim

from lodestone.functions.query import features
from lodestone.operators import chunking, evaluation, inspection, lexical, questions
from lodestone.plans import registry
from lodestone.sources import files
from lodestone.sources.scratch import Scratch
from lodestone.sources.versions import VersionedTable

QUERIES = registry.queries()
BLANK = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0"


def documents(spark, sf_dir):
    """(doc_id, source, path, text) in order."""
    ends = [".md", ".py", ".go", ".sh"]
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    return [(r.doc_id, r.source, f"{r.source}/{r.doc_id}{ends[r.doc_id % 4]}", r.text or "") for r in rows]


def slow_segments(text, tokens=256):
    most, out, rest = max(64, 4 * tokens), [], text
    if len(text) <= most:
        return [text]
    while rest:
        if len(rest) <= most:
            piece = rest
        else:
            ends = [i + 1 for i in range(most // 2 + 1, most) if rest[i] in "\n "]
            piece = rest[: ends[-1]] if ends else rest[:most]
        rest = rest[len(piece) :]
        out.append(piece.strip(BLANK))
    out = [p for p in out if p]
    return out or [text[:most]]


def test_embedding_segments(spark, sf_dir):
    got = {}
    for r in QUERIES["embedding_segments"](spark, sf_dir).orderBy("doc_id", "segment").collect():
        got.setdefault(r.doc_id, []).append(r.segment_text)
    assert got == {i: slow_segments(t) for i, _, _, t in documents(spark, sf_dir)}


def slow_chunks(path, text, size=120, overlap=12, most=32768):
    lines = text.splitlines()
    assert not re.search(chunking.MARKERS["python"], text, re.MULTILINE)
    out = []
    for begin in range(0, max(1, len(lines) - overlap) if lines else 0, size - overlap):
        end = min(len(lines), begin + size)
        content = "\n".join(lines[begin:end])
        if not content.strip(BLANK):
            continue
        pieces, now, used = [], "", 0
        for c in content:
            n = len(c.encode())
            if now and used + n > most:
                pieces, now, used = [*pieces, now], "", 0
            now, used = now + c, used + n
        for segment, piece in enumerate([*pieces, now]):
            digest = "sha256:" + hashlib.sha256(piece.encode()).hexdigest()
            key = "\0".join(["corpus", path, str(begin + 1), str(end), str(segment), digest])
            out.append((path, begin + 1, end, segment, digest, "chunk_" + hashlib.sha256(key.encode()).hexdigest()[:20], max(1, (len(piece) + 2) // 3)))
    return out


def test_v2_chunks(spark, sf_dir):
    got = sorted((r.path, r.line_start, r.line_end, r.segment, r.content_hash, r.chunk_id, r.token_estimate) for r in QUERIES["chunk_v2_ids"](spark, sf_dir).collect())
    assert got == sorted(c for _, _, p, t in documents(spark, sf_dir) for c in slow_chunks(p, t))


def slow_diverse(rows, budget, limit, top=64):
    """rows (chunk_id, path, content, cost) in order."""
    each, taken, used = max(64, budget // limit), [], 0
    for share in (1, 2):
        for chunk, path, content, tokens in rows[:top]:
            cost = min(tokens, each)
            if len(taken) >= limit or any(t[0] == chunk or t[2] == content for t in taken) or sum(t[1] == path for t in taken) >= share or taken and used + cost > budget:
                continue
            taken.append((chunk, path, content))
            used += cost
    return [t[0] for t in taken]


def by_source(rows):
    groups = {}
    for i, source, path, text in rows:
        groups.setdefault(source, []).append((i, path, text))
    return groups


def test_diverse_selection(spark, sf_dir):
    from lodestone.operators.selection import MOST_SELECTED

    got = {}
    for r in QUERIES["diverse_selection"](spark, sf_dir).orderBy("source", "place").collect():
        got.setdefault(r.source, []).append(r.chunk_id)
    want = {s: slow_diverse([(str(i), f"p{i // 60}", t, max(1, len(t) // 3)) for i, _, t in rows], 3000, MOST_SELECTED) for s, rows in by_source(documents(spark, sf_dir)).items()}
    assert got == want


def test_pack_trim_longest(spark, sf_dir):
    got = {}
    for r in QUERIES["pack_trim_longest"](spark, sf_dir).orderBy("source", "place").collect():
        got.setdefault(r.source, []).append((r.place, r.excerpt))
    want = {s: slow_trim([t for _, _, t in rows[:12]], 1500) for s, rows in by_source(documents(spark, sf_dir)).items()}
    assert got == {s: w for s, w in want.items() if w}


def test_markers_of_a_long_file_in_linear_time():
    import time

    def seconds(n):
        text = "\n".join(f"def f{i}():\n    pass" for i in range(n))
        began = time.time()
        found = chunking.matched_markers(text, "ruby")
        assert len(found) == n and found[1] == "f0" and found[2 * n - 1] == f"f{n - 1}"
        assert len(chunking.python_markers(text)) == n
        return time.time() - began

    seconds(1000)
    assert seconds(80_000) < 6 * max(0.2, seconds(20_000))


def test_passages_are_found_where_they_stand(spark):
    long = "one two three four five six seven"
    passages = {1: long, 2: "two three", 3: "word", 4: "", 5: None, 6: "a  b\nc d", 7: "é ü ö"}
    texts = {"a": f"x {long} y", "b": f"x{long}y", "c": "one two three four five six sevenths", "d": "one two  three four five six seven", "e": "two three", "f": "wording", "g": "a word", "h": "za  b\nc dz", "i": "a b c d", "j": None, "k": "xé ü öx", "l": f"{long} {long}"}
    got = evaluation.containing(spark.createDataFrame(list(texts.items()), "path string, content string"), spark.createDataFrame(list(passages.items()), "query_id int, query string"))
    want = {(1, "a"), (1, "b"), (1, "c"), (1, "l"), (2, "a"), (2, "b"), (2, "c"), (2, "e"), (2, "l"), (3, "g"), (6, "h"), (7, "k")}
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_passages_of_the_benchmark(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    q = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    asked, texts = q.collect(), d.collect()
    want = {(a.query_id, t.path) for a in asked for t in texts if t.content and a.query in t.content}
    assert {tuple(r) for r in evaluation.containing(d, q).collect()} == want and want


def _ranked_slowly(texts, asked, top=10, k1=1.2, b=0.75):
    split = lambda t: [w for w in re.split(r"[^a-zé0-9]+", (t or "").lower()) if w]
    merged, lengths = {}, {}
    for path, t in texts:
        merged.setdefault(path, collections.Counter()).update(split(t))
        lengths[path] = max(lengths.get(path, 0), len(split(t)))
    mean, n = statistics.fmean(len(split(t)) for _, t in texts if t is not None), len(texts)
    scores = collections.Counter()
    for q, t in asked:
        for w in set(split(t)):
            df = sum(w in c for c in merged.values())
            for path, c in merged.items():
                if c[w]:
                    scores[q, path] += math.log(1 + (n - df + 0.5) / (df + 0.5)) * c[w] * (k1 + 1) / (c[w] + k1 * (1 - b + b * lengths[path] / mean))
    out = set()
    for q in {q for q, _ in scores}:
        best = sorted(((-round(s, 6), p is None, p) for (x, p), s in scores.items() if x == q))[:top]
        out |= {(q, p, i + 1) for i, (_, _, p) in enumerate(best)}
    return out


@pytest.mark.parametrize("held, block", [(1 << 21, 1 << 10), (3, 2)])
def test_questions_are_ranked_as_one_by_one(spark, monkeypatch, held, block):
    """Many more equal copies than places, paths that repeat, nulls and questions that repeat, in blocks of any size; no row is made for a question and a text."""
    monkeypatch.setattr(questions, "COUNTS", held)
    monkeypatch.setattr(questions, "QUESTIONS", block)
    r = random.Random(5)
    texts = [(f"p{i}", " ".join(r.choice(["alpha", "beta", "Gamma", "délta", "x1"]) + r.choice(" ,\n-") for _ in range(r.randint(0, 9)))) for i in range(60)]
    texts += [(f"copy{i:02}", "Alpha beta") for i in range(40)] + [("p1", texts[1][1]), ("null", None), ("none", ""), ("blank", " . ")]
    asked = [(1, "alpha"), (2, "beta, BETA délta"), (3, "unknown"), (4, None), (5, ""), (1, "alpha x1"), (6, "x1 gamma alpha"), (7, "gamma")]
    found = inspection.bm25_of_queries(spark.createDataFrame(texts, "path string, content string"), spark.createDataFrame(asked, "query_id long, query string"))
    assert found.columns == ["query_id", "path", "score", "rank"]
    assert {(x.query_id, x.path, x.rank) for x in found.collect()} == _ranked_slowly(texts, asked)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_questions_over_nothing(spark):
    none, q = spark.createDataFrame([], "path string, content string"), spark.createDataFrame([(1, "a b")], "query_id int, query string")
    assert inspection.bm25_of_queries(none, q).collect() == [] and evaluation.containing(none, q).collect() == []
    d = spark.createDataFrame([("p", "a b")], "path string, content string")
    assert inspection.bm25_of_queries(d, q.limit(0)).collect() == [] and evaluation.containing(d, q.limit(0)).collect() == []


@pytest.mark.parametrize("rows, block", [(256, 1 << 14), (2, 3)])
def test_passages_are_found_in_one_reading(spark, monkeypatch, rows, block):
    """Against a look for each passage in each text: runs that share words, overlap, and stand at ends; bytes of letters that look like blanks. No run of a text becomes a row."""
    monkeypatch.setattr(questions, "ROWS", rows)
    monkeypatch.setattr(questions, "PASSAGES", block)
    r = random.Random(6)
    said = lambda n: "".join(r.choice(["a", "b", "à", "Å"]) + r.choice([" ", " ", "\n", "\x0b", "\u00a0", "\x85"]) for _ in range(n)).strip(" \n\x0b")
    texts = [(f"t{i}", said(r.randint(0, 60))) for i in range(80)]
    passages = [(i, t[(at := r.randint(0, 40)) : at + r.randint(5, 14)]) for i, (_, t) in enumerate(texts)]
    inner = [(i, p) for i, p in passages if len([w for w in re.split("[ \\t-\\r]+", p) if w]) >= 3]
    found = evaluation.containing(spark.createDataFrame(texts, "path string, content string"), spark.createDataFrame(inner, "query_id int, query string"))
    want = {(i, t) for i, p in inner for t, c in texts if p in c}
    assert sorted(tuple(x) for x in found.collect()) == sorted(want) and len(want) > 20
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_discovery_takes_the_first_listing_that_names_files(spark, tmp_path):
    root = tmp_path / "tree"
    for name in ("a.py", "src/b.go", "src/c.bin", "node_modules/d.js", "docs/e.md", "src/new.rs", "with space.py"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(f"text of {name}")
    lists = tmp_path / "lists"
    lists.mkdir()
    (lists / "empty").write_text("\n")
    (lists / "git").write_bytes(b"a.py\0src/b.go\0./docs/e.md\0src/gone.py\0node_modules/d.js\0a.py")
    (lists / "rg").write_text(f"{root}/a.py\nsrc/new.rs\n")
    paths = lambda *names: sorted((r.path, r.language, r.origin) for r in files.discovered(spark, str(root), [str(lists / n) for n in names]).collect())
    assert paths("none", "empty", "git", "rg") == [("a.py", "python", "git"), ("docs/e.md", "markdown", "git"), ("src/b.go", "go", "git")]
    assert paths("rg") == [("a.py", "python", "rg"), ("src/new.rs", "rust", "rg")]
    assert paths("none") == [(p, x, "walk") for p, x in (("a.py", "python"), ("docs/e.md", "markdown"), ("src/b.go", "go"), ("src/new.rs", "rust"), ("with space.py", "python"))]
    found = files.discovered(spark, str(root), [str(lists / "git")])
    assert {r.path: r.content for r in files.read_discovered(spark, str(root), found).collect()} == {p: f"text of {p}" for p in ("a.py", "docs/e.md", "src/b.go")}
    assert {r.absolute for r in found.collect()} == {f"{root}/{p}" for p in ("a.py", "docs/e.md", "src/b.go")}
    assert os.path.exists(f"{root}/src/c.bin")


def test_a_table_as_it_stood(spark):
    table = VersionedTable(spark, f"{Scratch(spark, 'test-versions').path}/t", "id long, v string", "id")
    frame = lambda rows: spark.createDataFrame(rows, "id long, v string")
    assert table.as_of(5).count() == 0
    table.put(frame([(1, "a"), (2, "b"), (3, None)]), 0)
    table.put(frame([(2, "c"), (4, "d")]), 1, frame([(1, ""), (4, "")]))
    table.put(frame([(1, "again")]), 3)
    rows = lambda v: {r.id: (r.v, r.version) for r in table.as_of(v).collect()}
    assert rows(0) == {1: ("a", 0), 2: ("b", 0), 3: (None, 0)}
    assert rows(1) == rows(2) == {2: ("c", 1), 3: (None, 0), 4: ("d", 1)}
    assert rows(9) == {1: ("again", 3), 2: ("c", 1), 3: (None, 0), 4: ("d", 1)}
    assert {(r.id, r.change) for r in table.changes(0, 2).collect()} == {(1, "removed"), (2, "changed"), (4, "added")}
    table.put(frame([(1, "again")]), 3)
    assert rows(3) == rows(9)


def test_a_stored_index_ranks_in_the_scorer(spark):
    chunks = spark.createDataFrame([(f"c{i}", f"src/f{i}.go", "", "go", f"cache key number {i}") for i in range(8)], "chunk_id string, path string, symbol string, language string, content string")
    f = features(spark, "cache key")
    plain = {r.chunk_id: r.score for r in lexical.search(chunks, "cache key", f).collect()}
    ranked = spark.createDataFrame([("c3", 4.0), ("c5", 1.0)], "chunk_id string, bm25 double")
    more = {r.chunk_id: r.score for r in lexical.search(chunks, "cache key", f, ranked=ranked).collect()}
    add = {"c3": 1 + 1 / 5, "c5": 1 / 2 + 1 / 2}
    assert max(more, key=more.get) == "c3" and all(math.isclose(more[c] - plain[c], add.get(c, 0.0), abs_tol=1e-6) for c in plain if c in ("c3", "c5", "c0"))
