"""The vector index, the chunk store, fingerprints of trees, and the plan of strategies, against plain Python."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import retrieval
from lodestone.operators.chunk_store import ChunkStore
from lodestone.operators.chunking import fixed_windows
from lodestone.operators.incremental import tree_fingerprints
from lodestone.operators.vector_index import VectorIndex
from lodestone.sources.scratch import Scratch


def brute_nearest(vectors, questions, k):
    unit = lambda v: np.array(v) / np.linalg.norm(v) if np.linalg.norm(v) else np.zeros(len(v))
    out = []
    for q, x in questions:
        scores = sorted((-round(float(unit(x) @ unit(v)), 9), i) for i, v in vectors.items())[:k]
        out += [(q, i, round(-s, 6), n) for n, (s, i) in enumerate(scores, 1)]
    return sorted(out)


def frame(spark, vectors):
    return spark.createDataFrame([(i, v) for i, v in vectors.items()], "vec_id long, embedding array<double>")


def found(index, questions, k=5):
    ranked, bounds, read = index.searched(index.spark.createDataFrame(questions, "query_id long, embedding array<double>"), k)
    return sorted((r.query_id, r.id, round(r.score, 6), r.rank) for r in ranked.collect()), bounds, read


def test_vector_index_is_exact_and_skips_cells(spark):
    rng = np.random.default_rng(1)
    tops = rng.normal(size=(12, 8))
    vectors = {i: (tops[i % 12] + 0.05 * rng.normal(size=8)).tolist() for i in range(480)}
    vectors |= {500: [0.0] * 8, 501: vectors[3], 502: vectors[3]}
    asked = [(i, (tops[i] + 0.05 * rng.normal(size=8)).tolist()) for i in range(6)] + [(50, [0.0] * 8), (51, vectors[3])]
    index = VectorIndex(spark, f"{Scratch(spark, 'test-vectors').path}/i", 8)
    index.build(frame(spark, vectors), cells=24)
    got, bounds, read = found(index, asked)
    assert got == brute_nearest(vectors, asked, 5)
    assert read.where("query_id < 6").count() < 0.4 * bounds.where("query_id < 6").count()
    changed = {i: (-np.array(vectors[i])).tolist() for i in range(0, 480, 7)} | {900: asked[0][1]}
    gone = [1, 2, 3, 501, 77777]
    index.add(frame(spark, changed), 1, spark.createDataFrame([(g,) for g in gone], "id long"))
    now = {i: v for i, v in (vectors | changed).items() if i not in gone}
    assert found(index, asked)[0] == brute_nearest(now, asked, 5)
    index.add(frame(spark, changed), 1, spark.createDataFrame([(g,) for g in gone], "id long"))  # again
    assert found(index, asked)[0] == brute_nearest(now, asked, 5) and index.live().count() == len(now)
    index.add(frame(spark, {1: vectors[1]}), 2)
    assert found(index, asked)[0] == brute_nearest(now | {1: vectors[1]}, asked, 5)


def test_odd_vectors(spark):
    index = VectorIndex(spark, f"{Scratch(spark, 'test-vectors').path}/i", 3)
    rows = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, None), (3, [1.0]), (4, [1.0, None, 0.0]), (5, [float("nan")] * 3)], "vec_id long, embedding array<double>")
    index.build(rows)
    assert found(index, [(1, [1.0, 1.0, 0.0])])[0] == [(1, 1, 0.707107, 1)]
    with pytest.raises(Exception, match="another length"):
        found(index, [(1, [1.0])])
    none = VectorIndex(spark, f"{Scratch(spark, 'test-vectors').path}/j", 3)
    none.build(rows.limit(0))
    assert found(none, [(1, [1.0, 1.0, 0.0])])[0] == []


def files(spark, rows):
    return spark.createDataFrame(rows, "path string, language string, content string")


def test_chunk_store_cuts_only_what_it_never_cut(spark):
    code = "import os\n\ndef a():\n    pass\n\nclass K:\n    def m(self):\n        pass\n"
    first = [("a.py", "python", code), ("b.txt", None, "one\ntwo"), ("c.txt", None, "one\ntwo"), ("empty", None, ""), ("null", None, None), (None, None, "no path")]
    store = ChunkStore(spark, f"{Scratch(spark, 'test-chunks').path}/s")
    store.add(files(spark, first), 0)
    assert store.reuse(0).first().asDict() == {"files": 5, "cut": 3, "reused": 0}
    second = [("moved/a.py", "python", code), ("a.py", "text", code), ("b.txt", None, "one\nthree"), ("c.txt", None, "one\ntwo"), ("d.txt", None, "x " * 30000)]
    store.add(files(spark, second), 1)
    store.add(files(spark, second), 1)  # a turn written again
    assert store.reuse(1).first().asDict() == {"files": 5, "cut": 3, "reused": 2}
    assert {(r.path, r.change) for r in store.changes(0, 1).collect()} == {("a.py", "changed"), ("b.txt", "changed"), ("c.txt", "same"), ("d.txt", "added"), ("empty", "removed"), ("moved/a.py", "added"), ("null", "removed")}
    from lodestone.operators.chunking import source_regions

    whole = source_regions(files(spark, second), namespace="n")
    rows = lambda df: sorted((r.path, r.line_start, r.line_end, r.segment, r.symbol, r.content, r.chunk_id) for r in df.collect())
    assert rows(store.chunks(1, "n")) == rows(whole)
    store.add(files(spark, first), 2)  # all comes back: nothing is cut
    assert store.reuse(2).first().cut == 0 and rows(store.chunks(2)) == rows(store.chunks(0))
    store.add(files(spark, first).limit(0), 3)
    assert store.chunks(3).count() == 0


def brute_tree(entries):
    dirs = {}
    for path, digest in entries:
        parts = path.split("/")
        dirs.setdefault("/".join(parts[:-1]), []).append((parts[-1], digest))
        for i in range(len(parts) - 1):
            dirs.setdefault("/".join(parts[:i]), [])
    out = {}
    for d in sorted(dirs, key=lambda d: -len(d.split("/")) if d else 1):
        kids = dirs[d] + [(x.split("/")[-1], out[x][1]) for x in out if x and "/".join(x.split("/")[:-1]) == d]
        hashes = [hashlib.sha256(f"{n}\0{h}".encode()).hexdigest() for n, h in kids]
        sums = [sum(int(h[16 * i : 16 * i + 16], 16) for h in hashes) for i in range(4)]
        out[d] = (len(kids), hashlib.sha256("|".join(map(str, [len(kids), *sums])).encode()).hexdigest())
    return out


def test_tree_fingerprints_change_up_to_the_root_only(spark):
    rng = random.Random(2)
    entries = {"/".join(rng.choice("abc") + str(k) for k in range(rng.randint(1, 5))) + f"/f{i}": f"{i:064x}" for i in range(80)} | {"top": "0" * 64}
    tree = lambda e: {r.path: (r.entries, r.fingerprint) for r in tree_fingerprints(spark.createDataFrame(list(e.items()), "path string, digest string")).collect()}
    one = tree(entries)
    assert one == brute_tree(entries.items())
    path = max(entries, key=lambda p: p.count("/"))
    two = tree(entries | {path: "f" * 64})
    above = {"/".join(path.split("/")[:i]) for i in range(path.count("/") + 1)}
    assert {d for d in one if one[d] != two[d]} == above
    assert tree_fingerprints(spark.createDataFrame([], "path string, digest string")).count() == 0


def test_all_strategies_score_in_one_scan(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"i{i}", ["log", "repo", "file", "document"][i % 4], f"src/f{i}.py", f"def f{i}(): alpha\n# todo beta {i}\nerror") for i in range(120)], "doc_id long, input_id string, input_type string, path string, content string")
    docs.write.parquet(str(tmp_path / "docs"))
    q = retrieval.Query("alpha beta 7")
    names = ["ripgrep", "bm25", "tree_sitter"]
    chunks = retrieval.grepped_chunks(spark.read.parquet(str(tmp_path / "docs")), q.terms)
    together = retrieval.candidates(chunks, q, names, ["doc_id"])
    apart = [(n, *r) for n in names for r in retrieval.candidates_of(chunks, q, n, ["doc_id"]).select("chunk_id", "score", "rank").collect()]
    assert sorted((r.strategy, r.chunk_id, r.score, r.rank) for r in together.collect()) == sorted(apart) and len(apart) == 72
    plan = retrieval.merged(chunks, q, names, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_a_plan_falls_back_only_where_nothing_is_found(spark):
    docs = spark.createDataFrame([(i, f"i{i}", "document", f"d/f{i}", f"alpha {i}") for i in range(40)], "doc_id long, input_id string, input_type string, path string, content string")
    chunks = retrieval.grepped_chunks(docs, ["alpha"])
    some = retrieval.executed(chunks, retrieval.Query("alpha"), {"document"}, ["doc_id"], ["embeddings"])
    assert some.count() == 24 and some.where(F.array_contains("matched_strategies", "fallback")).count() == 0
    none = retrieval.executed(chunks, retrieval.Query("omega"), {"document"}, ["doc_id"], ["embeddings"])
    assert [r["at"].doc_id for r in none.orderBy("idx").collect()] == list(range(24)) and none.first().matched_strategies == ["fallback"]
    nothing_fits = retrieval.executed(fixed_windows(docs), retrieval.Query("alpha", "summarize_logs"), {"artifact"}, ["doc_id"])
    assert nothing_fits.count() == 24


def test_a_plan_reads_its_texts_once(spark, tmp_path):
    rows = [(i, f"i{i}", "log" if i % 2 else "document", f"d/f{i}", f"alpha {i}\nx") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, input_id string, input_type string, path string, content string").write.parquet(str(tmp_path / "docs"))
    chunks = retrieval.grepped_chunks(spark.read.parquet(str(tmp_path / "docs")), ["alpha"])
    assert chunks._jdf.queryExecution().optimizedPlan().toString().count("split(") == 2  # with rare breaks or without
    found = retrieval.executed(chunks, retrieval.Query("alpha"), {"log", "document"}, ["doc_id"])
    assert found.count() == 32  # 20 logs and the first 4 documents by ripgrep, the first 12 of each by bm25
    assert not any(str(tmp_path) + "/docs" in f for f in found.inputFiles())


def test_line_hits_of_chunks_and_files(spark):
    r = random.Random(3)
    texts = ["".join(r.choice(["al", "be al", "Al", "x", ""]) + r.choice(["\n", "\n", "\r\n", "\x0b", "\u2028"] if i % 2 else ["\n"]) for _ in range(r.randint(0, 130))) + r.choice(["", "al"]) for i in range(30)] + ["", None, "\n", "\r\n"]
    docs = spark.createDataFrame([(i, "log" if i % 3 == 0 else "file", t) for i, t in enumerate(texts)], "i int, input_type string, content string")
    hits = lambda ls: sum(t in x for x in ls for t in ("al", "be"))
    want = []
    for i, t in enumerate(texts):
        ls, n = re.split("\r\n|[\n\x0b\u2028]", t or ""), 80 if i % 3 == 0 else 40
        ls = ls[:-1] if ls[-1] == "" else ls
        want += [(i, at + 1, hits(ls[at : at + n]), hits(ls)) for at in range(0, len(ls), n)]
    got = retrieval.grepped_chunks(docs, ["al", "be"]).select("i", "line_start", "hits_here", "hits_file")
    assert sorted(map(tuple, got.collect())) == want


def test_vectors_of_a_cell_meet_its_questions_as_matrices(spark):
    """No row for each pair; copies and what rounds alike are ranked by id."""
    rng = random.Random(5)
    rows = [(i, [round(rng.uniform(-1, 1), 1) for _ in range(3)] if i % 3 else [1.0, 2.0, 3.0]) for i in range(90)]
    index = VectorIndex(spark, f"{Scratch(spark, 'test-vectors').path}/matrices", 3)
    index.build(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cells=4)
    found = index.search(spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "query_id long, embedding array<double>"))
    assert [(r.id, r.rank) for r in found.orderBy("rank").collect()] == [(3 * i, i + 1) for i in range(10)]
    assert "CoGroup" in found._jdf.queryExecution().optimizedPlan().toString()

