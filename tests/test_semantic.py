"""Semantic retrieval with clients that count their work and fail in every category."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lodestone.operators import semantic
from lodestone.operators.semantic import ServiceError
from lodestone.operators.vector_index import VectorIndex
from lodestone.sources.scratch import Scratch

WORDS = ["cache", "key", "node", "queue", "audit"]


def embed(rows):
    """One dimension a word, in a task."""

    def run(frames):
        for pdf in frames:
            pdf["embedding"] = [[float(t.count(w)) + 0.01 for w in WORDS] for t in pdf.content]
            yield pdf[["content_hash", "embedding"]]

    return rows.mapInPandas(run, "content_hash string, embedding array<double>")


def chunks(spark, texts):
    rows = [(i, hashlib.sha256(t.encode()).hexdigest(), t, f"src/{i}.go", "go", "", 1, 2) for i, t in texts.items()]
    return spark.createDataFrame(rows, "chunk_id string, content_hash string, content string, path string, language string, symbol string, line_start int, line_end int")


@pytest.fixture()
def index(spark):
    return VectorIndex(spark, f"{Scratch(spark, 'test-semantic').path}/i", len(WORDS), "string")


def test_only_what_changed_is_embedded(index, spark):
    texts = {f"c{i}": f"{WORDS[i % 5]} number {i}" for i in range(20)} | {"twin": "cache number 0"}
    out = semantic.retrieved(index, chunks(spark, texts), "cache", embed, "m1", 5)
    assert out.mode == "real" and out.stats == {"documents": 21, "embedded": 20, "reused": 1, "cache_hit": False}
    assert {r.chunk_id for r in out.rows.collect()} <= {i for i, t in texts.items() if "cache" in t}
    again = semantic.retrieved(index, chunks(spark, texts), "cache", embed, "m1", 5)
    assert again.stats == {"documents": 21, "embedded": 0, "reused": 21, "cache_hit": True}
    assert sorted(map(tuple, again.rows.collect())) == sorted(map(tuple, out.rows.collect()))
    texts |= {"c1": "queue and audit", "new": "cache number 5", "moved": texts.pop("c3")}
    later = semantic.retrieved(index, chunks(spark, texts), "queue audit", embed, "m1", 3)
    assert later.stats == {"documents": 22, "embedded": 1, "reused": 21, "cache_hit": False}  # moved and new are taken by their content
    assert later.rows.where("rank = 1").first().chunk_id == "c1"
    assert {r.chunk_id for r in semantic.signatures(index).collect()} == set(texts) == {r.id for r in index.live().collect()}
    other = semantic.retrieved(index, chunks(spark, texts), "queue", embed, "m2", 3)
    assert other.stats["embedded"] == len(set(texts.values()))  # another model has other vectors


def failing(category, where):
    def client(rows):
        if where == "driver":
            raise ServiceError(category, "no answer")

        def run(frames):
            for _ in frames:
                raise ServiceError(category, "no answer")
            yield from ()

        schema = "content_hash string, embedding array<double>" if "content_hash" in rows.columns else "chunk_id string, score double"
        return rows.mapInPandas(run, schema)

    return client


@pytest.mark.parametrize("where", ["driver", "task"])
@pytest.mark.parametrize("category", ["timeout", "oom"])
def test_a_failing_service_leaves_words_alone(index, spark, where, category):
    c = chunks(spark, {"a": "cache", "b": "key"})
    out = semantic.retrieved(index, c, "cache", failing(category, where), "m")
    assert (out.rows, out.mode, out.stats["embedded"]) == (None, "lexical_degraded", 0)
    assert [(a.stage, a.state, a.category) for a in out.attempts] == [("semantic_retrieval", "failed", category)]
    candidates = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 2)], "chunk_id string, rrf_score double, rank int")
    kept = semantic.reranked(candidates, c, failing(category, where))
    assert kept.mode == "failed" and kept.attempts[0].category == category and kept.rows is candidates
    healthy = semantic.retrieved(index, c, "cache", embed, "m")  # the failed turn left nothing behind
    assert healthy.mode == "real" and healthy.stats["embedded"] == 2


def test_other_errors_are_raised(index, spark):
    def broken(rows):
        return rows.select("content_hash", F.raise_error(F.lit("a bug")).cast("array<double>").alias("embedding"))

    with pytest.raises(Exception, match="a bug"):
        semantic.retrieved(index, chunks(spark, {"a": "x"}), "x", broken, "m")


def test_missing_vectors_and_no_candidates_degrade(index, spark):
    half = lambda rows: embed(rows.where(~F.contains("content", F.lit("key"))))
    out = semantic.retrieved(index, chunks(spark, {"a": "cache", "b": "key"}), "cache", half, "m")
    assert out.mode == "lexical_degraded" and out.attempts[0].category == "service_failure"
    candidates = spark.createDataFrame([("zz", 0.5, 1)], "chunk_id string, rrf_score double, rank int")
    assert semantic.reranked(candidates, chunks(spark, {"a": "x"}), embed).mode == "failed"


def test_rerank_orders_the_first(spark):
    c = chunks(spark, {f"c{i:03}": f"text {i}" for i in range(80)})
    candidates = spark.createDataFrame([(f"c{i:03}", 1.0 / (i + 1), i + 1) for i in range(80)] + [("lost", 0.0001, 3)], "chunk_id string, rrf_score double, rank int")
    seen = []

    def rerank(rows):
        seen.append(rows.first().document)
        return rows.select("chunk_id", (F.substring("chunk_id", 2, 3).cast("int") % 7).alias("score"))

    out = semantic.reranked(candidates, c, rerank)
    got = [(r.chunk_id, r.rank) for r in out.rows.orderBy("rank").collect()]
    want = sorted((f"c{i:03}" for i in range(64)), key=lambda x: (-(int(x[1:]) % 7), int(x[1:])))
    assert got == [(x, n) for n, x in enumerate(want, 1)] and seen[0].startswith("path: src/c")
