"""Semantic retrieval with injected clients: a kept index is brought up to date, searched, and done without where a service fails.

A client is a function from a DataFrame to a DataFrame, most often a mapInPandas over a service. What it raises as
ServiceError, on the driver or in a task, is a failure of its category and leads to words alone or to the order there was;
any other error is a bug and is raised.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.inspection import RERANKED
from lodestone.operators.vector_index import VectorIndex
from lodestone.sources.scratch import Scratch

# Kinds of failure of a service.
CATEGORIES = ["availability", "timeout", "queue_delay", "oom", "authentication", "service_failure"]
SIGNATURES = "chunk_id string, content_hash string, model string, turn int"
TOP = 128

Client = Callable[[DataFrame], DataFrame]


class ServiceError(Exception):
    """What a client raises where its service fails; its text says the category, so that a task's error can be told on the driver."""

    def __init__(self, category: str, detail: str = ""):
        super().__init__(f"service failed ({category}): {detail}")
        self.category = category


def category_of(error: Exception) -> str | None:
    """The category of a ServiceError, raised here or in a task; None for any other error."""
    if isinstance(error, ServiceError):
        return error.category
    found = re.search(r"service failed \(([a-z_]+)\)", str(error)) if isinstance(error, PySparkException) or "py4j" in type(error).__module__ else None
    return (found[1] if found[1] in CATEGORIES else "service_failure") if found else None


@dataclass
class Attempt:
    stage: str
    state: str
    category: str = ""
    detail: str = ""


@dataclass
class Outcome:
    """rows: the ranking (chunk_id, rank), None where it is done without; mode: real or degraded; stats: documents, embedded, reused, cache_hit."""

    rows: DataFrame | None
    mode: str
    stats: dict = field(default_factory=dict)
    attempts: list[Attempt] = field(default_factory=list)


def signatures(index: VectorIndex) -> DataFrame:
    """(chunk_id, content_hash, model) of what the index has, by its newest turns."""
    rows = Scratch.read_or_empty(index.spark, f"{index.folder}/signatures", SIGNATURES)
    last = rows.groupBy("chunk_id").agg(F.max_by(F.struct("content_hash", "model"), "turn").alias("s"))
    return last.where("s.content_hash IS NOT NULL").select("chunk_id", "s.content_hash", "s.model")


def ensure(index: VectorIndex, chunks: DataFrame, embed: Client, model: str, turn: int) -> dict:
    """Makes the index that of chunks (chunk_id, content_hash, content): vectors of content that it had, under any id and of the same model, are taken, and only what is left goes through embed (content_hash, content -> content_hash, embedding), each content once. Nothing is written where nothing changed."""
    scratch = Scratch(index.spark, "semantic")
    have = signatures(index)
    want = chunks.select("chunk_id", "content_hash")
    same = have.where(F.col("model") == model)
    come = scratch.write(want.join(same.select("chunk_id", "content_hash"), ["chunk_id", "content_hash"], "left_anti"), "come")
    gone = scratch.write(have.join(want, "chunk_id", "left_anti").select("chunk_id"), "gone")
    n, n_come, n_gone = want.count(), come.count(), gone.count()
    if not n_come and not n_gone:
        return {"documents": n, "embedded": 0, "reused": n, "cache_hit": True}
    kept = index.live().join(same, F.col("id") == F.col("chunk_id")).groupBy("content_hash").agg(F.first("v").alias("embedding"))
    kept = kept.join(come, "content_hash", "left_semi")
    new = chunks.join(come, ["chunk_id", "content_hash"], "left_semi").join(kept, "content_hash", "left_anti")
    new = embed(new.groupBy("content_hash").agg(F.first("content").alias("content"))).select("content_hash", "embedding")
    known = scratch.write(kept.withColumn("embedded", F.lit(False)).unionByName(new.withColumn("embedded", F.lit(True))), "known")
    missing = come.join(known, "content_hash", "left_anti").limit(1).count()
    if missing:
        raise ServiceError("service_failure", "a content came back without a vector")
    rows = come.join(known, "content_hash").select("chunk_id", "embedding")
    removed = gone.select(F.col("chunk_id").alias("id"))
    if turn == 0:
        index.build(rows, id_="chunk_id")
    else:
        index.add(rows, turn, removed, id_="chunk_id")
    marks = come.withColumn("model", F.lit(model)).unionByName(gone.select("chunk_id", F.lit(None).cast("string").alias("content_hash"), F.lit(model).alias("model")))
    marks.write.mode("overwrite").parquet(f"{index.folder}/signatures/turn={turn}")
    embedded = known.where("embedded").count()
    return {"documents": n, "embedded": embedded, "reused": n - embedded, "cache_hit": False}


def next_turn(index: VectorIndex) -> int:
    return int(Scratch.read_or_empty(index.spark, f"{index.folder}/signatures", SIGNATURES).agg(F.coalesce(F.max("turn") + 1, F.lit(0))).first()[0])


def retrieved(index: VectorIndex, chunks: DataFrame, query: str, embed: Client, model: str, top: int = TOP) -> Outcome:
    """Brings the index up to date, searches it with the query's vector, and says how it went. Where a service fails, or nothing is found, the ranking is left out and the caller goes on with words alone."""
    nothing = {"documents": chunks.count(), "embedded": 0, "reused": 0, "cache_hit": False}
    try:
        stats = ensure(index, chunks, embed, model, next_turn(index))
        asked = index.spark.createDataFrame([("query", query)], "content_hash string, content string")
        question = embed(asked).select(F.lit(0).alias("query_id"), "embedding")
        found = Scratch(index.spark, "semantic").write(index.search(question, top), "found")
        if not found.limit(1).count():
            raise ServiceError("service_failure", "no candidates")
    except Exception as error:
        category = category_of(error)
        if category is None:
            raise
        return Outcome(None, "lexical_degraded", nothing, [Attempt("semantic_retrieval", "failed", category, str(error)[:200])])
    return Outcome(found.select(F.col("id").alias("chunk_id"), "rank"), "real", stats, [Attempt("semantic_retrieval", "succeeded")])


def reranked(candidates: DataFrame, chunks: DataFrame, rerank: Client) -> Outcome:
    """candidates (chunk_id, rrf_score, rank): the first RERANKED of them that have a chunk go through rerank (chunk_id, document -> chunk_id, score), and are ranked by score, fused score and id. Where the service fails, or none has a chunk, the order stays."""
    scratch = Scratch(candidates.sparkSession, "rerank")
    line = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(F.col(c).cast("string"), F.lit("")))
    said = F.concat_ws("\n", line("path", "path"), line("language", "language"), line("symbol", "symbol"), F.concat(F.lit("lines: "), "line_start", F.lit("-"), "line_end"), "content")
    first = candidates.where(F.col("rank") <= RERANKED)
    asked = scratch.write(chunks.join(F.broadcast(first.select("chunk_id")), "chunk_id").select("chunk_id", said.alias("document")), "asked")  # RERANKED rows at most
    try:
        if not asked.limit(1).count():
            raise ServiceError("service_failure", "no candidates")
        scores = scratch.write(rerank(asked).select("chunk_id", F.col("score").cast("double").alias("score")), "scores")
    except Exception as error:
        category = category_of(error)
        if category is None:
            raise
        return Outcome(candidates, "failed", {}, [Attempt("rerank", "failed", category, str(error)[:200])])
    order = Window.orderBy(F.desc("score"), F.desc("rrf_score"), "chunk_id")
    rows = first.join(scores, "chunk_id").withColumn("rank", F.row_number().over(order))
    return Outcome(rows, "real", {}, [Attempt("rerank", "succeeded")])
