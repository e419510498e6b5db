"""Inspection of a corpus end to end: lexical and semantic rankings, fusion, budgets, rerank, diverse selection, trimming."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.query import features
from lodestone.operators import lexical, questions, selection, vectors
from lodestone.sources.scratch import Scratch

# How many fused candidates a reranker scores.
RERANKED = 64


@dataclass
class Budgets:
    retrieval: int = 32000
    evidence: int = 12000
    final_pack: int = 8000


def by_cross_encoder(candidates: DataFrame, scores: DataFrame | None) -> DataFrame:
    """candidates (chunk_id, rrf_score, rank), scores (chunk_id, score) of the first RERANKED: by score, then fused score, then id, with ranks anew. Without scores the order stays."""
    if scores is None:
        return candidates.withColumn("score", F.col("rrf_score"))
    first = candidates.where(F.col("rank") <= RERANKED).drop("score").join(scores.select("chunk_id", "score"), "chunk_id", "left")
    order = Window.orderBy(F.desc_nulls_last("score"), F.desc("rrf_score"), "chunk_id")
    return first.withColumn("rank", F.row_number().over(order))


def rerank_report(before: DataFrame, after: DataFrame, selected: DataFrame, first: int = 16) -> DataFrame:
    """The first candidates and where the reranker put them, with a flag for those that were selected."""
    rows = before.where(F.col("rank") <= first).select("chunk_id", F.col("rank").alias("candidate_rank"))
    rows = rows.join(after.select("chunk_id", F.col("rank").alias("reranked")), "chunk_id", "left").join(selected.select("chunk_id", F.lit(True).alias("selected")), "chunk_id", "left")
    return rows.withColumn("selected", F.coalesce("selected", F.lit(False)))


def semantic(index: DataFrame | None, query_vector: list[float] | None, top: int = 128) -> DataFrame | None:
    """index (chunk_id, embedding); None where there is no index or no vector, and the caller goes on with words alone."""
    if index is None or query_vector is None:
        return None
    return vectors.ranked_top_k(index, query_vector, top, "embedding", "chunk_id").select("chunk_id", "rank")


def inspect(chunks: DataFrame, query: str, budgets: Budgets | None = None, index: DataFrame | None = None, query_vector: list[float] | None = None, scores: DataFrame | None = None, named: list[str] | None = None) -> DataFrame:
    """chunks (chunk_id, path, symbol, language, content, line_start, line_end) -> the cited excerpts, in order, each with how it was found.

    Contents join back only for the few that are left after fusion.
    """
    budgets = budgets or Budgets()
    words = lexical.search(chunks, query, features(chunks.sparkSession, query), with_index=True).select("chunk_id", "rank")
    meaning = semantic(index, query_vector)
    scratch = Scratch(chunks.sparkSession, "inspection")
    fused = scratch.write(selection.reciprocal_rank_fusion([("lexical", words)] + ([("semantic", meaning)] if meaning is not None else [])), "fused")
    known = chunks.join(F.broadcast(fused), "chunk_id")  # at most FUSED rows
    known = known.withColumn("token_estimate", F.greatest(F.lit(1), F.floor((F.char_length("content") + 2) / 3)).cast("int")).withColumn("namespace", F.lit("")).withColumn("content_hash", F.sha2("content", 256)).withColumn("one", F.lit(0))
    known = scratch.write(known, "known")
    fits = selection.greedy_budget(known, ["rank", "chunk_id"], budgets.retrieval, ["one"]).select("chunk_id")
    ranked = by_cross_encoder(known.join(fits, "chunk_id", "left_semi"), scores)
    ranked = scratch.write(ranked, "ranked")
    picked = selection.diverse(ranked, ["one"], budgets.evidence, named)
    cited = picked.join(ranked.drop("rank", "one"), "chunk_id").select("one", "place", "chunk_id", "path", "line_start", "line_end", "rrf_score", "score", "sources", F.col("content").alias("excerpt"))
    trimmed = selection.trim_longest(cited.select("one", "place", "excerpt"), ["one"], budgets.final_pack)
    quality = F.when(F.array_contains("sources", "semantic") & F.lit(scores is not None), "answer_ready").otherwise("evidence_only")
    return cited.drop("excerpt").join(trimmed.drop("one"), "place").select("place", "chunk_id", "path", "line_start", "line_end", F.round("rrf_score", 8).alias("rrf_score"), "sources", "excerpt", quality.alias("quality"))


def bm25_of_queries(docs: DataFrame, queries: DataFrame, top: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """docs (path, content), queries (query_id, query) -> (query_id, path, score, rank): all questions of a block in one scan. Words are runs of letters and digits in lower case. Each document is a row of counts of the asked words, and each task keeps the best of each question: no row for each question and document is made."""
    best = questions.scored(docs.select("path", questions.spaced(F.col("content")).alias("text")), "path", queries.select("query_id", questions.spaced(F.col("query")).alias("text")), top, k1, b)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("path"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
