"""Retrieval quality: recall, reciprocal rank, citation precision, ordering rules, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import questions

#: What a suite must reach.
GATES = {"recall_at_10": 0.90, "mrr": 0.75, "citation_precision": 0.95}


def normalized_path(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^(\\./)+", "")


def tails(path: Column) -> Column:
    """The path and all its ends after a slash, so that a match by end is an equality."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "/"))


def hits(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """ranked (query_id, path, rank), relevant (query_id, expected): best rank of each expected path, by whole or by its end."""
    ends = ranked.select("query_id", "rank", F.explode(F.array_distinct(tails(normalized_path(F.col("path"))))).alias("expected"))
    want = relevant.select("query_id", normalized_path(F.col("expected")).alias("expected")).distinct()
    return want.join(ends, ["query_id", "expected"], "left").groupBy("query_id", "expected").agg(F.min("rank").alias("rank"))


def per_query(found: DataFrame, at: int = 10) -> DataFrame:
    recall = F.count_if(F.col("rank") <= at) / F.count(F.lit(1))
    return found.groupBy("query_id").agg(F.round(recall, 6).alias("recall_at_10"), F.round(F.coalesce(1.0 / F.min("rank"), F.lit(0.0)), 6).alias("reciprocal_rank"))


def metrics(queries: DataFrame, citations: DataFrame) -> DataFrame:
    """One row; citations (valid, invalid, missing)."""
    a = queries.agg(F.count(F.lit(1)).alias("query_count"), F.round(F.avg("recall_at_10"), 6).alias("recall_at_10"), F.round(F.avg("reciprocal_rank"), 6).alias("mrr"), F.lit(1).alias("_k"))
    total = F.sum(F.col("valid") + F.col("invalid") + F.col("missing"))
    c = citations.agg(F.coalesce(F.round(F.sum("valid") / F.nullif(total, F.lit(0)), 6), F.lit(1.0)).alias("citation_precision"), F.coalesce(F.sum("missing"), F.lit(0)).alias("missing_evidence_refs"), F.lit(1).alias("_k"))
    return a.join(c, "_k").drop("_k")


def passed(m: DataFrame) -> DataFrame:
    ok = (F.col("recall_at_10") >= GATES["recall_at_10"]) & (F.col("mrr") >= GATES["mrr"]) & (F.col("citation_precision") >= GATES["citation_precision"]) & (F.col("missing_evidence_refs") == 0)
    return m.withColumn("passed", ok)


def ordering_failures(ranked: DataFrame, rules: DataFrame) -> DataFrame:
    """rules (query_id, rule, higher, lower): prefixes of which the higher must come first."""
    rows = rules.join(ranked, "query_id")
    best = rows.groupBy("query_id", "rule", "higher", "lower").agg(F.min(F.when(F.startswith("path", F.col("higher")), F.col("rank"))).alias("higher_rank"), F.min(F.when(F.startswith("path", F.col("lower")), F.col("rank"))).alias("lower_rank"))
    return best.withColumn("failed", F.col("higher_rank").isNull() | F.coalesce(F.col("higher_rank") >= F.col("lower_rank"), F.lit(False)))


def ranked_paths(candidates: Column) -> Column:
    """Paths in order, each once."""
    return F.array_distinct(F.transform(candidates, normalized_path))


def suite_errors(suite: DataFrame, expected: int = 30) -> DataFrame:
    """One row: what is wrong with a suite (id, mode, relevant_paths)."""
    a = suite.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.count_if(F.size("relevant_paths") == 0).alias("empty"), F.count_if(~F.col("mode").isin("auto", "evidence", "answer")).alias("modes"))
    return a.select(F.array_compact(F.array(F.when(F.col("n") != expected, F.lit("query_count")), F.when(F.col("ids") != F.col("n"), F.lit("duplicate_id")), F.when(F.col("empty") > 0, F.lit("no_relevant_paths")), F.when(F.col("modes") > 0, F.lit("mode")))).alias("errors"))


def containing(docs: DataFrame, passages: DataFrame, text: str = "content", key: str = "path", words: int = 5) -> DataFrame:
    """passages (query_id, query) -> (query_id, key) of the documents that contain a passage as it stands.

    A passage is anchored by a run of its inner words, the longest of them in letters, which any text that contains the
    passage has as whole words. Each text is read once along the tree of all anchors of a block of passages, in its own
    row, and the few pairs it finds are confirmed there: no run of a text becomes a row. A passage of one or two words has
    no inner ones and is found as whole words only; one without words is contained in nothing.
    """
    return questions.holding(docs.select(F.col(key), F.col(text)), key, passages, words)
