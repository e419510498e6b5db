"""Vectors: norms, cosine top-k, rerank, merging of segments, index maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """In double precision; vectors of unequal length are an error."""
    value = F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("embedding dimensions do not match")).cast("double")).otherwise(value)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    n = norm(v)
    return F.when(n == 0, F.transform(doubles(v), lambda x: F.lit(0.0))).otherwise(F.transform(doubles(v), lambda x: x / n))


def top_k(vectors: DataFrame, query: list[float], k: int, vector: str = "embedding", id_: str = "vec_id") -> DataFrame:
    """The k nearest by cosine, ties by id. The query is a literal, so the scan scores in place and only k rows of each task move."""
    q = F.array(*(F.lit(float(x)) for x in query))
    scored = vectors.select(id_, dot(normalized(F.col(vector)), normalized(q)).alias("score"))
    return scored.orderBy(F.desc("score"), id_).limit(k)


def ranked_top_k(vectors: DataFrame, query: list[float], k: int, vector: str = "embedding", id_: str = "vec_id") -> DataFrame:
    best = top_k(vectors, query, k, vector, id_)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_)))


def merge_segments(segments: DataFrame, id_: str, vector: str) -> DataFrame:
    """The normalized sum of an id's vectors; a single one stays as it is."""
    dims = segments.select(id_, F.posexplode(doubles(F.col(vector))).alias("dim", "x"))
    summed = dims.groupBy(id_, "dim").agg(F.sum("x").alias("x"), F.count(F.lit(1)).alias("n"))
    whole = summed.groupBy(id_).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda d: d["x"]).alias("v"), F.max("n").alias("segments"))
    return whole.select(id_, "segments", F.when(F.col("segments") == 1, F.col("v")).otherwise(normalized(F.col("v"))).alias("vector"))


def upsert(base: DataFrame, changed: DataFrame, removed: DataFrame, id_: str, version: str) -> DataFrame:
    """base without removed and changed ids, then the newest row of each changed id."""
    newest = changed.withColumn("_n", F.row_number().over(Window.partitionBy(id_).orderBy(F.desc(version)))).where("_n = 1").drop("_n")
    kept = base.join(removed.select(id_), id_, "left_anti").join(changed.select(id_).distinct(), id_, "left_anti")
    return kept.unionByName(newest.join(removed.select(id_), id_, "left_anti"))


def reusable(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Rows to embed, with vectors known for the same model, content hash and text hash."""
    return wanted.join(known, ["model", "content_hash", "text_hash"], "left").withColumn("reused", F.col("vector").isNotNull())


def status(index: DataFrame, expected: int) -> DataFrame:
    return index.agg(F.count(F.lit(1)).alias("documents"), (F.count(F.lit(1)) == expected).alias("ready"))


def unknown_or_repeated(results: DataFrame, asked: DataFrame, id_: str = "chunk_id") -> DataFrame:
    """Results that were not asked for, or came twice; a sound answer gives no rows."""
    unknown = results.join(asked, id_, "left_anti").select(id_, F.lit("unknown").alias("problem")).distinct()
    twice = results.groupBy(id_).count().where("count > 1").select(id_, F.lit("repeated").alias("problem"))
    return unknown.unionByName(twice)


def chosen(vectors: DataFrame, ids: DataFrame, id_: str) -> DataFrame:
    """The rows whose id is in a set, as of changed chunks."""
    return vectors.join(ids, id_, "left_semi")


def reranked(vectors: DataFrame, query: list[float], top: int, vector: str = "embedding", id_: str = "vec_id") -> DataFrame:
    """The top by likeness to the question to 9 digits, ties in the order of ids; place counts from 1."""
    q = F.array(*(F.lit(float(x)) for x in query))
    scored = vectors.select(id_, F.round(dot(normalized(F.col(vector)), normalized(q)), 9).alias("score")).orderBy(F.desc("score"), id_).limit(top)
    return scored.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), id_)))
