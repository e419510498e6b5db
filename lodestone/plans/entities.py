"""The driver's tables as the engine's entities, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.chunking import fixed_windows
from lodestone.sources.files import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str, few: DataFrame | None = None) -> DataFrame:
    """documents as inputs: every type, class and file ending occurs. few: the doc_ids of a handful, which are picked in the scan."""
    d = table(spark, sf_dir, "documents")
    d = spread(d, "doc_id") if few is None else d.join(F.broadcast(few), "doc_id", "left_semi")
    return d.select(
        F.col("doc_id"),
        F.concat(F.lit("input_"), "doc_id").alias("input_id"),
        F.expr("CASE doc_id % 5 WHEN 0 THEN 'log' WHEN 1 THEN 'repo' WHEN 2 THEN 'file' ELSE 'document' END").alias("input_type"),
        F.concat("source", F.lit("/"), "doc_id", F.expr("CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.py' WHEN 2 THEN '.go' ELSE '.sh' END")).alias("path"),
        F.expr("CASE doc_id % 6 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' WHEN 2 THEN 'restricted' WHEN 3 THEN 'phi' WHEN 4 THEN 'secret_adjacent' ELSE 'unknown' END").alias("classification"),
        F.col("source"),
        F.col("text").alias("content"),
    )


DOCS = """docs AS (
  SELECT doc_id, 'input_' || doc_id AS input_id,
         CASE doc_id % 5 WHEN 0 THEN 'log' WHEN 1 THEN 'repo' WHEN 2 THEN 'file' ELSE 'document' END AS input_type,
         source || '/' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.py' WHEN 2 THEN '.go' ELSE '.sh' END AS path,
         CASE doc_id % 6 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' WHEN 2 THEN 'restricted' WHEN 3 THEN 'phi' WHEN 4 THEN 'secret_adjacent' ELSE 'unknown' END AS classification,
         source, text AS content FROM documents
)"""

#: Lines as lists, without an empty one after a last break.
LINES = r"""lines AS (
  SELECT *, CASE WHEN content = '' THEN [] ELSE string_split(CASE WHEN ends_with(content, chr(10)) THEN left(content, length(content) - 1) ELSE content END, chr(10)) END AS ls FROM docs
)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed_windows(docs(spark, sf_dir))


CHUNKS = f"""{DOCS}, {LINES}, windows AS (
  SELECT *, unnest(range(0, ((len(ls) - 1) // size + 1)::BIGINT)) AS wi FROM (SELECT *, CASE WHEN input_type = 'log' THEN 80 ELSE 40 END AS size FROM lines WHERE len(ls) > 0)
), chunks AS (
  SELECT *, 'sha256:' || sha256(content) AS chunk_hash, 'chunk_' || left(sha256(content), 12) || '_' || line_start AS chunk_id, greatest(1, length(content) // 4) AS token_estimate
  FROM (SELECT doc_id, input_id, input_type, path, classification, source, wi * size + 1 AS line_start, least((wi + 1) * size, len(ls)) AS line_end,
               array_to_string(ls[(wi * size + 1)::BIGINT : least((wi + 1) * size, len(ls))::BIGINT], chr(10)) AS content FROM windows)
)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as jobs: a customer is a root, eight shards each, some orders reducers or aliases."""
    o = table(spark, sf_dir, "orders")
    e = F.expr
    return o.select(
        F.col("o_orderkey").alias("job_id"),
        F.col("o_custkey").alias("root_job_id"),
        F.lit("log_analysis").alias("task_type"),
        e("CASE WHEN o_orderkey % 11 = 0 THEN 'aggregator' ELSE 'shard' END").alias("strategy"),
        e("concat('s', o_orderkey % 8)").alias("shard_key"),
        e("cast(o_orderkey % 8 AS int)").alias("shard_index"),
        F.lit(8).alias("shard_count"),
        e("concat('agg', o_custkey % 3)").alias("aggregation_key"),
        e("CASE WHEN o_orderkey % 13 = 0 THEN 'cancelled' WHEN o_orderkey % 17 = 0 THEN 'dispatching' WHEN o_orderstatus = 'F' THEN 'succeeded' WHEN o_orderstatus = 'O' THEN 'running' ELSE 'failed' END").alias("state"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("updated_at"),
        e("CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE concat('run', o_orderkey) END").alias("run_id"),
        e("CASE WHEN o_orderstatus = 'P' THEN concat('error ', o_orderkey) ELSE '' END").alias("error"),
        e("CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat('key', o_custkey % 97) END").alias("cache_key"),
        e("cast(o_orderkey % 7 AS int)").alias("chunk"),
        e("concat('user', o_custkey % 10)").alias("owner"),
        e("o_orderkey % 3 <> 0").alias("has_result"),
        e("CASE WHEN o_orderkey % 19 = 0 THEN o_orderkey - 1 END").alias("alias_of"),
    )


JOBS = """jobs AS (
  SELECT o_orderkey AS job_id, o_custkey AS root_job_id, 'log_analysis' AS task_type,
         CASE WHEN o_orderkey % 11 = 0 THEN 'aggregator' ELSE 'shard' END AS strategy, 's' || (o_orderkey % 8) AS shard_key, (o_orderkey % 8)::INT AS shard_index,
         'agg' || (o_custkey % 3) AS aggregation_key,
         CASE WHEN o_orderkey % 13 = 0 THEN 'cancelled' WHEN o_orderkey % 17 = 0 THEN 'dispatching' WHEN o_orderstatus = 'F' THEN 'succeeded' WHEN o_orderstatus = 'O' THEN 'running' ELSE 'failed' END AS state,
         o_orderdate AS created_at, CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE 'run' || o_orderkey END AS run_id,
         CASE WHEN o_orderstatus = 'P' THEN 'error ' || o_orderkey ELSE '' END AS error,
         CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'key' || (o_custkey % 97) END AS cache_key, (o_orderkey % 7)::INT AS chunk,
         'user' || (o_custkey % 10) AS owner, o_orderkey % 3 <> 0 AS has_result, CASE WHEN o_orderkey % 19 = 0 THEN o_orderkey - 1 END AS alias_of
  FROM orders
)"""
#: Effective shards: open, then succeeded, then retryable or cancelled; the newest of its class.
EFFECTIVE = """effective AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY root_job_id, shard_key, aggregation_key ORDER BY
    CASE WHEN state IN ('running', 'dispatching') THEN 0 WHEN state = 'succeeded' THEN 1 ELSE 2 END, created_at DESC, job_id DESC) AS rn FROM jobs WHERE strategy <> 'aggregator') WHERE rn = 1
)"""
