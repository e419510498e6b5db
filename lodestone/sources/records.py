"""Records that come as JSON texts in several shapes: job stores, audit lines, result lists and envelopes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.folds import in_order

ANY_OBJECT = "map<string,string>"


def job_store(stores: DataFrame, text: str = "text") -> DataFrame:
    """A store is one JSON object, a job under each key: (job_id, job as JSON); a text that is no object gives no rows."""
    held = F.from_json(F.col(text), ANY_OBJECT)
    return stores.select(*(c for c in stores.columns if c != text), F.explode(held).alias("job_id", "job"))


def audit_lines(lines: DataFrame, file: str, line_no: str = "line_no", text: str = "line") -> DataFrame:
    """The lines of each file up to its first that is no JSON object; that one is kept and marked bad. Blank lines don't count."""
    filled = lines.where(F.trim(F.col(text)) != "").withColumn("bad", F.from_json(F.col(text), ANY_OBJECT).isNull() | ~F.trim(F.col(text)).startswith("{"))
    before = Window.partitionBy(file).orderBy(line_no).rowsBetween(Window.unboundedPreceding, -1)
    return filled.withColumn("_stop", F.coalesce(F.max("bad").over(before), F.lit(False))).where("NOT _stop").drop("_stop")


def result_records(files: DataFrame, file: str, text: str = "text") -> DataFrame:
    """(file, id, record as JSON) of a JSON list, an object with a list under results, an object with a record under each id, or one record a line."""
    t = F.trim(F.col(text))
    as_list = lambda c: F.from_json(c, "array<string>")
    own_id = lambda r: F.get_json_object(r, "$.id")
    whole = F.try_parse_json(t).isNotNull()
    named = F.transform(F.map_entries(F.from_json(t, ANY_OBJECT)), lambda e: F.struct(F.coalesce(own_id(e["value"]), e["key"]).alias("id"), e["value"].alias("record")))
    listed = lambda a: F.transform(a, lambda r: F.struct(own_id(r).alias("id"), r.alias("record")))
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")
    results = F.get_json_object(t, "$.results")
    by_line = (F.size(lines) > 1) & F.forall(lines, lambda x: F.trim(x).startswith("{") & F.try_parse_json(x).isNotNull())
    records = (
        F.when(by_line, listed(lines))
        .when(whole & t.startswith("["), listed(as_list(t)))
        .when(whole & results.isNotNull(), listed(as_list(results)))
        .when(whole & own_id(t).isNotNull(), listed(F.array(t)))
        .when(whole, named)
        .otherwise(listed(lines))
    )
    return files.select(file, F.inline(records))


def unwrapped(text: Column) -> Column:
    """The innermost payload of a result: the text of its first content part, then what stands under result, then under payload; as it is where it has none of them."""
    said = F.coalesce(F.get_json_object(text, "$.content[0].text"), text)
    inner = F.coalesce(F.get_json_object(said, "$.result"), said)
    return F.coalesce(F.get_json_object(inner, "$.payload"), inner)


def optional(wanted: DataFrame, found: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """A file that is missing or no JSON counts as an empty object."""
    there = found.select(path, F.when(F.try_parse_json(F.col(text)).isNotNull(), F.col(text)).alias(text))
    return wanted.join(there, path, "left").withColumn(text, F.coalesce(text, F.lit("{}")))


def run_states(runs: DataFrame, accounting: DataFrame, queue: DataFrame) -> DataFrame:
    """(run_id, state): by the accounting table, else by the queue, else unknown."""
    a, q = accounting.select("run_id", F.lower("state").alias("_a")), queue.select("run_id", F.lower("state").alias("_q"))
    return runs.join(a, "run_id", "left").join(q, "run_id", "left").select("run_id", F.coalesce("_a", "_q", F.lit("unknown")).alias("state"))


def array_manifest(shards: DataFrame, parent: str = "parent", order: str = "shard_index") -> DataFrame:
    """One row for each shard job, as the scheduler counts them: task 0, 1, ..."""
    return shards.withColumn("task", F.row_number().over(Window.partitionBy(parent).orderBy(order)) - 1)


def cache_index(jobs: DataFrame) -> DataFrame:
    """By cache key, the newest finished job with a result: the side table of a store."""
    done = jobs.where("cache_key <> '' AND state = 'succeeded' AND has_result")
    return done.groupBy("cache_key").agg(F.max(F.struct("updated_at", "job_id", "task_type", "owner")).alias("j")).select("cache_key", "j.job_id", "j.task_type", "j.owner", "j.updated_at")


def upload_batches(vectors: DataFrame, order: str, size: Column, parts: int, most: int = 32, most_bytes: int = 8 << 20) -> DataFrame:
    """Adds part and batch: rows are dealt to parts by hash, and in a part a batch closes before it would pass most rows or most_bytes. A part's batch 0 replaces what is stored."""

    def step(state: tuple[int, int, int], weight: int) -> tuple:
        batch, n, used = state
        if n and (n >= most or used + weight > most_bytes):
            batch, n, used = batch + 1, 0, 0
        return (batch, n + 1, used + weight), (batch,)

    rows = vectors.withColumn("part", F.pmod(F.xxhash64(order), F.lit(parts)).cast("int")).withColumn("_size", size.cast("long"))
    return in_order(rows, "part", [order], ["_size"], {"batch": ("int", pa.int32())}, lambda: (0, 0, 0), step).drop("_size")
