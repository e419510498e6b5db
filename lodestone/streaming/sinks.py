"""Sinks that keep tables by micro-batch: an audit chain that goes on from batch to batch, and the newest state of each job.

A batch writes its own folders and overwrites them when it runs again, so what a restart repeats stands once.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.functions.classes import TERMINAL_STATES, is_terminal
from lodestone.operators.governance import chained, verify

TAILS = "chain string, seq long, event_hash string, batch long"


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _run(stream: DataFrame, apply, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tails(spark: SparkSession, out: str, before: int | None = None) -> DataFrame:
    """(chain, seq, event_hash) of each chain's newest event in batches before one: a row a chain and batch, no events."""
    rows = _table(spark, f"{out}/tails", TAILS)
    if rows is None:
        return spark.createDataFrame([], "chain string, seq long, event_hash string")
    rows = rows if before is None else rows.where(F.col("batch") < before)
    return rows.groupBy("chain").agg(F.max("seq").alias("seq"), F.max_by("event_hash", "seq").alias("event_hash"))


def audit_chain(stream: DataFrame, out: str, checkpoint: str, order: str = "at") -> StreamingQuery:
    """Appends events (chain, order, actor, role, action, outcome ...) to out/events with seq, prev_hash and event_hash, and ends when all are there. Each batch is chained on to the last hash of the batches before it. In a chain, events of a batch go by order, then by their JSON; a later batch goes after an earlier one."""

    def append(batch: DataFrame, number: int) -> None:
        last = tails(batch.sparkSession, out, number).select(F.col("chain").alias("_chain"), F.col("seq").alias("_seq"), F.col("event_hash").alias("_last"))
        rows = batch.withColumn("chain", F.col("chain").cast("string")).join(last, F.col("chain").eqNullSafe(F.col("_chain")), "left")
        place = F.row_number().over(Window.partitionBy("chain").orderBy(order, F.to_json(F.struct(*batch.columns))))
        rows = rows.withColumn("seq", F.coalesce("_seq", F.lit(0)).cast("long") + place).withColumn("_last", F.coalesce("_last", F.lit("")))
        whole = chained(rows, "chain", "seq", F.col("_last")).drop("_chain", "_seq", "_last")
        whole.write.mode("overwrite").parquet(f"{out}/events/batch={number}")
        written = batch.sparkSession.read.schema(whole.schema).parquet(f"{out}/events/batch={number}")
        ends = written.groupBy("chain").agg(F.max("seq").alias("seq"), F.max_by("event_hash", "seq").alias("event_hash"))
        ends.write.mode("overwrite").parquet(f"{out}/tails/batch={number}")

    return _run(stream, append, checkpoint)


def pruned(spark: SparkSession, out: str, keep: int) -> DataFrame:
    """The events of the newest batches, each chain's first with anchor, the hash of the event before it. Tails of older batches stay, so a shortened chain can still be checked."""
    numbers = sorted(r["batch"] for r in spark.read.parquet(f"{out}/tails").select("batch").distinct().collect())[-keep:]
    events = spark.read.parquet(f"{out}/events").where(F.col("batch").isin(numbers))
    before = tails(spark, out, numbers[0] if numbers else 0).select(F.col("chain").alias("_chain"), F.col("event_hash").alias("anchor"))
    return events.join(before, F.col("chain").eqNullSafe(F.col("_chain")), "left").drop("_chain").withColumn("anchor", F.coalesce("anchor", F.lit("")))


def rotate(spark: SparkSession, out: str, archive: str, keep: int) -> None:
    """Writes the events of the newest batches to another folder, in one table by batch; what is older is left behind with the old folder."""
    pruned(spark, out, keep).write.mode("overwrite").partitionBy("batch").parquet(f"{archive}/events")
    spark.read.parquet(f"{out}/tails").write.mode("overwrite").partitionBy("batch").parquet(f"{archive}/tails")


def checked(events: DataFrame) -> DataFrame:
    """By chain whether it holds; events of a shortened chain have an anchor."""
    seed = F.col("anchor") if "anchor" in events.columns else ""
    return verify(events, "chain", "seq", seed)


PARTS = "job_id long, state string, last_at timestamp, started_at timestamp, ended_at timestamp, batch long"


def job_states(stream: DataFrame, out: str, checkpoint: str, states: list[str]) -> StreamingQuery:
    """Follows events (job_id, state, at) into out/parts, for each batch what it says of the jobs it has: newest state, first time running, first time ended. Events of no known state, job or time go to out/rejected instead. All of this is largest and smallest values, so late and repeated events need no order and no state is held between batches."""

    def one(batch: DataFrame, number: int) -> None:
        sound = F.coalesce(F.col("state").isin(*states), F.lit(False)) & F.col("job_id").isNotNull() & F.col("at").isNotNull()
        rows, at = batch.where(sound), F.col("at").cast("timestamp")
        parts = rows.groupBy(F.col("job_id").cast("long").alias("job_id")).agg(F.max_by("state", F.struct("at", "state")).alias("state"), F.max(at).alias("last_at"), F.min(F.when(F.col("state") == "running", at)).alias("started_at"), F.min(F.when(is_terminal(F.col("state")), at)).alias("ended_at"))
        parts.write.mode("overwrite").parquet(f"{out}/parts/batch={number}")
        batch.where(~sound).write.mode("overwrite").parquet(f"{out}/rejected/batch={number}")

    return _run(stream, one, checkpoint)


def current_states(spark: SparkSession, out: str) -> DataFrame:
    """(job_id, state, started_at, completed_at) over all batches: the rows of jobs.transitions over all events."""
    parts = _table(spark, f"{out}/parts", PARTS)
    parts = spark.createDataFrame([], PARTS) if parts is None else parts
    rows = parts.groupBy("job_id").agg(F.max_by("state", F.struct("last_at", "state")).alias("state"), F.min("started_at").alias("started_at"), F.min("ended_at").alias("ended_at"))
    return rows.select("job_id", "state", "started_at", F.when(F.col("state").isin(*TERMINAL_STATES), F.col("ended_at")).alias("completed_at"))
