"""Heartbeats as a stream: newest progress by job, timeouts, submissions that repeat.

Each has a batch twin in this module, and an availableNow run over all files gives the twin's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.functions.classes import is_terminal


def read(spark: SparkSession, path: str, schema: StructType | str, files: int | None = None, fmt: str = "json") -> DataFrame:
    """An append-only folder of heartbeat files; files bounds one trigger."""
    reader = spark.readStream.format(fmt).schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).load(path)


def watermarked(rows: DataFrame, late: str) -> DataFrame:
    """Watermarks want an instant, so a time without a zone is taken in the session's."""
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def newest(beats: DataFrame) -> DataFrame:
    """By job the newest state, phase and time, and how many there were. Works on streams (update mode) and tables."""
    last = F.struct("ts", "event_id")
    return beats.groupBy("job_id").agg(F.max("ts").alias("last_at"), F.max_by("state", last).alias("state"), F.max_by("percent", last).alias("percent"), F.count(F.lit(1)).alias("beats"))


def accepted(state: Column, has_result: Column) -> Column:
    """Once a result is there, only a completed heartbeat counts."""
    return ~has_result | (state == "completed")


def per_window(beats: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Heartbeats by event-time window and state, closed by a watermark."""
    rows = watermarked(beats, late) if beats.isStreaming else beats
    return rows.groupBy(F.window("ts", width), "state").agg(F.count(F.lit(1)).alias("beats")).select(F.col("window.start").alias("window_start"), "state", "beats")


def overdue(beats: DataFrame, now: Column, seconds: int = 45) -> DataFrame:
    """Jobs whose newest heartbeat is older than the timeout and not terminal."""
    return newest(beats).where((F.col("last_at") < now - F.expr(f"INTERVAL {seconds} SECONDS")) & ~is_terminal(F.col("state")))


def once(submissions: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first submission of each cache key within the watermark; on a table, of each key at all."""
    if submissions.isStreaming:
        return watermarked(submissions, late).dropDuplicatesWithinWatermark(["cache_key"])
    return submissions.groupBy("cache_key").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


def timeouts(beats: DataFrame, seconds: int = 45) -> DataFrame:
    """A stream of (job_id, last_at, beats, expired) with a timer of event time for each job."""
    import pandas as pd

    def follow(key, frames, state):
        if state.hasTimedOut:
            last, n = state.get
            state.remove()
            yield pd.DataFrame({"job_id": [key[0]], "last_at": [last], "beats": [n], "expired": [True]})
            return
        last, n = state.get if state.exists else (pd.Timestamp.min, 0)
        for pdf in frames:
            last, n = max(last, pdf["ts"].max()), n + len(pdf)
        state.update((last, n))
        state.setTimeoutTimestamp(max(int(last.timestamp() * 1000) + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"job_id": [key[0]], "last_at": [last], "beats": [n], "expired": [False]})

    rows = watermarked(beats, f"{seconds} seconds").select("job_id", "ts")
    return rows.groupBy("job_id").applyInPandasWithState(follow, "job_id long, last_at timestamp, beats long, expired boolean", "last timestamp, n long", "append", "EventTimeTimeout")


def into_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Runs over what is there and ends."""
    return stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_batches(stream: DataFrame, apply, checkpoint: str, mode: str = "update"):
    """Hands each micro-batch to apply(batch, id), once."""
    return stream.writeStream.outputMode(mode).foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
