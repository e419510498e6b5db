"""A folder of requests as a stream: each file is claimed once, and what was taken stays taken over restarts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def requests(spark: SparkSession, folder: str, schema: str, per_trigger: int = 64) -> DataFrame:
    """JSON requests as files come into the folder, per_trigger files at a time; a broken one has its text in _corrupt_record. Writers move finished files in, so none is read half-written."""
    rows = spark.readStream.schema(schema + ", _corrupt_record string").option("maxFilesPerTrigger", per_trigger).json(folder)
    return rows.withColumn("spool_file", F.col("_metadata.file_name"))


def consume(stream: DataFrame, answer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Answers what is there and ends. The checkpoint holds which files were claimed; a batch that is run again after a loss overwrites its own folder, so no answer stands twice."""

    def one(batch: DataFrame, number: int) -> None:
        answer(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
