"""What the operators share: written tables, bounded Arrow batches, names that no column has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.sources.scratch import Scratch, shared_dir

__all__ = ["Scratch", "bounded_batches", "documents", "shared_dir", "unused"]


def bounded_batches(spark: SparkSession, records: int = 1000, megabytes: int = 16) -> None:
    """Bounds what one Arrow batch holds, so that a worker's memory does not follow the length of documents."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


def unused(columns: list[str], *names: str) -> list[str]:
    """For each name one like it that no column has, in any case of letters."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        name = f"_{name}"
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
