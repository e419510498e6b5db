"""Tables of records by version: what a store held at any time, read by Spark from a folder for each version.

A version holds the records that came or changed since the one before, and the keys that went. Reading takes the
newest of each key up to a version. A version is written once and readers name the newest they know, so they never see a
half-written one; a version that is written again replaces itself. Writers take turns: there is no lock here.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class VersionedTable:
    """schema: of the records; key: the column that names one."""

    spark: SparkSession
    folder: str
    schema: str
    key: str

    def put(self, rows: DataFrame, version: int, gone: DataFrame | None = None) -> None:
        """rows with the schema's columns, each key once; gone: a DataFrame of keys that went. A key that is in both came."""
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        out = rows.select(*names, F.lit(False).alias("gone"))
        if gone is not None:
            left = gone.select(self.key).distinct().join(rows.select(self.key), self.key, "left_anti").withColumn("gone", F.lit(True))
            out = out.unionByName(left, allowMissingColumns=True)
        out.write.mode("overwrite").parquet(f"{self.folder}/version={version}")

    def log(self) -> DataFrame:
        """All records of all versions."""
        schema = f"{self.schema}, gone boolean, version int"
        try:
            return self.spark.read.schema(schema).parquet(self.folder)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def as_of(self, version: int) -> DataFrame:
        """The records as they stood at a version. Later versions are not read; the newest of a key is an aggregate that combines before its shuffle."""
        rows = self.log().where(F.col("version") <= version)
        last = F.max_by(F.struct(*(c for c in rows.columns if c not in (self.key, "version"))), "version").alias("r")
        kept = rows.groupBy(self.key).agg(last, F.max("version").alias("version")).where("NOT r.gone")
        return kept.select(self.key, *(f"r.{c}" for c in rows.columns if c not in (self.key, "version", "gone")), "version")

    def changes(self, after: int, upto: int) -> DataFrame:
        """(key, change): what came, changed or went between two versions."""
        a, b = self.as_of(after).select(F.col(self.key).alias("_a"), F.col("version").alias("_va")), self.as_of(upto).select(F.col(self.key).alias("_b"), F.col("version").alias("_vb"))
        rows = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
        change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_va") != F.col("_vb"), "changed")
        return rows.select(F.coalesce("_b", "_a").alias(self.key), change.alias("change")).where("change IS NOT NULL")
