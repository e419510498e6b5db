"""Chunks kept by content, so that only texts that were never cut are cut.

A snapshot names the files of a corpus and the key of each one's content. Pieces belong to a key, not to a path: a file
that moved, came back or has a copy is not cut again. Snapshots are appended by turns. A turn writes the pieces of keys
that no turn before it has, then its snapshot; a turn that is written again replaces itself.

Defined results: a null or empty content has a key and no pieces; of rows that repeat a path the one with the largest key
counts; null paths are left out; equal contents in one language are one key, in two languages two.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.chunking import chunk_record_v2, markers_of, region_windows, split_bytes

PIECES = "line_start int, line_end int, segment int, symbol string, content string"


def source_pieces(files: DataFrame) -> DataFrame:
    """The default way to cut: regions that declarations begin, overlapping windows, the byte limit."""
    marked = files.withColumn("_markers", markers_of(F.col("content"), F.col("language")))
    return split_bytes(region_windows(marked, "_markers").drop("_markers"))


@dataclass
class ChunkStore:
    """rules: names the way of cutting; other rules, other keys."""

    spark: SparkSession
    folder: str
    cut: Callable[[DataFrame], DataFrame] = source_pieces
    rules: str = "regions-1"

    def read(self, table: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema + ", turn int").parquet(f"{self.folder}/{table}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema + ", turn int")

    def pieces(self) -> DataFrame:
        return self.read("pieces", f"key string, {PIECES}")

    def cut_keys(self) -> DataFrame:
        """(key, turn) of every content that was cut, with or without pieces."""
        return self.read("keys", "key string")

    def snapshot(self, turn: int) -> DataFrame:
        """(path, language, key, first): first where this turn was the first to have the key."""
        return self.read("snapshots", "path string, language string, key string, first boolean").where(F.col("turn") == turn).drop("turn")

    def key(self) -> Column:
        return F.sha2(F.concat_ws("\x00", F.lit(self.rules), F.coalesce("language", F.lit("")), F.coalesce("content", F.lit(""))), 256)

    def add(self, files: DataFrame, turn: int) -> None:
        """files (path, language, content): the whole corpus as it is now. Texts are hashed in the scan, and only those of new keys are shuffled and cut, each once."""
        keyed = files.where("path IS NOT NULL").select("path", F.col("language").cast("string").alias("language"), F.col("content").cast("string").alias("content"), self.key().alias("key"))
        listed = keyed.groupBy("path").agg(F.max(F.struct("key", "language")).alias("f")).select("path", "f.key", "f.language")
        before = self.cut_keys().where(F.col("turn") < turn).select("key").distinct().withColumn("_had", F.lit(True))
        listed = listed.join(before, "key", "left").select("path", "language", "key", F.col("_had").isNull().alias("first"))
        listed.write.mode("overwrite").parquet(f"{self.folder}/listed/turn={turn}")
        listed = self.read("listed", "path string, language string, key string, first boolean").where(F.col("turn") == turn).drop("turn")
        new = listed.where("first").select("key").distinct()
        fresh = keyed.join(new, "key", "left_semi").groupBy("key", "language").agg(F.first("content").alias("content"))
        names = [c.split()[0] for c in PIECES.split(", ")]
        cut = self.cut(fresh.withColumn("path", F.col("key")))
        cut = cut.withColumns({c: F.lit(0) if c == "segment" else F.lit("") for c in ("segment", "symbol") if c not in cut.columns})
        typed = [F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in PIECES.split(", ")]
        cut.select("key", *typed).select("key", *names).write.mode("overwrite").parquet(f"{self.folder}/pieces/turn={turn}")
        new.write.mode("overwrite").parquet(f"{self.folder}/keys/turn={turn}")
        listed.write.mode("overwrite").parquet(f"{self.folder}/snapshots/turn={turn}")

    def chunks(self, turn: int, namespace: str = "") -> DataFrame:
        """The chunks of a snapshot, with their ids; what is read of a piece is by its key."""
        rows = self.snapshot(turn).select("path", "language", "key").join(self.pieces().drop("turn"), "key")
        return chunk_record_v2(rows, namespace)

    def reuse(self, turn: int) -> DataFrame:
        """One row: files of a snapshot, contents that were cut in this turn and contents that were taken as they were."""
        distinct = lambda test: F.count_distinct(F.when(test, F.col("key")))
        return self.snapshot(turn).agg(F.count(F.lit(1)).alias("files"), distinct(F.col("first")).alias("cut"), distinct(~F.col("first")).alias("reused"))

    def changes(self, old: int, new: int) -> DataFrame:
        """(path, change) between two snapshots: added, changed, removed, same."""
        from lodestone.operators.incremental import diff

        return diff(self.snapshot(old), self.snapshot(new), "path", "key")
