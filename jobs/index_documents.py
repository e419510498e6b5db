"""Keeps a table of chunks and a full-text index of a growing folder of documents.

    spark-submit jobs/index_documents.py --source DIR --target DIR --checkpoint DIR [--config FILE]

The source is a stream of Parquet files (doc_id, text, lang, source), of which each run takes those that came since the
last one; the stream's checkpoint says which. A micro-batch is one turn. A document that comes again is cut anew only
if it changed, and then its earlier chunks are out of date. The target has, by turn:

- chunks: the chunks of new and changed documents, a folder for each language;
- index: the full-text index of these chunks, see lodestone.operators.lexical_index;
- documents: the digest of each new or changed document. It is written last: a turn that it does not name is not read.

A turn is a function of its files and of earlier turns, and overwrites its own folders, so a batch that runs again
after a loss, or a run without new files, leaves the same tables.

Rows without a doc_id are counted and left out. Null texts are empty and have no chunks. Of rows that share a doc_id
in one turn the one of the newest file counts, among equals that of the largest digest.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, config_of, log, table_at
from lodestone.operators.chunking import fixed_windows
from lodestone.operators.lexical_index import LexicalIndex
from lodestone.sources import files

SOURCE = "doc_id long, text string, lang string, source string"
DOCUMENTS = "doc_id long, digest string, turn int"
CHUNKS = "doc_id long, path string, lang string, chunk_id string, chunk_hash string, line_start int, line_end int, token_estimate int, content string, turn int, language string"
FIELDS = ["path", "content"]


def known(spark: SparkSession, target: str, before: int | None = None) -> DataFrame:
    """(doc_id, digest, turn): the newest turn of each document, of turns before one."""
    rows = table_at(spark, f"{target}/documents", DOCUMENTS)
    rows = rows if before is None else rows.where(F.col("turn") < before)
    return rows.groupBy("doc_id").agg(F.max_by("digest", "turn").alias("digest"), F.max("turn").alias("turn"))


def current_chunks(spark: SparkSession, target: str) -> DataFrame:
    """The chunks that are up to date."""
    return table_at(spark, f"{target}/chunks", CHUNKS).join(known(spark, target).select("doc_id", "turn"), ["doc_id", "turn"], "left_semi")


def index_at(spark: SparkSession, target: str, config: dict) -> LexicalIndex:
    return LexicalIndex(spark, f"{target}/index", FIELDS, config["buckets"])


def take_turn(batch: DataFrame, turn: int, target: str, config: dict) -> None:
    """Writes what one micro-batch brings."""
    spark = batch.sparkSession
    rows = batch.where("doc_id IS NOT NULL").withColumn("digest", F.sha2(F.to_json(F.struct("text", "lang", "source"), {"ignoreNullFields": "false"}), 256))
    newest = rows.groupBy("doc_id").agg(F.max(F.struct("seen", "digest")).alias("n")).select("doc_id", F.col("n.digest").alias("digest"))
    changed = newest.join(known(spark, target, turn), ["doc_id", "digest"], "left_anti").persist()  # ids and digests, no texts
    try:
        path = F.concat(F.coalesce("source", F.lit("unknown")), F.lit("/"), "doc_id")
        docs = rows.join(changed, ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"])
        docs = docs.select("doc_id", "lang", path.alias("path"), F.lit("document").alias("input_type"), F.coalesce("text", F.lit("")).alias("content"))
        cut = fixed_windows(docs, config["window_lines"]).withColumn("language", F.coalesce(F.nullif("lang", F.lit("")), F.lit("und")))
        cut = cut.withColumn("line_start", F.col("line_start").cast("int")).withColumn("line_end", F.col("line_end").cast("int"))
        names = [c.split()[0] for c in CHUNKS.split(", ") if not c.startswith("turn ")]
        cut.select(names).hint("rebalance", "language").write.mode("overwrite").partitionBy("language").parquet(f"{target}/chunks/turn={turn}")
        chunks = table_at(spark, f"{target}/chunks", CHUNKS).where(F.col("turn") == turn)
        owner = F.col("doc_id").cast("string").alias("owner")
        units = chunks.select(F.concat_ws("#", "doc_id", "line_start").alias("id"), owner, *FIELDS)
        index_at(spark, target, config).add(units, turn, changed.select(owner))
        changed.select("doc_id", "digest").write.mode("overwrite").parquet(f"{target}/documents/turn={turn}")
        log.info("turn %d: read %d rows, %d of them with a doc_id; wrote %d new or changed documents in %d chunks", turn, batch.count(), rows.count(), changed.count(), chunks.count())
    finally:
        changed.unpersist()


def run(spark: SparkSession, source: str, target: str, checkpoint: str, config: dict | None = None) -> DataFrame:
    """Takes what is new in source into target and returns the chunks that are up to date, with their words in the index."""
    config = config_of("index_documents", config)
    stream = files.stream(spark, source, SOURCE, config["files_per_turn"]).withColumn("seen", F.col("_metadata.file_modification_time"))
    query = stream.writeStream.foreachBatch(lambda batch, turn: take_turn(batch, turn, target, config)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("source %s: %d turns in this run; target %s", source, sum(p["numInputRows"] > 0 for p in query.recentProgress), target)
    chunks = current_chunks(spark, target)
    words = index_at(spark, target, config).live_units().select(F.col("id").alias("unit"), F.col("length").alias("n_words"))
    return chunks.join(words, F.concat_ws("#", "doc_id", "line_start") == F.col("unit"), "left").drop("unit")


if __name__ == "__main__":
    command_line("index_documents", ["source", "target", "checkpoint"], run)
