"""From raw documents to packed training sequences: language ID, line dedup, near dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. A stage's result is written and
read again as the next one's docs, so a lost executor costs no earlier stage.

Defined results of every stage: null or empty texts, very long ones (read whole), ties and rows that repeat a doc_id are
treated as the stage's operator says in its docstring; a document with a null doc_id goes through all stages, keeps all
its lines and is no near duplicate; documents that repeat a doc_id go or stay together in the near stage, each with its
own text elsewhere; all columns, whatever their names, come through every stage but the last; an empty table gives an
empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import language, line_dedup, mixing, near_dedup, packing
from lodestone.llm.scratch import Scratch, bounded_batches, documents, unused


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no language that could be learned, go."""
    return language.identified(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more hold stay in the last of them only; n_chars follows the text."""
    clean = line_dedup.dedup_lines(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def keep_one_of_a_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group of near duplicates, the one with the smallest doc_id. Shingles are of five words."""
    bounded_batches(spark)
    found = Scratch(spark, "kept").write(near_dedup.near_duplicates(docs, words=5), "kept")
    (gone_id,) = unused(docs.columns, "gone")
    gone = found.where("NOT kept").select(F.col("doc_id").alias(gone_id)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(gone_id), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts as the mix takes them: blocks not taken are cut out, blocks taken twice stand twice."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language", keep_known_languages),
    ("lines", drop_repeated_lines),
    ("near", keep_one_of_a_group),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained filters, MinHash and tokenizers have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = documents(spark, sf_dir), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
