"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Each n-gram that a text contains counts its log-count ratio: how much likelier toxic documents are to contain it. A
logistic regression weighs these scaled features. It is taught on a bounded sample of labelled rows (teach_toxic and
teach_clean are the bounds), drawn by a hash of doc_id, and its intercept is set back to the share of toxic labels
among all. Counting runs on the executors over hashed n-grams; the driver gets FEATURES n-grams and their
weights; the regression itself is one task over the bounded sample. Scoring reads every text whole.

Defined results: null or empty text scores what the intercept gives; without labels of both kinds the score is the
share of toxic labels, 0 if there are none; a document labelled more than once is toxic if any label says so; null
labels don't count; a null doc_id is scored, not held out and never taught; rows that repeat a doc_id are scored each;
n-grams that tie for the last feature are taken by bucket; very long texts are read whole, a slice at a time; empty
tables give no rows; other columns, whatever their names, are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.language import STEP, Alphabet
from lodestone.llm.scratch import Scratch, bounded_batches, documents
from lodestone.llm.words import mix64

ORDERS, BUCKET_BITS, FEATURES, LEAST_Z = (4, 6, 8), 20, 4096, 4.0
BUCKETS = 1 << BUCKET_BITS
TEACH_TOXIC, TEACH_CLEAN = 4000, 12000
THRESHOLD = 0.7


def buckets(c: np.ndarray, orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    """The hashed n-grams of all orders, repeats included. An n-gram's hash grows from that of the one before it."""
    out = []
    h = np.zeros(len(c), np.uint64)
    for n in range(1, max(orders) + 1):
        if n > len(c):
            break
        h = h[: len(c) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :] + np.uint64(1)
        if n in orders:
            out.append((mix64(h + np.uint64(n)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def present(c: np.ndarray, table: np.ndarray | None, orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    """The distinct buckets of a text; with a table, the distinct features that it gives them."""
    found = []
    for lo in range(0, max(1, len(c)), STEP):
        b = buckets(c[lo : lo + STEP + max(orders) - 1], orders)
        if table is not None:
            b = table[b]
            b = b[b >= 0]
        found.append(np.unique(b))
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


@dataclass
class ToxicityModel:
    #: The feature of each bucket, or -1.
    table: np.ndarray = field(default_factory=lambda: np.full(BUCKETS, -1, np.int16))
    ratios: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    intercept: float = -np.inf

    def score(self, c: np.ndarray) -> float:
        f = present(c, self.table)
        s = float((self.ratios[f] * self.weights[f]).sum()) + self.intercept
        return 0.0 if s < -700 else 1.0 / (1.0 + np.exp(-s))


def fit(rows: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, turns: int = 300, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on scaled features by Adam over the whole sample."""
    n, k = len(rows), len(ratios)
    col = np.concatenate(rows).astype(np.int32)
    row = np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows])
    x, w, b = ratios[col], np.zeros(k), float(np.log(y.mean() / (1 - y.mean())))
    m, v = np.zeros(k), np.zeros(k)
    for t in range(1, turns + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, x * w[col], n) + b, -30, 30)))
        g = (p - y) / n
        grad = np.bincount(col, x * g[row], k) + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= 0.5 * float(g.sum())
    return w, b


def held_out() -> Column:
    """Documents never taught from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def teach(docs: DataFrame, labels: DataFrame, teach_toxic: int = TEACH_TOXIC, teach_clean: int = TEACH_CLEAN) -> ToxicityModel:
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().toLocalIterator()}
    total = sum(counts.values())
    model = ToxicityModel()
    if len(counts) < 2:
        model.intercept = np.inf if counts.get(1) else -np.inf
        return model
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    part = F.when(F.col("toxic") == 1, min(1.0, teach_toxic / counts[1])).otherwise(min(1.0, teach_clean / counts[0]))
    drawn = known.where(draw < part).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # The sample is bounded by teach_toxic + teach_clean rows of 12 bytes, give or take the draw.
    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = Scratch(spark, "toxicity").write(texts.join(F.broadcast(drawn), "doc_id"), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet = Alphabet()
        seen = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                seen[toxic, present(alphabet(text.as_py()), None)] += 1
        at = np.flatnonzero(seen.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[0, at]), pa.array(seen[1, at])], names=["bucket", "clean", "toxic"])

    found = sample.select("text", "toxic").mapInArrow(count, "bucket int, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().toLocalIterator()}
    if len(sizes) < 2:
        model.intercept = float(np.log(counts[1] / counts[0]))
        return model
    pos, neg = sizes[1], sizes[0]
    share = (F.col("toxic") + F.col("clean") + 1) / (pos + neg + 2)
    z = F.abs(F.col("toxic") / pos - F.col("clean") / neg) / F.sqrt(share * (1 - share) * (1 / pos + 1 / neg))
    best = found.where("clean + toxic > 2").withColumn("z", z).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "bucket").limit(FEATURES).toPandas()
    model.table[best["bucket"].to_numpy()] = np.arange(len(best), dtype=np.int16)
    model.ratios = np.log(((best["toxic"].to_numpy(float) + 1) / (pos + 2)) / ((best["clean"].to_numpy(float) + 1) / (neg + 2)))
    table, ratios = model.table, model.ratios

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet = Alphabet()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([present(alphabet(t.as_py()), table).astype(np.int16).tobytes() for t in batch.column(2)], pa.binary())], names=["doc_id", "toxic", "features"])

    def weigh(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "toxic", "features"])
        w, b = fit([np.frombuffer(f, np.int16) for f in pdf["features"]], pdf["toxic"].to_numpy(float), ratios)
        return pd.DataFrame({"weights": [w.tobytes()], "intercept": [b]})

    # One task holds the whole sample, which teach_toxic + teach_clean bound: two bytes for each feature of a document.
    taught = sample.select("doc_id", "toxic", "text").mapInArrow(chosen, "doc_id long, toxic int, features binary")
    fitted = taught.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(weigh, "weights binary, intercept double").first()
    model.weights, b = np.frombuffer(fitted["weights"]), fitted["intercept"]
    model.intercept = b + float(np.log(counts[1] / counts[0]) - np.log(pos / neg))
    return model


def score(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet = Alphabet()
        for batch in batches:
            s = np.array([model.score(alphabet(t.as_py() or "")) for t in batch.column(1)], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = documents(spark, sf_dir)
    model = teach(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
