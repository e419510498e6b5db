"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks of words.

Sizes are counted once and written. Source totals give targets (weights shared out, held at a multiple of the source's
own size). The mix is then a number of equal blocks, which highest quotients target / (2 s + 1) hand to sources. A
source whose target is too small for STEPS blocks a shard is served by smaller ones, halved until it isn't, beside the others
of its block size; so a tiny source does not shrink the blocks of large ones. In the same way a source's blocks go to
its wards of WARD shards, and a ward's to its shards, so a source that holds a third of all rows is many shards, and no
task sees more than a ward's list of them. Within a shard
documents lie end to end in a seeded order; a seeded permutation picks which of its blocks the quota takes. Blocks
are taken once more each whenever a quota exceeds the number of blocks.

Defined results: null text has size 0; the null source is a source of its own, last in order; documents of size 0
take 0 words; an empty table gives no rows; equal rows are documents of their own; quotients that tie go to the earlier
source, ward or shard; very long texts are counted whole and may lie in several blocks; columns but doc_id, text and
source are carried along by mixed(), whatever their names, and never read (n_chars follows the text, where it is).
Results depend on the seed and the rows, not on partitions or order.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.scratch import Scratch, bounded_batches, documents, unused

WEIGHTS, SHARE, MOST = (5, 2, 1), Fraction(3, 2), 2
#: Documents of a shard, on average, and shards of a ward.
SHARD_DOCS, WARD = 4096, 1024
#: No block is larger; a source's blocks are halved until its target holds STEPS of them for each shard.
BLOCK_WORDS, STEPS = 4096, 256
#: Sources whose row is broadcast, each a few dozen bytes; more are joined by shuffle.
BROADCAST_SOURCES = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, most: int = MOST) -> dict[str | None, Fraction]:
    """Exact targets: share of all words by weight, held at most times the source's size, the excess reshared until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] >= most * sizes[s] * total]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = Fraction(most * sizes[s])
        left -= sum(out[s] for s in over)
        free -= set(over)
    return out


def sainte_lague(weights: list[float], seats: int, caps: list[int]) -> list[int]:
    """seats by highest quotients weight / (2 s + 1), ties to the earlier; none above its cap. As many as the caps hold at most."""
    seats = min(seats, sum(c for c, w in zip(caps, weights) if w > 0))
    total = sum(weights)
    if seats <= 0 or total <= 0:
        return [0] * len(weights)
    w, c = np.array(weights, float), np.array(caps, np.float64)
    at_least = lambda q: np.minimum(c, np.floor((w / q + 1) / 2))  # noqa: E731  seats whose quotient is q or more
    low, high = 0.0, float(w.max()) * 1.01
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (low, mid) if at_least(mid).sum() <= seats else (mid, high)
    got = at_least(high).astype(np.int64).tolist()
    heap = [(-w / (2 * g + 1), i) for i, (w, g, c) in enumerate(zip(weights, got, caps)) if w > 0 and g < c]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * got[i] + 1), i))
    return got


def _mix(x: int) -> int:
    x = (x ^ (x >> 33)) * 0xFF51AFD7ED558CCD & (1 << 64) - 1
    x = (x ^ (x >> 33)) * 0xC4CEB9FE1A85EC53 & (1 << 64) - 1
    return x ^ (x >> 33)


def chosen(n_blocks: int, quota: int, seed: int) -> np.ndarray:
    """How often each block is taken: quota in all, spread evenly, the rest by a seeded permutation."""
    base, extra = divmod(quota, n_blocks)
    order = np.random.Generator(np.random.Philox(_mix(seed & (1 << 64) - 1))).permutation(n_blocks)
    return base + (np.argsort(order, kind="stable") < extra).astype(np.int64)


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def block_for(target: Fraction, block_words: int = BLOCK_WORDS) -> int:
    """The largest block of block_words halved some times that target holds STEPS of; 1 if none is."""
    block = block_words
    while block > 1 and target < STEPS * block:
        block //= 2
    return block


def apportion(sizes: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, most: int = MOST, shard_docs: int = SHARD_DOCS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """sizes: (row, source, size), row unique or equal rows alike -> row, source_size, target, taken, start, block, picks (the counts of the blocks it meets).

    One row for each source comes to the driver; everything by shard or document stays distributed.
    """
    spark = sizes.sparkSession
    totals = {r["source"]: (r["size"], r["n"]) for r in sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).toLocalIterator()}
    goal = targets({s: v[0] for s, v in totals.items()}, weights, share, most)
    order = sorted(totals, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    shards_of = {s: max(1, -(-totals[s][1] // shard_docs)) for s in order}
    blocks, quotas = {s: block_for(goal[s] / shards_of[s], block_words) for s in order}, {}
    for block in set(blocks.values()):
        own = [s for s in order if blocks[s] == block]
        seats = sainte_lague([float(goal[s]) for s in own], round(sum(goal[s] for s in own) / block), [most * (-(-totals[s][0] // block)) for s in own])
        quotas |= dict(zip(own, seats))
    plan = [(i, s, totals[s][0], float(goal[s]), quotas[s], blocks[s], shards_of[s]) for i, s in enumerate(order)]
    sources = spark.createDataFrame(plan, "sid int, s string, source_size long, target double, quota long, block long, shards int")
    sources = F.broadcast(sources) if len(plan) <= BROADCAST_SOURCES else sources
    placed = sizes.join(sources, F.col("source").eqNullSafe(F.col("s")), "inner").withColumn("seeded", F.xxhash64(F.lit(seed), "row", "size")).withColumn("shard", F.pmod(F.col("seeded"), F.col("shards")).cast("int"))

    def share_out(part: str):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(part).reset_index(drop=True)
            seats = sainte_lague(pdf["words"].astype(float).tolist(), int(pdf["quota"].iloc[0]), (most * pdf["blocks"]).tolist())
            return pdf[["sid", part]].assign(seats=np.array(seats, np.int64))

        return run

    shards = placed.groupBy("sid", "shard").agg(F.sum("size").alias("words"), F.first("quota").alias("quota"), F.first("block").alias("block"))
    shards = shards.withColumn("ward", F.floor(F.col("shard") / WARD).cast("int")).withColumn("blocks", F.ceil(F.col("words") / F.col("block")))
    wards = shards.groupBy("sid", "ward").agg(F.sum("words").alias("words"), F.sum("blocks").alias("blocks"), F.first("quota").alias("quota"))
    wards = wards.groupBy("sid").applyInPandas(share_out("ward"), "sid int, ward int, seats long").withColumnRenamed("seats", "quota")
    shards = shards.drop("quota").join(wards, ["sid", "ward"]).groupBy("sid", "ward").applyInPandas(share_out("shard"), "sid int, shard int, seats long").withColumnRenamed("seats", "shard_quota")

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["seeded", "no_row", "row", "size"]).reset_index(drop=True)
        size = pdf["size"].to_numpy(np.int64)
        end = np.cumsum(size)
        start, total, block = end - size, int(end[-1]), int(pdf["block"].iloc[0])
        taken, picks = np.zeros(len(pdf), np.int64), [[]] * len(pdf)
        if total:
            times = chosen(-(-total // block), int(pdf["shard_quota"].iloc[0]), seed * 1_000_003 + int(pdf["sid"].iloc[0]) * 7919 + int(pdf["shard"].iloc[0]))
            reached = np.concatenate([[0], np.cumsum(times * block)])  # words taken before each block, as if all were whole
            upto = lambda x: reached[x // block] + np.append(times, 0)[x // block] * (x % block)
            taken = upto(end) - upto(start)
            picks = [times[a // block : -(-b // block)].tolist() for a, b in zip(start, end)]
        return pd.DataFrame({"row": pdf["row"], "no_row": pdf["no_row"], "size": size, "source_size": pdf["source_size"], "target": pdf["target"], "taken": taken, "start": start % block, "block": block, "picks": picks})

    kind = dict(sizes.dtypes)["row"]
    out = f"row {kind}, no_row boolean, size long, source_size long, target double, taken long, start long, block long, picks array<long>"
    # A null among whole numbers would make pandas round them, so it goes as a flag.
    known = F.coalesce("row", F.lit("0").cast(kind)).alias("row")
    rows = placed.join(shards, ["sid", "shard"]).select("sid", "shard", "seeded", known, F.col("row").isNull().alias("no_row"), "size", "source_size", "target", "block", "shard_quota")
    return rows.groupBy("sid", "shard").applyInPandas(take, out).withColumn("row", F.when(~F.col("no_row"), F.col("row"))).drop("no_row")


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    sizes = Scratch(spark, "mixing").write(sized(documents(spark, sf_dir)).withColumnRenamed("doc_id", "row"), "sizes")
    return apportion(sizes).select(F.col("row").alias("doc_id"), "size", "source_size", "target", "taken")


def _spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where the words begin and end in the UTF-8 bytes."""
    data = np.frombuffer(text.encode(), np.uint8)
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def drawn(text: str, start: int, block: int, picks: list[int]) -> str:
    """The words that the mix takes: all of the text while every block is taken, then what is taken once more."""
    first, last = _spans(text)
    n, data, parts = len(first), text.encode(), []
    for turn in range(1, max(picks, default=0) + 1):
        if all(p >= turn for p in picks):
            parts.append(text)
            continue
        runs: list[list[int]] = []
        for i, p in enumerate(picks):
            a, b = max(0, i * block - start), min(n, (i + 1) * block - start)
            if p >= turn and a < b:
                if runs and runs[-1][1] == a:
                    runs[-1][1] = b
                else:
                    runs.append([a, b])
        parts += [data[first[a] : last[b - 1]].decode() for a, b in runs]
    return "\n".join(parts)


def mixed(docs: DataFrame, seed: int = 0) -> DataFrame:
    """docs as the mix takes them: text holds the words taken, repeats after a line break; documents of which none is taken go.

    A row is known by a hash of what it says, and equal rows by a number, so texts are shuffled once, by that hash.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")  # rows numbered by a key are joined by it and their number where they are
    scratch = Scratch(spark, "mixed")
    row, nth, start, block, picks = unused(docs.columns, "row", "nth", "start", "block", "picks")
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x00"))
    named = docs.withColumn(row, F.sha2(F.concat_ws("\x1f", own("doc_id"), own("source"), own("text")), 256))
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sizes = scratch.write(named.select(F.col(row).alias("row"), F.col("source").cast("string").alias("source"), words.alias("size")), "sizes")
    took = apportion(sizes, seed).where("taken > 0").select(F.col("row").alias(row), F.col("start").alias(start), F.col("block").alias(block), F.col("picks").alias(picks))
    number = lambda by: F.row_number().over(Window.partitionBy(row).orderBy(by))
    joined = named.withColumn(nth, number("doc_id")).join(took.withColumn(nth, number(picks)), [row, nth]).drop(row, nth)
    keep, at = docs.columns, joined.columns.index("text")
    counts = [i for i, c in enumerate(keep) if c == "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i) for i in range(len(keep))]
            lists = (batch.column(len(keep) + i).to_pylist() for i in range(3))
            texts = [drawn(t.as_py(), *x) for t, *x in zip(batch.column(at), *lists)]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            for i in counts:
                columns[i] = pa.array([len(t) for t in texts], batch.schema.field(i).type)
            yield pa.RecordBatch.from_arrays(columns, names=keep)

    return joined.mapInArrow(run, docs.schema)
