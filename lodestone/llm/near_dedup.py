"""Near-duplicate detection by circulant MinHash, with every link confirmed on full sets.

One permutation scatters the shingles of a document, a second one, shifted circularly by 1, 2, ... K places, gives
the K coordinates of its signature. Bands of coordinates make buckets. No bucket is ever expanded into its pairs:

1. Documents with equal sets are one class, and only its smallest doc_id goes on.
2. In each bucket every member is held against one hub, the smallest; confirmed pairs are links.
3. Buckets whose members are then still in different components go on. Members that share too few shingles with any
   other such document to reach the threshold leave. What lies outside a bucket's largest component is held against
   the whole bucket, where intersections with all members are counted at once, and only links that join components
   come out. A bucket is one group while it is small; a larger one is dealt into tiles of its members by tiles of
   those outside its largest component, so a bucket that is one family but for a few is copied only for those.

So all pairs that share a bucket are confirmed, excluded by a bound, or already in one component. A pair at the
threshold misses all buckets with probability (1 - t^r)^b, 1.2e-7 for the defaults at 0.8, if coordinates were
independent; tests measure it on pairs of similarity 0.80 to 0.85.

Defined results: null or blank text has an empty set and stands alone; a null doc_id stands alone, with a null
component, and is kept; rows that repeat a doc_id are one document (a link of either is a link of both); a text of one
word is one shingle; very long texts are read whole; where similarities tie nothing is chosen, as all links count, and
the smallest doc_id stays; an empty table gives no rows; columns but doc_id and text are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.scratch import Scratch, bounded_batches, documents
from lodestone.llm.words import WordHasher, mix64, shingle_set

#: Words of a shingle, threshold in hundredths, bands, coordinates of a band.
WORDS, PERCENT, BANDS, ROWS = 2, 80, 40, 5
#: Members and shingles of a tile, about.
TILE, TILE_SHINGLES = 4096, 4_000_000
#: Ids that are broadcast, 8 MB, after they are counted; more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def second_permutation(y: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit words, in place."""
    y ^= y >> np.uint32(16)
    y *= np.uint32(0x85EBCA6B)
    y ^= y >> np.uint32(13)
    y *= np.uint32(0xC2B2AE35)
    y ^= y >> np.uint32(16)
    return y


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """The circulant MinHash of a set: coordinate k is the least of the second permutation, shifted by k, of what the first one makes of it."""
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    first = (mix64(shingles ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
    shift = np.arange(1, size + 1, dtype=np.uint32)[:, None]
    for lo in range(0, len(first), 256):
        np.minimum(out, second_permutation(first[None, lo : lo + 256] + shift).min(1), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    h = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for r in range(rows):
        h = mix64(h + sig[r : bands * rows : rows].astype(np.uint64))
    return h.view(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def signatures(docs: DataFrame, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n, digest, bands); digest is of the full set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hasher = WordHasher()
        for batch in batches:
            n, digest, keys = [], [], []
            for t in batch.column(1):
                s = shingle_set(hasher((t.as_py() or "").encode("utf-8", "surrogatepass")), words)
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys.append(band_keys(signature(s, bands * rows), bands, rows) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n", "digest", "bands"])

    return _texts(docs).mapInArrow(run, "doc_id long, n long, digest binary, bands array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, count: int, words: int = WORDS) -> DataFrame:
    """(id, n, shingles) of the documents in wanted, a table of count ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            sets = [(i, shingle_set(hasher((t.as_py() or "").encode("utf-8", "surrogatepass")), words)) for i, t in zip(batch.column(0).to_pylist(), batch.column(1))]
            sets = [(i, s) for i, s in sets if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in sets], pa.int64()), pa.array([len(s) for _, s in sets], pa.int64()), pa.array([s.tobytes() for _, s in sets], pa.binary())], names=["id", "n", "shingles"])

    ids = wanted.select(F.col("id").alias("doc_id"))
    return _texts(docs).join(F.broadcast(ids) if count <= BROADCAST_IDS else ids, "doc_id", "left_semi").mapInArrow(run, "id long, n long, shingles binary")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def alike(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """percent or more of the union is common; both sorted and distinct."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = _common(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets are alike."""
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("set_b"))
    sizes = F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    both = pairs.join(left, "a").join(right, "b").where(sizes).select("a", "b", "set_a", "set_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [alike(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in zip(batch.column(2), batch.column(3))]
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """links (a, b) -> (id, component): the smallest id reachable, for every id in a link. Alternating large and small stars; each turn is written, so no plan grows."""
    stars = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    stars = scratch.write(stars, f"{name}-0")
    before, turn = None, 0
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        turn += 1
        stars = scratch.write(small, f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    tops = stars.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return stars.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(tops)


def _tile_links(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links that join components, between the members marked probe and all members of a tile."""
    ids, n, probe = pdf["id"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), pdf["probe"].to_numpy(bool)
    label = pdf["component"].to_numpy(np.int64).copy()
    token = np.unique(np.frombuffer(b"".join(pdf["shingles"]), np.uint64), return_inverse=True)[1]
    start = np.cumsum(n) - n
    mark, found = np.zeros(int(token.max()) + 1, bool), []
    for y in np.flatnonzero(probe).tolist():
        own = token[start[y] : start[y] + n[y]]
        like = (label != label[y]) & (100 * np.minimum(n, n[y]) >= percent * np.maximum(n, n[y]))
        if not like.any():
            continue
        mark[own] = True
        common = np.add.reduceat(mark[token], start)
        mark[own] = False
        like &= 100 * common >= percent * (n + n[y] - common)
        for x in np.flatnonzero(like).tolist():
            if label[x] != label[y]:
                label[label == max(label[x], label[y])] = min(label[x], label[y])
                found.append((ids[y], ids[x]))
    return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)


def _tiles(viable: DataFrame, tile: int, tile_shingles: int) -> DataFrame:
    """viable: (bkey, id, component, n) of split buckets -> (bkey, i, j, id, component, probe): members in row i, those outside the largest component, the probes, in column j."""
    parts = viable.groupBy("bkey", "component").agg(F.count(F.lit(1)).alias("many"), F.sum("n").alias("n"))
    of_bucket = parts.groupBy("bkey").agg(F.max(F.struct("many", "n", "component")).alias("most"), F.sum("many").alias("many"), F.sum("n").alias("n"))
    count = lambda many, n: F.ceil(F.greatest(many / tile, n / tile_shingles, F.lit(1))).cast("int")
    of_bucket = of_bucket.select("bkey", F.col("most.component").alias("major"), count(F.col("many"), F.col("n")).alias("rows"), count(F.col("many") - F.col("most.many"), F.col("n") - F.col("most.n")).alias("columns"))
    own = lambda tiles: F.pmod(F.xxhash64("id"), F.col(tiles)).cast("int")
    place = lambda i, j, probe: F.struct(i.alias("i"), j.alias("j"), probe.alias("probe"))
    minor = F.col("component") != F.col("major")
    as_member = F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda j: place(own("rows"), j, F.lit(False)))
    as_probe = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda i: place(i, own("columns"), F.lit(True)))
    places = F.when(F.col("rows") == 1, F.array(place(F.lit(0), F.lit(0), minor))).when(minor, F.concat(as_member, as_probe)).otherwise(as_member)
    return viable.join(of_bucket, "bkey").select("bkey", "id", "component", F.explode(places).alias("at")).select("bkey", "at.*", "id", "component")


def near_links(docs: DataFrame, scratch: Scratch, words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, tile: int = TILE, tile_shingles: int = TILE_SHINGLES) -> tuple[DataFrame, DataFrame]:
    """(rows (doc_id, n, representative), components (id, component) of representatives)."""
    sig = scratch.write(signatures(docs, words, bands, rows), "signatures")
    real = sig.where("doc_id IS NOT NULL AND n > 0")
    classes = scratch.write(real.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    represented = scratch.write(sig.select("doc_id", "n", "digest").join(classes, "digest", "left").select("doc_id", "n", "rep"), "represented")
    narrow = real.select("doc_id", "digest")
    again = narrow.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("doc_id")
    same = scratch.write(narrow.join(again, "doc_id").join(classes, "digest").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), "same")
    own = real.join(classes.withColumnRenamed("rep", "doc_id"), ["digest", "doc_id"], "left_semi").select(F.col("doc_id").alias("id"), "bands")
    own = scratch.write(own, "own")
    scratch.drop("signatures")
    exploded = own.select("id", F.explode("bands").alias("bkey"))
    hubs = exploded.groupBy("bkey").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub <> last").select("bkey", "hub")
    members = scratch.write(exploded.join(hubs, "bkey"), "members")  # of buckets of more than one
    scratch.drop("own")

    pairs = scratch.write(members.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    wanted = scratch.write(members.select("id").distinct(), "wanted")
    sets = scratch.write(full_sets(docs, wanted, wanted.count(), words), "sets")
    links = scratch.write(confirmed(pairs, sets, percent).unionByName(same), "links1")
    scratch.drop("pairs")
    first = scratch.write(components(links, scratch, "stars1"), "components1")

    placed = members.join(first, "id", "left").select("bkey", "id", F.coalesce("component", "id").alias("component"))
    split = placed.groupBy("bkey").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bkey")
    open_ = scratch.write(placed.join(split, "bkey"), "open")
    scratch.drop("members")
    mine = sets.join(open_.select("id").distinct(), "id", "left_semi")

    def shingles_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, s in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(s.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), i)), pa.array(x)], names=["id", "shingle"])

    alone = mine.select("id", "shingles").mapInArrow(shingles_of, "id long, shingle long").groupBy("shingle").agg(F.min("id").alias("id"), F.max("id").alias("last")).where("id = last")
    alone = alone.groupBy("id").agg(F.count(F.lit(1)).alias("alone"))
    # bound: how many shingles of a document others of the stage have, at most; a repeated id has those of all its rows.
    shared = mine.groupBy("id").agg(F.sum("n").alias("all")).join(alone, "id", "left").select("id", F.expr("all - coalesce(alone, 0)").alias("bound"))
    known = mine.join(shared, "id").select("id", "n", F.least("n", "bound").alias("bound"), "shingles").where(f"100 * bound >= {percent} * n")
    known = scratch.write(known, "known")
    scratch.drop("sets")
    viable = open_.join(known.groupBy("id").agg(F.min("n").alias("n"), F.max("n").alias("most"), F.max("bound").alias("bound")), "id")
    still = lambda df: df.groupBy("bkey").agg(F.min("n").alias("least"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bkey", "least")
    viable = viable.join(still(viable), "bkey").where(f"{100 + percent} * bound >= {percent} * (n + least)").drop("least")
    viable = scratch.write(viable.join(still(viable), "bkey").select("bkey", "id", "component", F.col("most").alias("n")), "viable")
    full = _tiles(viable, tile, tile_shingles).join(known.select("id", "n", "shingles"), "id")
    more = full.groupBy("bkey", "i", "j").applyInPandas(lambda pdf: _tile_links(pdf, percent), "a long, b long")
    more = scratch.write(more, "links2")
    for name in ("open", "known", "viable"):
        scratch.drop(name)
    return represented, scratch.write(components(links.unionByName(more), scratch, "stars2"), "components2")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, tile: int = TILE, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept)."""
    bounded_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "near")
    rows_, final = near_links(docs, scratch, words, percent, bands, rows, tile, tile_shingles)
    out = rows_.join(final, rows_["rep"] == final["id"], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.expr("doc_id IS NULL OR doc_id = component_id"))


def op10_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
