"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions. For each of the 255 prefixes of decisions there is a context tree, whose nodes are
the last 0, 1, ... DEPTH bytes before it. A node holds how often the decision went either way in the training texts;
its Krichevsky-Trofimov estimate and those of its descendants are mixed by their evidence, so every depth has a part
in each prediction. Contexts that were never seen end the path, and the deepest one seen speaks for them.

A text is scored as its words with single spaces between and a line break at the end, the same tokens that the base
score (words with add-one smoothing) has, so both are probabilities of the same event. Counts cover all training
documents.

No model is broadcast. Documents are put into blocks; a block asks for what its own texts need, each word and each
run of DEPTH + 1 bytes once, with its counts, as packed arrays by shard. A shard adds up counts over blocks, so a
word that every document has is one entry for each block, and gives back one number for each entry. Trees are dealt
by the three bytes next to the decision: two of them name a group, the third one of its SPLIT shards, so a frequent
pair of bytes is not one shard. Nodes of depth 2 are sums over a group's shards and go back to these alone; of the
levels above, 65,280 nodes at most go to the driver.

Defined results: null or blank text is the line break alone, one token; a null doc_id is scored, not held out and not
learned from; without training documents every decision has probability 1/2; an empty table gives no rows; rows that
repeat a doc_id are documents of their own; equal texts have equal scores, unless a block cuts their sums in another
order; a very long text is a block of its own, read whole; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.scratch import Scratch, bounded_batches, documents
from lodestone.llm.words import WordHasher, mix64

DEPTH = 5
#: Bytes of text in a block, about.
BLOCK = 8 << 20
SLICE = 1 << 20
END = np.uint64(0x9AE16A3B2F90404F)
TEXT, WORD, GRAM, TOTAL, TWO = 0, 1, 2, 3, 4
#: Shards that share the trees of one group of two-byte contexts; bytes of text for each shard, about.
SPLIT, SHARD_BYTES = 8, 16 << 20
ASKED = "block long, kind int, shard int, doc_ids array<string>, learned array<boolean>, held array<boolean>, sizes array<long>, words array<long>, payload binary, keys binary, counts binary"
TOLD = "block long, kind int, shard int, told binary"


def canonical(text: str | None) -> tuple[bytes, int]:
    """The words with single spaces between and a line break, and how many words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return b" ".join(words) + b"\n", len(words)


def gram_keys(stream: np.ndarray) -> np.ndarray:
    """For each byte from DEPTH on, it and the bytes before it, the nearest first: c1 c2 ... byte."""
    s = stream.astype(np.uint64)
    n = len(s) - DEPTH
    key = np.zeros(n, np.uint64)
    for back in range(1, DEPTH + 1):
        key = (key << np.uint64(8)) | s[DEPTH - back : DEPTH - back + n]
    return (key << np.uint64(8)) | s[DEPTH:]


def _grams(data: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, document) of the bytes to score, a slice at a time. Each document lies after DEPTH line breaks that are its first context."""
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    first = np.zeros(len(data), bool)
    starts = np.cumsum(sizes) - sizes
    for i in range(DEPTH):
        first[starts + i] = True
    for lo in range(DEPTH, len(data), SLICE):
        hi = min(lo + SLICE, len(data))
        keep = ~first[lo:hi]
        yield gram_keys(data[lo - DEPTH : hi])[keep], doc[lo:hi][keep]


def packed(numbers: np.ndarray, rising: bool = False) -> bytes:
    """Unsigned numbers, rising ones as their differences, their bytes by place, compressed."""
    import zstandard

    if rising:
        numbers = np.diff(numbers, prepend=numbers.dtype.type(0))
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), -1).T)
    return zstandard.ZstdCompressor(1).compress(planes.tobytes())


def unpacked(data: bytes, dtype: type, rising: bool = False) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    numbers = np.ascontiguousarray(planes.T).view(dtype).ravel()
    return np.cumsum(numbers, dtype=dtype) if rising else numbers


def _distinct(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and their summed counts."""
    keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)


def block_grams(data: np.ndarray, sizes: np.ndarray, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    parts = []
    for keys, doc in _grams(data, sizes):
        yes = learned[doc]
        taught, times = np.unique(keys[yes], return_counts=True)
        rest = np.unique(keys[~yes])
        parts += [(taught, times), (rest, np.zeros(len(rest), np.int64))]
    return _distinct(parts) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def block_words(hasher: WordHasher, payload: bytes, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all documents in order, END after each one's words, and which document each is of."""
    h = hasher(payload)
    doc = np.repeat(np.arange(len(words)), words)
    at = np.cumsum(words)
    return np.insert(h, at, END), np.insert(doc, at, np.arange(len(words)))


def word_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mix64(keys) % np.uint64(shards)).astype(np.int64)


def gram_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """By the two nearest bytes of context to a group, by the third to one of its SPLIT shards."""
    two, three = keys >> np.uint64(8 * (DEPTH - 1)), keys >> np.uint64(8 * (DEPTH - 2))
    return (mix64(two) % np.uint64(shards // SPLIT) * np.uint64(SPLIT) + mix64(three ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(SPLIT)).astype(np.int64)


def _dealt(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shard, kind="stable")
    found, first = np.unique(shard[order], return_index=True)
    yield from zip(found.tolist(), np.split(order, first[1:]))


def _log_kt(n0: np.ndarray, n1: np.ndarray, table: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _lgamma_half(n0, table) + _lgamma_half(n1, table) - _lgamma(n0 + n1 + 1) - math.log(math.pi)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """ln gamma for x >= 1/2: Stirling's series after eight steps up."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def _lgamma_half(n: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = _lgamma(np.maximum(n, len(table)) + 0.5)
    small = n < len(table)
    out[small] = table[n[small].astype(np.int64)]
    return out


class Nodes:
    """The nodes of one depth, sorted by context and prefix: counts, evidence, and the weight of stopping here."""

    def __init__(self, keys: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None):
        self.keys, self.n0, self.n1 = keys, n0, n1
        table = _lgamma(np.arange(256) + 0.5)
        own = _log_kt(n0, n1, table)
        self.weighted = own if below is None else np.logaddexp(own, below) - math.log(2)
        self.stop = np.ones(len(keys)) if below is None else np.exp(own - math.log(2) - self.weighted)

    def up(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What the next shorter contexts get: keys, counts and the evidence of what lies below."""
        keys, inverse = np.unique((self.keys >> np.uint64(16)) << np.uint64(8) | self.keys & np.uint64(255), return_inverse=True)
        return keys, *(np.bincount(inverse, x, len(keys)) for x in (self.n0, self.n1, self.weighted))

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each key is, and whether it is there at all."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys


def grow(keys: np.ndarray, counts: np.ndarray, least: int) -> list[Nodes]:
    """Nodes from depth DEPTH up to depth least of the contexts of these grams."""
    seen = counts > 0
    keys, counts = keys[seen], counts[seen].astype(float)
    symbol, context = keys & np.uint64(255), keys >> np.uint64(8) << np.uint64(8)
    nodes, bits = [], []
    for level in range(8):
        nodes.append(context | np.uint64(1 << level) | symbol >> np.uint64(8 - level) if level else context | np.uint64(1))
        bits.append(symbol >> np.uint64(7 - level) & np.uint64(1))
    node, bit, times = np.concatenate(nodes), np.concatenate(bits).astype(bool), np.tile(counts, 8)
    found, inverse = np.unique(node, return_inverse=True)
    out = [Nodes(found, np.bincount(inverse, times * ~bit, len(found)), np.bincount(inverse, times * bit, len(found)), None)]
    for _ in range(DEPTH - least):
        out.append(Nodes(*out[-1].up()))
    return out


def log10_probability(keys: np.ndarray, levels: list[Nodes]) -> np.ndarray:
    """Of the last byte of each gram after its context; levels from depth DEPTH to 0."""
    out = np.zeros(len(keys))
    symbol, context = keys & np.uint64(255), keys >> np.uint64(8)
    for level in range(8):
        prefix = np.uint64(1 << level) | (symbol >> np.uint64(8 - level) if level else np.uint64(0))
        one = (symbol >> np.uint64(7 - level) & np.uint64(1)).astype(bool)
        p = np.full(len(keys), 0.5)
        deeper = np.zeros(len(keys), bool)
        for back, nodes in enumerate(levels):
            at, seen = nodes.look(context >> np.uint64(8 * back) << np.uint64(8) | prefix)
            if not seen.any():
                continue
            own = (np.where(one, nodes.n1[at], nodes.n0[at]) + 0.5) / (nodes.n0[at] + nodes.n1[at] + 1)
            stop = nodes.stop[at]
            p = np.where(seen, np.where(deeper, stop * own + (1 - stop) * p, own), p)
            deeper |= seen
        out += np.log10(p)
    return out


def ask(docs: DataFrame, shards: int, block_bytes: int = BLOCK) -> DataFrame:
    """Blocks of canonical texts, and what each asks of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        part, turn, hasher, packer = TaskContext.get().partitionId(), 0, WordHasher(), zstandard.ZstdCompressor(3)
        types = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.bool_()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
        names = ["block", "kind", "shard", "doc_ids", "learned", "held", "sizes", "words", "payload", "keys", "counts"]

        def block(rows: list) -> Iterator[pa.RecordBatch]:
            payload = b"".join(r[3] for r in rows)
            sizes, words, learned = (np.array(x, np.int64) for x in ([len(r[3]) for r in rows], [r[4] for r in rows], [r[1] for r in rows]))
            learned = learned.astype(bool)
            number = (part << 32) + turn
            ids = [None if r[0] is None else str(r[0]) for r in rows]  # as text: a null among numbers would make pandas round them
            out = [(number, TEXT, 0, ids, learned.tolist(), [r[2] for r in rows], sizes.tolist(), words.tolist(), packer.compress(payload), None, None)]
            token, doc = block_words(hasher, payload, words)
            keys, inverse = np.unique(token, return_inverse=True)
            counts = np.bincount(inverse, learned[doc], len(keys)).astype(np.int64)
            for kind, keys, counts, shard_of in ((WORD, keys, counts, word_shard), (GRAM, *block_grams(np.frombuffer(payload, np.uint8), sizes, learned), gram_shard)):
                for shard, at in _dealt(shard_of(keys, shards)):
                    out.append((number, kind, shard, None, None, None, None, None, None, packed(keys[at], True), packed(counts[at].astype(np.uint32))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

        rows, size = [], 0
        for batch in batches:
            for doc_id, learned, held, text in zip(*(c.to_pylist() for c in batch.columns)):
                text, n = canonical(text)
                text = b"\n" * DEPTH + text
                if rows and size + len(text) > block_bytes:
                    yield from block(rows)
                    rows, size, turn = [], 0, turn + 1
                rows.append((doc_id, learned, held, text, n))
                size += len(text)
        if rows:
            yield from block(rows)

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("doc_id").isNotNull() & ~held).alias("learned"), held.alias("held"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, ASKED)


def _gathered(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys and summed counts of a shard; for each entry its key's place; where each row's entries end."""
    keys = [unpacked(k, np.uint64, True) for k in pdf["keys"]]
    counts = np.concatenate([unpacked(c, np.uint32) for c in pdf["counts"]])
    found, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(inverse, counts, len(found)), inverse, np.cumsum([len(k) for k in keys])


def _told(pdf: pd.DataFrame, kind: int, values: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"block": pdf["block"].to_numpy(), "kind": np.int32(kind), "shard": pdf["shard"].to_numpy(), "told": [packed(v) for v in np.split(values, ends[:-1])]})


def tell_words(pdf: pd.DataFrame) -> pd.DataFrame:
    """Each block's words with their counts over all blocks, and a row with the shard's tokens and distinct words."""
    _, total, inverse, ends = _gathered(pdf)
    out = _told(pdf, WORD, total[inverse].astype(np.int64), ends)
    sums = np.array([total.sum(), np.count_nonzero(total)], np.int64)
    return pd.concat([out, pd.DataFrame({"block": [-1], "kind": [TOTAL], "shard": pdf["shard"].iloc[:1].to_numpy(), "told": [sums.tobytes()]})], ignore_index=True)


def depth_two(pdf: pd.DataFrame) -> pd.DataFrame:
    """What the shard's trees give to depth 2."""
    keys, total, _, _ = _gathered(pdf)
    key, n0, n1, below = grow(keys, total, 3)[-1].up()
    return pd.DataFrame({"part": np.int32(pdf["shard"].iloc[0] // SPLIT), "node": key.astype(np.int64), "n0": n0, "n1": n1, "below": below})


def _nodes(rows: pd.DataFrame) -> Nodes:
    """Nodes from sums over shards."""
    rows = rows.sort_values("node")
    return Nodes(rows["node"].to_numpy(np.uint64), *(rows[c].to_numpy(float) for c in ("n0", "n1", "below")))


def depth_one(pdf: pd.DataFrame) -> pd.DataFrame:
    """What a group's nodes of depth 2 give to depth 1."""
    key, n0, n1, below = _nodes(pdf).up()
    return pd.DataFrame({"node": key.astype(np.int64), "n0": n0, "n1": n1, "below": below})


def in_each_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """A group's nodes of depth 2 as one row for each of its shards."""
    rows = pdf.sort_values("node")
    blob = b"".join(rows[c].to_numpy(t).tobytes() for c, t in (("node", np.int64), ("n0", float), ("n1", float), ("below", float)))
    return pd.DataFrame({"block": -1, "kind": np.int32(TWO), "shard": np.arange(SPLIT, dtype=np.int32) + np.int32(SPLIT * pdf["part"].iloc[0]), "keys": blob, "counts": None})


def _shared(blob: bytes) -> Nodes:
    n = len(blob) // 32
    return Nodes(np.frombuffer(blob, np.uint64, n), *(np.frombuffer(blob, float, n, 8 * n * i) for i in (1, 2, 3)))


def score_block(pdf: pd.DataFrame, tokens: int, distinct: int, shards: int) -> pd.DataFrame:
    import zstandard

    text = pdf[pdf.kind == TEXT].iloc[0]
    sizes, words = np.asarray(text["sizes"], np.int64), np.asarray(text["words"], np.int64)
    payload = zstandard.ZstdDecompressor().decompress(text["payload"])
    told = {(k, s): v for k, s, v in zip(pdf["kind"], pdf["shard"], pdf["told"])}

    def values(keys: np.ndarray, kind: int, shard: np.ndarray, dtype: type) -> np.ndarray:
        out = np.zeros(len(keys), dtype)
        for s, at in _dealt(shard):
            out[at] = unpacked(told[(kind, s)], dtype)
        return out

    n = len(sizes)
    token, doc = block_words(WordHasher(), payload, words)
    keys, inverse = np.unique(token, return_inverse=True)
    count = values(keys, WORD, word_shard(keys, shards), np.int64)[inverse]
    base = np.bincount(doc, np.log10(count + 1.0) - math.log10(tokens + distinct + 1), n)
    known = np.bincount(doc, count > 0, n).astype(np.int64)

    slices = []
    for k, d in _grams(np.frombuffer(payload, np.uint8), sizes):
        found, place = np.unique(k, return_inverse=True)
        slices.append((found, place.astype(np.int32), d))
    grams = np.unique(np.concatenate([found for found, _, _ in slices]))
    logs = values(grams, GRAM, gram_shard(grams, shards), np.float32).astype(np.float64)
    score = np.zeros(n)
    for found, place, d in slices:
        score += np.bincount(d, logs[np.searchsorted(grams, found)][place], n)
    ids = pd.array([None if i is None else int(i) for i in text["doc_ids"]], dtype="Int64")
    return pd.DataFrame({"doc_id": ids, "held_out": list(text["held"]), "n_tokens": words + 1, "n_known": known, "train_tokens": np.int64(tokens), "base_score": base, "score": score, "n_bytes": sizes - DEPTH, "bits_per_byte": -score / math.log10(2) / (sizes - DEPTH)})


def score_documents(docs: DataFrame, block_bytes: int = BLOCK, shards: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "ctw")
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards = SPLIT * max(1, shards or -(-size // (SPLIT * SHARD_BYTES)))
    asked = scratch.write(ask(docs, shards, block_bytes), "asked", **{"parquet.block.size": str(32 << 20)})
    keyed = asked.select("block", "kind", "shard", "keys", "counts")
    words = scratch.write(keyed.where(f"kind = {WORD}").groupBy("shard").applyInPandas(tell_words, TOLD), "words")
    sums = [np.frombuffer(r["told"], np.int64) for r in words.where(f"kind = {TOTAL}").select("told").toLocalIterator()]  # two numbers a shard
    tokens, distinct = (int(sum(int(s[i]) for s in sums)) for i in (0, 1))
    gram_rows = keyed.where(f"kind = {GRAM}")
    sums_of = [F.sum(c).alias(c) for c in ("n0", "n1", "below")]
    two = gram_rows.groupBy("shard").applyInPandas(depth_two, "part int, node long, n0 double, n1 double, below double").groupBy("part", "node").agg(*sums_of)
    two = scratch.write(two, "two")
    one = _nodes(two.groupBy("part").applyInPandas(depth_one, "node long, n0 double, n1 double, below double").groupBy("node").agg(*sums_of).toPandas())  # 65,280 nodes at most
    tops = [one, Nodes(*one.up())]
    shared = two.groupBy("part").applyInPandas(in_each_shard, "block long, kind int, shard int, keys binary, counts binary")

    def tell_grams(pdf: pd.DataFrame) -> pd.DataFrame:
        own, blobs = pdf[pdf["kind"] == GRAM], pdf.loc[pdf["kind"] == TWO, "keys"]
        if not len(own):
            return pd.DataFrame({"block": [], "kind": [], "shard": [], "told": []}).astype({"block": "int64", "kind": "int32", "shard": "int32"})
        keys, total, inverse, ends = _gathered(own)
        levels = grow(keys, total, 3) + [_shared(blobs.iloc[0] if len(blobs) else b"")] + tops
        return _told(own, GRAM, log10_probability(keys, levels).astype(np.float32)[inverse], ends)

    grams = gram_rows.unionByName(shared).groupBy("shard").applyInPandas(tell_grams, TOLD)
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("doc_ids", "array<string>"), ("held", "array<boolean>"), ("sizes", "array<long>"), ("words", "array<long>"), ("payload", "binary"))]
    texts = asked.where(f"kind = {TEXT}").select("block", "kind", "shard", F.lit(None).cast("binary").alias("told"), "doc_ids", "held", "sizes", "words", "payload")
    parts = texts.unionByName(words.where(f"kind = {WORD}").unionByName(grams).select("block", "kind", "shard", "told", *empty))
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
    return parts.groupBy("block").applyInPandas(lambda pdf: score_block(pdf, tokens, distinct, shards), out)


def op6_ctw(spark, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))
