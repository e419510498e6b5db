"""Language identification by bit-sliced Bloom filters of n-grams.

Each row of the filter is a bitmask with one bit for each language. A language sets its bit in the rows that an
n-gram hashes to; the AND of an n-gram's rows gives all languages that contain it at once. A text counts, for each
language, how many of its n-grams have that bit; the counts are corrected by the rate at which that language's bits
are set by chance, and the largest corrected count decides.

A language's n-grams are all that its taught documents contain. The executors find them and set their bits; the
driver gets the filters, which are sized by the count of n-grams up to MOST_ROWS rows an order. Beyond that no n-gram
is left out: bits are set by chance more often, which the correction takes off. Teaching uses a sample bounded by
teach_docs for each language; scoring reads every text whole.

Defined results: null text, or text without a letter, is und with score 0; so is every text if nothing was taught.
A null doc_id is neither held out nor taught. Rows that repeat a doc_id are scored each, and taught each or not at all.
Ties go to the first language by code point. Very long texts are read whole, a slice at a time. Empty tables give no
rows. Columns but doc_id, text and lang are carried along by identified(), whatever their names, and never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.scratch import Scratch, bounded_batches, documents
from lodestone.llm.words import mix64

ORDERS, HASHES, MOST_ROWS, TEACH_DOCS = (3, 4, 5), 3, 1 << 22, 3000
UNKNOWN = "und"
#: Code points taken at a time of a long text.
STEP = 1 << 17
#: Rows of a filter that reach the driver together; no filter is smaller.
BLOCK = 1 << 12


class Alphabet:
    """Letters of a text as lower-case code points, with one 0 for each run of anything else and at both ends."""

    def __init__(self):
        self.letter = np.fromiter((chr(c).isalpha() for c in range(0x10000)), bool, 0x10000)

    def __call__(self, text: str) -> np.ndarray:
        c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = self.letter[np.minimum(c, 0xFFFF)]
        if len(c) and c.max() > 0xFFFF:
            far = np.flatnonzero(c > 0xFFFF)
            letter[far] = [chr(x).isalpha() for x in c[far].tolist()]
        c = np.concatenate([[0], np.where(letter, c, 0), [0]]).astype(np.uint64)
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
        return c[keep]


def grams(c: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that hold a letter, repeats included."""
    if len(c) < n:
        return np.zeros(0, np.uint64)
    h = np.full(len(c) - n + 1, n, np.uint64)
    for i in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + c[i : len(c) - n + 1 + i]
    return mix64(h)


def places(h: np.ndarray, size: int, hashes: int = HASHES) -> Iterator[np.ndarray]:
    """The rows of each n-gram in a filter of size rows, a power of two."""
    step = h >> np.uint64(32) | np.uint64(1)
    for k in range(hashes):
        yield ((h + np.uint64(k) * step) & np.uint64(size - 1)).astype(np.int64)


@dataclass
class LanguageFilters:
    languages: list[str]
    #: For each order: rows of bitmasks, 64 languages a word.
    rows: dict[int, np.ndarray]
    hashes: int = HASHES

    def __post_init__(self):
        self.chance = {}
        for n, rows in self.rows.items():
            fill = [np.count_nonzero(rows[:, j // 64] >> np.uint64(j % 64) & np.uint64(1)) / len(rows) for j in range(len(self.languages))]
            self.chance[n] = np.array(fill) ** self.hashes

    def masks(self, h: np.ndarray, n: int) -> np.ndarray:
        """The languages of each n-gram, as bitmasks."""
        rows = self.rows[n]
        return np.bitwise_and.reduce([rows[at] for at in places(h, len(rows), self.hashes)])

    def add(self, h: np.ndarray, n: int, language: int) -> None:
        for at in places(h, len(self.rows[n]), self.hashes):
            self.rows[n][at, language // 64] |= np.uint64(1) << np.uint64(language % 64)

    def shares(self, c: np.ndarray) -> np.ndarray:
        """The corrected share of the text's n-grams that each language contains."""
        hits, total = np.zeros(len(self.languages)), 0
        for n in self.rows:
            own, many = np.zeros(len(self.languages)), 0
            for lo in range(0, max(1, len(c) - n + 1), STEP):
                h = grams(c[lo : lo + STEP + n - 1], n)
                m = self.masks(h, n)
                many += len(h)
                for w in range(m.shape[1]):
                    own[64 * w : 64 * w + 64] += _popcounts(m[:, w], min(64, len(self.languages) - 64 * w))
            hits += np.maximum(0, (own - many * self.chance[n]) / (1 - self.chance[n]))
            total += many
        return hits / max(1, total)

    def decide(self, c: np.ndarray) -> tuple[str, float, float]:
        """(language, score, share of the best)."""
        if not c.any() or not self.languages:
            return UNKNOWN, 0.0, 0.0
        s = self.shares(c)
        best = int(s.argmax())
        others = np.delete(s, best)
        score = s[best] / (s[best] + others.max()) if len(others) and s[best] > 0 else float(s[best] > 0)
        return self.languages[best], float(score), float(s[best])


def _popcounts(m: np.ndarray, languages: int) -> np.ndarray:
    """How many masks have each bit."""
    if languages <= 10:
        seen = np.bincount(m.astype(np.int64), minlength=1 << languages)
        return np.array([seen[(np.arange(1 << languages) >> j & 1).astype(bool)].sum() for j in range(languages)])
    return np.array([np.count_nonzero(m >> np.uint64(j) & np.uint64(1)) for j in range(languages)])


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents never taught from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def teach(docs: DataFrame, orders: tuple[int, ...] = ORDERS, teach_docs: int = TEACH_DOCS, hashes: int = HASHES, most_rows: int = MOST_ROWS) -> LanguageFilters:
    """Filters from text and lang of documents that are not held out. What reaches the driver is the rows of the filters that have a bit."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().toLocalIterator()}
    languages = sorted(counts, key=lambda s: [ord(c) for c in s])
    if not languages:
        return LanguageFilters([], {n: np.zeros((16, 1), np.uint64) for n in orders}, hashes)
    # The share of the hash range that holds teach_docs documents of each language: literals, so the scan draws.
    lookup = lambda of: F.create_map(*(F.lit(x) for i, s in enumerate(languages) for x in (s, of(i, s))))[F.col("lang")]
    draw = F.pmod(F.xxhash64(F.lit("teach"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = known.where(draw < lookup(lambda i, s: min(1.0, teach_docs / counts[s]))).select(lookup(lambda i, s: i).alias("language"), "text")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet = Alphabet()
        found: dict[tuple[int, int], list[np.ndarray]] = {}

        def out():
            for (language, n), parts in found.items():
                h = np.unique(np.concatenate(parts))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), language, np.int32)), pa.array(np.full(len(h), n, np.int32)), pa.array(h.view(np.int64))], names=["language", "n", "gram"])
            found.clear()

        waiting = 0
        for batch in batches:
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                c = alphabet(text.as_py())
                for lo in range(0, len(c), STEP):
                    for n in orders:
                        h = grams(c[lo : lo + STEP + n - 1], n)
                        found.setdefault((language, n), []).append(h)
                        waiting += len(h)
                    if waiting > 4_000_000:
                        yield from out()
                        waiting = 0
        yield from out()

    scratch = Scratch(docs.sparkSession, "language")
    seen = scratch.write(sample.mapInArrow(distinct, "language int, n int, gram long").distinct(), "seen")
    most = {n: 1024 for n in orders}
    for r in seen.groupBy("language", "n").count().toLocalIterator():
        most[r["n"]] = max(most[r["n"]], r["count"])
    sizes = {n: min(most_rows, 1 << int(most[n] * hashes * 2).bit_length()) for n in orders}

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            language, n, gram = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for k in orders:
                own = n == k
                bit = np.uint64(1) << (language[own] % 64).astype(np.uint64)
                for at in places(gram[own].view(np.uint64), sizes[k], hashes):
                    yield pa.RecordBatch.from_arrays([pa.array(n[own]), pa.array(language[own] // 64), pa.array(at // BLOCK), pa.array(at % BLOCK), pa.array(bit.view(np.int64))], names=["n", "word", "block", "row", "bits"])

    def dense(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        block = np.zeros(BLOCK, np.uint64)
        np.bitwise_or.at(block, rows["row"].to_numpy(), rows["bits"].to_numpy().view(np.uint64))
        return pd.DataFrame({"n": [key[0]], "word": [key[1]], "block": [key[2]], "rows": [block.tobytes()]})

    words = -(-len(languages) // 64)
    rows = {n: np.zeros((sizes[n], words), np.uint64) for n in orders}
    # Hashes spread bits evenly over blocks; the driver gets the filters' own bytes, block by block.
    marked = seen.select("language", "n", "gram").mapInArrow(bits, "n int, word int, block long, row long, bits long")
    for r in marked.groupBy("n", "word", "block").applyInPandas(dense, "n int, word int, block long, rows binary").toLocalIterator():
        rows[r["n"]][r["block"] * BLOCK : (r["block"] + 1) * BLOCK, r["word"]] = np.frombuffer(r["rows"], np.uint64)
    scratch.drop("seen")
    return LanguageFilters(languages, rows, hashes)


def predict(docs: DataFrame, model: LanguageFilters) -> DataFrame:
    """(doc_id, lang_pred, score, share) of every whole text; nothing but the text is read for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet = Alphabet()
        for batch in batches:
            got = [model.decide(alphabet(t.as_py() or "")) for t in batch.column(1)]
            lang, score, share = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(share, pa.float64())], names=["doc_id", "lang_pred", "score", "share"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, share double")


def identified(docs: DataFrame, least_share: float = 0.1) -> DataFrame:
    """docs without those rejected: no letter, or fewer than least_share of the n-grams in any taught language. If nothing was taught, only texts without a letter go."""
    bounded_batches(docs.sparkSession)
    model = teach(docs)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet = Alphabet()
        for batch in batches:
            ok = []
            for t in batch.column(at):
                c = alphabet(t.as_py() or "")
                ok.append(bool(c.any()) and (not model.languages or model.decide(c)[2] >= least_share))
            yield batch.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2_language(spark, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = documents(spark, sf_dir)
    return predict(docs, teach(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "share")
