"""Line dedup that can be undone: sharded cuckoo filters backed by exact reference-count tables.

The exact side is two tables, both of which only grow by what a batch brings: one reference for each line key and
document, and for each key its latest row, which says how many documents hold it and the largest of them. Keys are
dealt to shards by hash, and each shard keeps a cuckoo filter of the keys that any document holds.

The filter stands before the exact tables. A key of a batch that the filter doesn't know is new: its row is written
without a look at the exact side. Only keys that the filter may know are looked up there, so a false positive costs a
lookup and changes nothing. Deleting documents lowers the counts; a key that no document holds any more leaves the
filter too, which Bloom filters can't do, and is new again when it comes back. Insertions and deletions may come in
any order, and deleting what was inserted restores the state before. Each writes its own rows; every MERGE_AT writes
the segments are merged into one.

Counting is combined before the shuffle, so a shard sees each key of a batch once, however many documents hold it.
Lines that lose are found as numbers of lines, and texts are cut by built-in functions.

Defined results: null or empty text is one empty line; a null doc_id holds no reference, and its row stays whole;
rows that repeat a doc_id are one document for counting, and each is cleaned; where rows tie for the largest doc_id,
each of them keeps its lines; very long texts are read whole, and a text's own lines are the most that a row ever
gathers; an empty table gives no rows; columns other than doc_id and text are carried along by clean(), whatever
their names, and never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.scratch import Scratch, bounded_batches, documents, unused

MIN_DOCS, MIN_CHARS = 3, 20
#: Keys of a shard, on average.
SHARD_KEYS = 200_000
#: Batches in which one-shot use inserts its documents, and writes after which segments are merged.
BATCHES, MERGE_AT = 2, 8
SPACE = b" \t\n\x0b\x0c\r"


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; insert, delete and contains take arrays of 16-byte keys, each key once."""

    SLOTS = 4

    def __init__(self, buckets: int = 16):
        self.table = np.zeros((max(16, 1 << (buckets - 1).bit_length()), self.SLOTS), np.uint16)
        self.n = 0

    @classmethod
    def for_keys(cls, n: int) -> CuckooFilter:
        return cls(int(n / (cls.SLOTS * 0.8)) + 1)

    @staticmethod
    def _words(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return keys[:, 0], keys[:, 1]

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self._words(keys)
        mark = (b & np.uint64(0xFFFF)).astype(np.uint16)
        mark[mark == 0] = 1
        one = (a & np.uint64(len(self.table) - 1)).astype(np.int64)
        return mark, one, self._other(one, mark)

    def _other(self, place: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return place ^ ((mark.astype(np.int64) * 0x5BD1E995) & (len(self.table) - 1))

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, one, two = self._places(keys)
        return (self.table[one] == mark[:, None]).any(1) | (self.table[two] == mark[:, None]).any(1)

    def insert(self, keys: np.ndarray) -> bool:
        """False if it is too full; it must then be built anew, larger, from the exact table."""
        mark, place, _ = self._places(keys)
        rng = np.random.default_rng(7)
        for turn in range(2000):
            if not len(mark):
                return True
            if turn:
                _, order = np.unique(place, return_index=True)  # one newcomer a bucket and turn
            else:
                order = np.unique(place, return_index=True)[1]
            row = self.table[place[order]]
            free = row == 0
            has = free.any(1)
            slot = np.where(has, free.argmax(1), rng.integers(0, self.SLOTS, len(order)))
            thrown = row[np.arange(len(order)), slot]
            self.table[place[order], slot] = mark[order]
            self.n += int(has.sum())
            waiting = np.ones(len(mark), bool)
            waiting[order] = False
            out = ~has
            mark, place = np.concatenate([mark[waiting], thrown[out]]), np.concatenate([place[waiting], self._other(place[order][out], thrown[out])])
        return False

    def delete(self, keys: np.ndarray) -> None:
        for m, p, q in zip(*(x.tolist() for x in self._places(keys))):
            for at in (p, q):
                found = np.flatnonzero(self.table[at] == m)
                if len(found):
                    self.table[at, found[0]] = 0
                    self.n -= 1
                    break

    def to_bytes(self) -> bytes:
        return self.n.to_bytes(8, "little") + self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        out = cls()
        out.table = np.frombuffer(data[8:], np.uint16).reshape(-1, cls.SLOTS).copy()
        out.n = int.from_bytes(data[:8], "little")
        return out


def line_keys(text: str | None, min_chars: int = MIN_CHARS) -> list[bytes | None]:
    """The key of each line: 128 bits of the stripped line with A-Z lower-cased, None if it is shorter than min_chars code points."""
    import xxhash

    out: list[bytes | None] = []
    for line in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n"):
        line = line.strip(SPACE)
        n = len(line)
        if n < min_chars or n < 4 * min_chars and len(line.decode("utf-8", "surrogatepass")) < min_chars:
            out.append(None)
        else:
            out.append(xxhash.xxh3_128_digest(line))
    return out


def references(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(key, doc_id), each pair of a row once."""
    schema = pa.schema([("key", pa.binary()), ("doc_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = set(line_keys(text.as_py(), min_chars))
                own.discard(None)
                keys.extend(own)
                ids.extend([i] * len(own))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], schema=schema)

    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "key binary, doc_id long")


def _two_words(keys: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)


def _load(pdf: pd.DataFrame, room: int) -> tuple[CuckooFilter, pd.DataFrame]:
    """A shard's filter and the other rows. A shard without one gets one for at least room keys."""
    own = pdf["filter"].notna()
    if own.any():
        return CuckooFilter.from_bytes(pdf.loc[own, "filter"].iloc[0]), pdf[~own]
    return CuckooFilter.for_keys(max(room, len(pdf))), pdf


class LineIndex:
    """The state of incremental line dedup.

    expected is how many references the index will hold, about; shards and filters are laid out for it, and laid out
    anew when there are more than twice as many. lookups counts the keys that were looked up in the exact table.
    gated=False looks up all of them, as a test of the filters.
    """

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS, expected: int = 0, gated: bool = True):
        self.spark, self.min_docs, self.min_chars, self.shard_keys, self.gated = spark, min_docs, min_chars, shard_keys, gated
        self.scratch = Scratch(spark, "lines")
        self.refs: list[DataFrame] = []
        self.rows: list[DataFrame] = []
        self._filters: DataFrame | None = None
        self.shards, self.held, self.turn, self.lookups = max(1, -(-expected // shard_keys)), 0, 0, 0

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        return self.scratch.write(df, f"{name}{self.turn}")

    def _dealt(self, keys: DataFrame, *columns: str) -> DataFrame:
        """Keys with their shard, and each shard's filter as a row of its own."""
        shard = F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int").alias("shard")
        dealt = keys.select(shard, "key", *columns, F.lit(None).cast("binary").alias("filter"))
        if self._filters is None:
            return dealt
        blank = [F.lit(0).cast(dealt.schema[c].dataType).alias(c) for c in columns]  # no nulls: they would make pandas round ids
        return dealt.unionByName(self._filters.select("shard", F.lit(None).cast("binary").alias("key"), *blank, "filter"))

    def references(self) -> DataFrame:
        """(key, doc_id) of all documents held."""
        return self._all(self.refs, "key binary, doc_id long")

    def _all(self, segments: list[DataFrame], schema: str) -> DataFrame:
        out = self.spark.createDataFrame([], schema) if not segments else segments[0]
        for s in segments[1:]:
            out = out.unionByName(s)
        return out

    def counts(self) -> DataFrame:
        """(key, n_docs, top_doc) of all keys held: of each key the row written last."""
        last = self._all(self.rows, "key binary, turn int, n_docs long, top_doc long")
        if len(self.rows) > 1:
            last = last.groupBy("key").agg(F.max(F.struct("turn", "n_docs", "top_doc")).alias("last")).select("key", "last.*")
        return last.where("n_docs > 0").select("key", "n_docs", "top_doc")

    def filters(self) -> DataFrame:
        """(shard, n_keys, filter)."""
        return self._filters

    def _asked(self, keys: DataFrame) -> DataFrame:
        """keys (key, n_docs, top_doc) -> these and maybe: whether the filter may know the key."""

        def ask(pdf: pd.DataFrame) -> pd.DataFrame:
            filt, own = _load(pdf, 0)
            maybe = filt.contains(_two_words(own["key"])) if len(own) else np.zeros(0, bool)
            return pd.DataFrame({"key": own["key"].to_numpy(), "n_docs": own["n_docs"].to_numpy(np.int64), "top_doc": own["top_doc"].to_numpy(np.int64), "maybe": maybe})

        if not self.rows:
            return keys.withColumn("maybe", F.lit(False))
        if not self.gated or self._filters is None:
            return keys.withColumn("maybe", F.lit(True))
        return self._dealt(keys, "n_docs", "top_doc").groupBy("shard").applyInPandas(ask, "key binary, n_docs long, top_doc long, maybe boolean")

    def _refilter(self, changes: DataFrame) -> None:
        """changes: (key, add): keys that begin to be held, or no longer are."""
        room = self.shard_keys

        def change(pdf: pd.DataFrame) -> pd.DataFrame:
            filt, own = _load(pdf, room)
            add = own["add"].to_numpy(bool)
            if (~add).any():
                filt.delete(_two_words(own["key"][~add]))
            fits = filt.insert(_two_words(own["key"][add])) if add.any() else True
            return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "n_keys": [filt.n], "filter": [filt.to_bytes() if fits else None]})

        schema = "shard int, n_keys long, filter binary"
        made = self._write(self._dealt(changes, "add").groupBy("shard").applyInPandas(change, schema), "filters")
        full = made.where("filter IS NULL").count()
        if full or self.held > 2 * self.shards * self.shard_keys:  # laid out anew from the exact table
            self.shards = max(self.shards * (2 if full else 1), -(-self.held // self.shard_keys))
            self._filters = None
            made = self._write(self._dealt(self.counts().select("key", F.lit(True).alias("add")), "add").groupBy("shard").applyInPandas(change, schema), "refilled")
        self._filters = made

    def insert(self, docs: DataFrame) -> LineIndex:
        return self.insert_references(self._write(references(docs, self.min_chars).distinct(), "batch"))

    def insert_references(self, refs: DataFrame) -> LineIndex:
        """refs: (key, doc_id) of a written table, each pair once."""
        keys = refs.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("top_doc"))
        if not self.rows:
            new, added = self._write(keys.withColumn("turn", F.lit(self.turn)), "rows"), refs
            begun = new.select("key", F.lit(True).alias("add"))
        else:
            asked = self._write(self._asked(keys), "asked")
            maybe = asked.where("maybe").select("key")
            self.lookups += maybe.count()
            known = self._write(self.counts().join(maybe, "key", "left_semi"), "known")
            again = self.references().join(maybe, "key", "left_semi").join(refs, ["key", "doc_id"], "left_semi")
            again = self._write(again, "again")  # documents inserted once more
            found = known.select("key", F.col("n_docs").alias("had"), F.col("top_doc").alias("top"))
            twice = again.groupBy("key").agg(F.count(F.lit(1)).alias("twice"))
            both = asked.where("maybe").join(found, "key", "left").join(twice, "key", "left").select("key", F.expr("n_docs + coalesce(had, 0) - coalesce(twice, 0)").alias("n_docs"), F.greatest("top_doc", "top").alias("top_doc"), F.col("had").isNull().alias("add"))
            both = both.unionByName(asked.where("NOT maybe").select("key", "n_docs", "top_doc", F.lit(True).alias("add")))
            new = self._write(both.withColumn("turn", F.lit(self.turn)), "rows")
            begun = new.where("add").select("key", "add")
            added = self._write(refs.join(again, ["key", "doc_id"], "left_anti"), "refs")
        self.held += added.count()
        self.refs.append(added)
        self.rows.append(new.select("key", "turn", "n_docs", "top_doc"))
        self._refilter(begun)
        return self._next("asked", "known", "again")

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """doc_ids: a column doc_id."""
        if not self.refs:
            return self
        ids = self._write(doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct(), "ids")
        lost = self._write(self.references().join(ids, "doc_id", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("lost")), "lost")
        self.refs = [r.join(ids, "doc_id", "left_anti").select("key", "doc_id") for r in self.refs]
        tops = self.references().join(lost.select("key"), "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("top_doc"))
        now = lost.join(tops, "key", "left").select("key", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("top_doc", F.lit(0)).alias("top_doc"), F.lit(self.turn).alias("turn"))
        now = self._write(now, "rows").select("key", "turn", "n_docs", "top_doc")
        self.rows.append(now)
        self._refilter(now.where("n_docs = 0").select("key", F.lit(False).alias("add")))
        return self._next("lost")

    def _next(self, *done: str) -> LineIndex:
        """done: tables of this turn that nothing reads any more."""
        for name in done:
            self.scratch.drop(f"{name}{self.turn}")
        self.turn += 1
        if self.turn % MERGE_AT == 0:
            self.rows = [self._write(self.counts().select("key", F.lit(self.turn - 1).alias("turn"), "n_docs", "top_doc"), "merged")]
            self.refs = [self._write(self.references(), "held")]
            for turn in range(self.turn - MERGE_AT, self.turn):
                for name in ("batch", "rows", "refs", "ids", "merged", "held"):
                    self.scratch.drop(f"{name}{turn}")
        return self

    def drops(self) -> DataFrame:
        """(doc_id, drop_keys): what each document loses. The join may be skewed by a line that many documents hold; AQE splits it, as nothing there needs a key's rows together."""
        repeated = self.counts().where(F.col("n_docs") >= self.min_docs).select("key", "top_doc")
        lost = self.references().join(repeated, "key").where("doc_id <> top_doc")
        return lost.groupBy("doc_id").agg(F.collect_list("key").alias("drop_keys"))

    def _cut(self, docs: DataFrame) -> tuple[DataFrame, Column, Column]:
        """docs joined to what they lose, the text that stays, and how many lines go."""
        min_chars = self.min_chars

        @F.arrow_udf("array<int>")
        def dropped(texts: pa.Array, keys: pa.Array) -> pa.Array:
            out: list[list[int] | None] = []
            for text, lost in zip(texts, keys):
                gone = set(lost.as_py() or ())
                out.append([i for i, k in enumerate(line_keys(text.as_py(), min_chars)) if k in gone] if gone else None)
            return pa.array(out, pa.list_(pa.int32()))

        id_, keys, at = unused(docs.columns, "id", "keys", "at")
        lost = self.drops().select(F.col("doc_id").alias(id_), F.col("drop_keys").alias(keys))
        text = F.col("text").cast("string")
        rows = docs.join(lost, F.col("doc_id").cast("long") == F.col(id_), "left").withColumn(at, dropped(F.when(F.col(keys).isNotNull(), text), F.col(keys)))
        stay = lambda ls: F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col(at)), lambda i: F.get(ls, i))  # noqa: E731  linear in the lines
        kept = F.array_join(F.transform(F.array(F.split(text, "\n", -1)), stay)[0], "\n")
        return rows, F.when(F.col(at).isNull(), text).otherwise(kept), F.coalesce(F.size(at), F.lit(0)).cast("long")

    def clean(self, docs: DataFrame) -> DataFrame:
        """docs with text cleaned."""
        rows, text, _ = self._cut(docs)
        return rows.select(*(text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns))

    def report(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_lines, n_dropped, kept_sha256, text): what clean() does to each row."""
        rows, text, n = self._cut(docs.select("doc_id", "text"))
        whole = F.coalesce("text", F.lit(""))
        n_lines = (F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1).cast("long")
        rows = rows.select("doc_id", n_lines.alias("n_lines"), F.greatest(n, F.lit(0)).alias("n_dropped"), text.alias("text"))
        return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"), "text")


def indexed(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES) -> LineIndex:
    """An index of docs, read once and inserted in batches."""
    spark = docs.sparkSession
    bounded_batches(spark)
    refs = Scratch(spark, "references").write(references(docs, min_chars).distinct(), "all")
    index = LineIndex(spark, min_docs, min_chars, expected=refs.count())
    for batch in range(batches):
        index.insert_references(refs.where(F.pmod(F.xxhash64(F.lit("batch"), "doc_id"), F.lit(batches)) == batch))
    return index


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """One-shot use: an index of docs, then docs cleaned by it."""
    return indexed(docs, min_docs, min_chars).clean(docs)


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return indexed(docs).report(docs).drop("text")


OP1_SQL = r"""
WITH base AS (
  SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT rid, doc_id, pos, ls[pos] AS line,
         translate(trim(ls[pos], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT rid, doc_id, ls, unnest(range(1, len(ls) + 1)) AS pos FROM base)
), stats AS (
  SELECT k, count(DISTINCT doc_id) AS n_docs, max(doc_id) AS top_doc FROM lines WHERE length(k) >= 20 GROUP BY k
), marked AS (
  SELECT l.rid, l.doc_id, l.pos, l.line, coalesce(s.n_docs >= 3 AND l.doc_id <> s.top_doc, FALSE) AS gone
  FROM lines l LEFT JOIN stats s ON l.k = s.k
)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rid
"""
