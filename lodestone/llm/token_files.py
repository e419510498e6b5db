"""Token ids in binary files of patched frame-of-reference blocks.

Documents are tokenized where they are read and only their ids are shuffled, to ranges of doc_id whose bounds come
from quantiles of the column alone. Each range is written as files of whole documents in ascending order. A block holds
1,024 ids: its minimum is subtracted, the differences are packed at the width that a percentile of them needs, and those
that are wider have their upper bits in the block's list of exceptions. An index says where each block starts, so a run
of ids is read without unpacking the rest.

A file, little-endian: HEADER; doc_ids (int64), a bit for each that is null; where each document ends (uint64); where
each block starts (uint32, and the end of the last); the blocks; a CRC-32 of all that; MAGIC. A block is its minimum
(uint32), width (uint8), exceptions (uint16), the packed low bits, places of exceptions (uint16), their upper bits
(uint32). Files are written by Spark's text writer, a file a row, with MAGIC as its line separator, and read back as
binary files, so paths may be remote and a file without its end is noticed.

Defined results: null text is the empty text; every document ends in the separator id and so has an id at least; an
empty table gives no rows; null doc_ids come first; rows that repeat a doc_id stand side by side as documents of their
own, in the order of the scan, and may fill several ranges; very long texts are encoded whole and never cut, so a file is
larger than FILE_IDS by one document at most; all columns but doc_id and text are ignored. A file that is cut short or
damaged is an error, not a shorter result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.packing import _encoder, _slices, default_tokenizer
from lodestone.llm.scratch import Scratch, bounded_batches, documents

BLOCK = 1024
#: The share of a block's differences that its width has to hold.
PERCENTILE = 0.95
#: Ids after which a file ends with the document, and bytes of text a range of doc_ids holds about.
FILE_IDS, RANGE_BYTES = 4 << 20, 256 << 20
MAGIC = b"PFORIDS1"
#: MAGIC, range, file in the range, documents, ids, ids before it in the range, ids of a block, blocks.
HEADER, HEADER_SIZE = "<8sIIQQQII", struct.calcsize("<8sIIQQQII")
BLOCK_HEAD, BLOCK_HEAD_SIZE = "<IBH", struct.calcsize("<IBH")
#: Blocks that are packed or unpacked together, about 8 MB of bits.
AT_ONCE = 256
FIRST = -(1 << 63)


def _packed_blocks(ids: np.ndarray, percentile: float) -> Iterator[bytes]:
    """ids in rows of BLOCK -> each row as a block."""
    least = ids.min(axis=1)
    over = ids - least[:, None]
    kth = min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1)
    widths = [int(x).bit_length() for x in np.partition(over, kth, axis=1)[:, kth]]
    short = over.astype("<u2") if over.max() < 1 << 16 else over
    bits = np.unpackbits(short.view(np.uint8).reshape(len(ids), BLOCK, short.itemsize), axis=2, bitorder="little")
    for row, base, width, value in zip(bits, least, widths, over):
        upper = value >> np.uint32(width) if width < 32 else np.zeros_like(value)
        at = np.flatnonzero(upper)
        yield b"".join([struct.pack(BLOCK_HEAD, int(base), width, len(at)), np.packbits(row[:, :width], bitorder="little").tobytes(), at.astype("<u2").tobytes(), upper[at].astype("<u4").tobytes()])


def pack_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> tuple[list[bytes], np.ndarray]:
    """The blocks of a run of ids and where each starts. The last one is filled up with its last id."""
    blocks: list[bytes] = []
    for lo in range(0, len(ids), AT_ONCE * BLOCK):
        some = ids[lo : lo + AT_ONCE * BLOCK].astype("<u4")
        some = np.pad(some, (0, -len(some) % BLOCK), mode="edge").reshape(-1, BLOCK)
        blocks += _packed_blocks(some, percentile)
    return blocks, np.cumsum([0, *map(len, blocks)]).astype("<u4")


def unpack_blocks(data: memoryview, starts: np.ndarray, first: int, last: int) -> np.ndarray:
    """The ids of blocks first to last - 1; data begins where block 0 does."""
    out = np.empty((last - first, BLOCK), "<u4")
    for lo in range(first, last, AT_ONCE):
        hi = min(last, lo + AT_ONCE)
        heads = [struct.unpack_from(BLOCK_HEAD, data, starts[b]) for b in range(lo, hi)]
        lanes = 16 if all(h[1] <= 16 for h in heads) else 32
        bits = np.zeros((hi - lo, BLOCK, lanes), np.uint8)
        for i, (_, width, _) in enumerate(heads):
            at = starts[lo + i] + BLOCK_HEAD_SIZE
            bits[i, :, :width] = np.unpackbits(np.frombuffer(data, np.uint8, BLOCK * width // 8, at), bitorder="little").reshape(BLOCK, width)
        values = np.packbits(bits, axis=2, bitorder="little").view(f"<u{lanes // 8}")[:, :, 0].astype("<u4")
        for i, (_, width, n) in enumerate(heads):
            if n:
                at = starts[lo + i] + BLOCK_HEAD_SIZE + BLOCK * width // 8
                places = np.frombuffer(data, "<u2", n, at)
                values[i, places] |= np.frombuffer(data, "<u4", n, at + 2 * n) << np.uint32(width)
        out[lo - first : hi - first] = values + np.array([h[0] for h in heads], "<u4")[:, None]
    return out.reshape(-1)


def file_bytes(part: int, number: int, before: int, doc_ids: list[int | None], sizes: list[int], ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """A file but for the MAGIC at its end."""
    blocks, starts = pack_blocks(ids, percentile)
    null = np.packbits(np.array([i is None for i in doc_ids], bool), bitorder="little")
    known = np.array([i or 0 for i in doc_ids], "<i8")
    head = struct.pack(HEADER, MAGIC, part, number, len(sizes), len(ids), before, BLOCK, len(blocks))
    body = b"".join([head, known.tobytes(), null.tobytes(), np.cumsum(sizes).astype("<u8").tobytes(), starts.tobytes(), *blocks])
    return body + struct.pack("<I", zlib.crc32(body))


class TokenFile:
    """A file's bytes, opened."""

    def __init__(self, content: bytes):
        if len(content) < HEADER_SIZE + 4 + len(MAGIC) or content[:8] != MAGIC or content[-8:] != MAGIC:
            raise ValueError("not a whole file of token ids")
        if zlib.crc32(memoryview(content)[: -len(MAGIC) - 4]) != struct.unpack_from("<I", content, len(content) - len(MAGIC) - 4)[0]:
            raise ValueError("a file of token ids is damaged")
        _, self.part, self.number, n, self.n_ids, self.before, size, self.n_blocks = struct.unpack_from(HEADER, content)
        if size != BLOCK:
            raise ValueError(f"blocks of {size} ids")
        at = HEADER_SIZE
        null = np.unpackbits(np.frombuffer(content, np.uint8, -(-n // 8), at + 8 * n), count=n, bitorder="little").astype(bool)
        self.doc_ids = pa.array(np.frombuffer(content, "<i8", n, at), mask=null)
        at += 8 * n + -(-n // 8)
        self.ends = np.frombuffer(content, "<u8", n, at).astype(np.int64)
        self.begins = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        at += 8 * n
        self.starts = np.frombuffer(content, "<u4", self.n_blocks + 1, at).astype(np.int64)
        self.blocks = memoryview(content)[at + 4 * (self.n_blocks + 1) :]

    def ids(self, start: int, length: int) -> np.ndarray:
        """A run of ids; only the blocks it touches are unpacked."""
        start, stop = max(0, start), min(self.n_ids, start + length)
        if stop <= start:
            return np.zeros(0, "<u4")
        first, last = start // BLOCK, -(-stop // BLOCK)
        return unpack_blocks(self.blocks, self.starts, first, last)[start - first * BLOCK : stop - first * BLOCK]


def range_bounds(docs: DataFrame, n: int) -> list[int]:
    """n - 1 doc_ids that part the rows evenly; a doc_id that many rows have is several of them. Reads one column."""
    if n < 2:
        return []
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST))
    return docs.agg(F.percentile_approx(key, F.array(*(F.lit(i / n) for i in range(1, n))), max(10_000, 10 * n))).first()[0] or []


def write_files(docs: DataFrame, path: str, tokenizer_path: str | None = None, separator: int = 0, ranges: int | None = None, file_ids: int = FILE_IDS, percentile: float = PERCENTILE) -> None:
    """Writes the files of docs into a new folder."""
    spark = docs.sparkSession
    bounded_batches(spark)
    tokenizer_path = tokenizer_path or default_tokenizer()
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long"))).first()[0] or 0
    ranges = ranges or max(3 * spark.sparkContext.defaultParallelism, -(-size // RANGE_BYTES))
    bounds = np.array(range_bounds(docs, ranges), np.int64)
    kind = _encoder(tokenizer_path)[1].str

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, dtype = _encoder(tokenizer_path)
        end, part, turn = np.array([separator], dtype).tobytes(), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in _slices(texts):
                ids = batch.column(0).slice(lo, hi - lo)
                key = ids.fill_null(FIRST).to_numpy(zero_copy_only=False)
                row = np.arange(turn, turn + len(key))
                turn += len(key)
                left, right = np.searchsorted(bounds, key, "left"), np.searchsorted(bounds, key, "right")
                spread = left + (row + 7919 * part) % (right - left + 1)  # rows of one doc_id share all of its ranges
                yield pa.RecordBatch.from_arrays([pa.array(spread, pa.int32()), pa.array(np.full(len(key), part), pa.int32()), pa.array(row, pa.int64()), ids, pa.array([x + end for x in encode(texts[lo:hi])], pa.binary())], names=["range", "part", "row", "doc_id", "ids"])

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, before, held, doc_ids, sizes, part, n = 0, 0, [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            content = file_bytes(part, number, before, doc_ids, sizes, np.frombuffer(b"".join(held), kind), percentile)
            return pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], names=["content"])

        for batch in batches:
            for part, doc_id, ids in zip(*(batch.column(i).to_pylist() for i in range(3))):
                doc_ids.append(doc_id)
                sizes.append(len(ids) // np.dtype(kind).itemsize)
                held.append(ids)
                n += sizes[-1]
                if n >= file_ids:
                    yield close()
                    number, before, held, doc_ids, sizes, n = number + 1, before + n, [], [], [], 0
        if sizes:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(tokenize, "range int, part int, row long, doc_id long, ids binary")
    rows = rows.repartitionById(ranges, "range").sortWithinPartitions("doc_id", "part", "row")
    files = rows.select("range", "doc_id", "ids").mapInArrow(lay_out, "content binary")
    # A cast to string keeps all bytes, and the text writer puts out just these.
    files.select(F.col("content").cast("string").alias("value")).write.option("lineSep", MAGIC.decode()).option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def read_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(range, local, doc_id, n_tokens, ids_crc32[, ids]) from a folder's files: local counts the ids before a document in its range; ids are little-endian unsigned 32-bit."""
    schema = "range int, local long, doc_id long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    step = 4 << 20

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                file = TokenFile(content.as_py())
                lo = 0
                while lo < len(file.ends):  # some documents at a time
                    hi = max(lo + 1, int(np.searchsorted(file.ends, file.begins[lo] + step, "right")))
                    at = file.begins[lo]
                    data = file.ids(at, file.ends[hi - 1] - at).tobytes()
                    view = memoryview(data)
                    runs = [view[4 * a : 4 * b] for a, b in zip(file.begins[lo:hi] - at, file.ends[lo:hi] - at)]
                    columns = [pa.array(np.full(hi - lo, file.part), pa.int32()), pa.array(file.before + file.begins[lo:hi]), file.doc_ids.slice(lo, hi - lo), pa.array(file.ends[lo:hi] - file.begins[lo:hi]), pa.array([zlib.crc32(r) for r in runs], pa.int64())]
                    if with_ids:
                        columns.append(pa.array([bytes(r) for r in runs], pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])
                    lo = hi

    bounded_batches(spark)
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    return files.mapInArrow(run, schema)


def located(spark: SparkSession, path: str, scratch: Scratch, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]): the documents of a folder with the ids before each in all files. What joins is a number a range."""
    rows = scratch.write(read_files(spark, path, with_ids), "read")
    sizes = rows.groupBy("range").agg(F.max(F.col("local") + F.col("n_tokens")).alias("size"))
    before = sizes.select("range", (F.sum("size").over(Window.orderBy("range")) - F.col("size")).alias("before"))  # a row for each task that wrote
    return rows.join(F.broadcast(before), "range").select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op11_token_files(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "token_files")
    write_files(documents(spark, sf_dir), f"{scratch.path}/files")
    return located(spark, f"{scratch.path}/files", scratch)
