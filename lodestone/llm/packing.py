"""Packing by concatenate and cut.

Documents are tokenized once, in scan order, and written with the offset each has inside its partition. Pass one
sums tokens by partition; their prefix sums give every partition its place in one global token stream. Pass two adds
both offsets and cuts fixed windows, so no token ever crosses the network. A window that two partitions share is held
as boundary records, which sequences() alone brings together.

Defined results: null text is the empty text; every document ends in the separator id and so has a token at least; an
empty table gives no pieces; rows that repeat a doc_id are packed as documents of their own; a null doc_id stays null;
nothing is chosen, so nothing ties; very long texts are encoded whole and span as many windows as they need; all
columns but doc_id and text are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.scratch import Scratch, bounded_batches, documents

WINDOW = 1024
#: Words and pre-tokens whose ids a worker remembers from task to task, about 150 MB at most.
CACHED_WORDS, CACHED_PIECES = 500_000, 250_000
SPACES = r" \t\n\r\x0b\x0c\x85\xa0  -     　"
#: Cuts a text where a byte-level BPE cuts it, or more rarely: letters and digits may stay together, as encoding parts them.
PIECES = rf"'(?:s|t|re|ve|m|ll|d)| ?[^\W_]+| ?(?:[^\w{SPACES}]|_)+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _encoder(tokenizer_path: str) -> tuple[Callable[[list[str]], list[bytes]], np.dtype]:
    """texts -> their ids as bytes of the dtype."""
    import os
    from array import array

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
    import tokenizers

    held = tokenizers.__dict__.setdefault("_lodestone", {})  # a worker runs many tasks
    if tokenizer_path not in held:
        held[tokenizer_path] = (tokenizers.Tokenizer.from_file(tokenizer_path), {}, {})
    tok, words, known = held[tokenizer_path]
    dtype, code = (np.dtype("<u2"), "H") if tok.get_vocab_size() <= 1 << 16 else (np.dtype("<u4"), "I")
    cut, word_of = re.compile(PIECES).findall, words.get
    marks = [t.content for t in tok.get_added_tokens_decoder().values()]
    ids_of = lambda x: tok.encode_batch_fast([x], add_special_tokens=False)[0].ids
    model = tok.model.tokenize
    by_byte = _byte_letters()

    def encode_piece(p: str) -> bytes:
        """A run of letters is one pre-token, which the model can take as it is."""
        if p.lstrip(" ").isalpha():
            return array(code, [t.id for t in model(p.encode().decode("latin-1").translate(by_byte))]).tobytes()
        return array(code, ids_of(p)).tobytes()

    def encode_pieces(text: str) -> bytes:
        out = []
        for p in cut(text):
            ids = known.get(p)
            if ids is None:
                ids = encode_piece(p)
                if len(known) < CACHED_PIECES and len(p) < 40:
                    known[p] = ids
            out.append(ids)
        return b"".join(out)

    ends = {p: encode_pieces(p) for p in ".,;:!?"}

    def encode_word(w: str) -> bytes:
        """Of a word after a space."""
        if w.isalpha():
            return array(code, [t.id for t in model("\u0120" + w if w.isascii() else (" " + w).encode().decode("latin-1").translate(by_byte))]).tobytes()
        if w[-1:] in ends and w[:-1].isalpha():
            return (word_of(w[:-1]) or encode_word(w[:-1])) + ends[w[-1]]
        return encode_pieces(" " + w)

    def encode_words(t: str) -> bytes:
        """Word by word where every space follows a non-space, as a byte-level BPE always cuts there. Words that end in white space are never remembered, so that looking words up finds the texts where it doesn't."""
        first, *rest = t.split(" ")
        if not first or first[-1].isspace():
            return encode_pieces(t)
        last = rest.pop()
        ids, at = list(map(word_of, rest)), -1
        try:
            while True:
                at = ids.index(None, at + 1)
                word = rest[at]
                if not word or word[-1].isspace():
                    return encode_pieces(t)
                ids[at] = got = encode_word(word)
                if len(words) < CACHED_WORDS and len(word) < 40:
                    words[word] = got
        except ValueError:
            pass
        return encode_pieces(first) + b"".join(ids) + encode_pieces(" " + last)

    def encode(texts: list[str]) -> list[bytes]:
        out = []
        for t in texts:
            if any(m in t for m in marks):  # special tokens are matched in whole texts
                out.append(array(code, ids_of(t)).tobytes())
            else:
                out.append(encode_words(t) if " " in t else encode_pieces(t))
        return out

    return encode, dtype


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it prints, else the next from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(prints)))}


def _slices(texts: list[str], chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Runs of texts that are encoded together."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def tokenized(docs: DataFrame, scratch: Scratch, tokenizer_path: str, separator: int = 0) -> tuple[DataFrame, str]:
    """Pass one: (part, local, n_tokens, doc_id, ids) as written, and the dtype of ids."""
    wide = _encoder(tokenizer_path)[1]
    schema = pa.schema([("part", pa.int32()), ("local", pa.int64()), ("n_tokens", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.binary())])
    end = np.array([separator], wide).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, dtype = _encoder(tokenizer_path)
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in _slices(texts):
                ids = [x + end for x in encode(texts[lo:hi])]
                n = np.array([len(x) // dtype.itemsize for x in ids], np.int64)
                local = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), pa.array(local), pa.array(n), batch.column(0).slice(lo, hi - lo), pa.array(ids, pa.binary())], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return scratch.write(rows.mapInArrow(run, "part int, local long, n_tokens long, doc_id long, ids binary"), "tokens"), wide.str


def bases(tokens: DataFrame) -> dict[int, int]:
    """The global offset of each partition. One number for each task of pass one comes to the driver, no row."""
    totals = sorted(tokens.groupBy("part").agg(F.max(F.col("local") + F.col("n_tokens")).alias("total")).toLocalIterator())
    out, at = {}, 0
    for part, total in totals:
        out[part] = at
        at += total
    return out


def pack(docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW, separator: int = 0, with_ids: bool = False) -> DataFrame:
    """One row for each piece of a document in a window, in any order; with_ids adds the ids themselves (little-endian unsigned 32-bit) and the part."""
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "packing")
    tokens, kind = tokenized(docs, scratch, tokenizer_path or default_tokenizer(), separator)
    base = bases(tokens)
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    schema = pa.schema(fields + [("part", pa.int32()), ("ids", pa.binary())] * with_ids if with_ids else fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for part, local, n, doc_id, ids in zip(*(c.to_pylist() for c in batch.columns)):
                at, start, wide = base[part] + local, 0, np.frombuffer(ids, kind).astype("<u4").tobytes()
                while start < n:
                    length = min(n - start, window - (at + start) % window)
                    piece = wide[4 * start : 4 * (start + length)]
                    rows.append((doc_id, start, length, zlib.crc32(piece), n, (at + start) // window, (at + start) % window, *((part, piece) if with_ids else ())))
                    start += length
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema=schema)

    names = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return tokens.select("part", "local", "n_tokens", "doc_id", "ids").mapInArrow(cut, names + ", part int, ids binary" * with_ids)


def joined_pieces(pieces: DataFrame, window: int) -> DataFrame:
    """(sequence_id, offset, ids, whole): pieces that follow each other in a task as one. A window that lies in one task is whole; what is left are boundary records, two for each end of a task at most."""
    schema = pa.schema([("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("whole", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, begin, parts, size, out = None, 0, [], 0, []
        for batch in batches:
            for sequence, offset, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if parts and (sequence != at or offset != begin + size):
                    out.append((at, begin, b"".join(parts), size == window))
                    parts, size = [], 0
                if not parts:
                    at, begin = sequence, offset
                parts.append(ids)
                size += len(ids) // 4
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((at, begin, b"".join(parts), size == window), schema)], schema=schema)

    return pieces.select("sequence_id", "offset", "ids").mapInArrow(run, "sequence_id long, offset long, ids binary, whole boolean")


def sequences(docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW, separator: int = 0, pad: int = 0) -> DataFrame:
    """The packed windows: (sequence_id, n_tokens, ids array<int>), the last one padded. Windows that lie in one task are cut in place; only boundary records meet by sequence_id, and no group is larger than a window."""
    pieces = joined_pieces(pack(docs, tokenizer_path, window, separator, with_ids=True), window)
    pieces = Scratch(docs.sparkSession, "sequences").write(pieces, "pieces")

    def padded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x, "<u4") for x in batch.column(1).to_pylist()]
            full = [np.concatenate([x, np.full(window - len(x), pad, "<u4")]).astype(np.int32) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(full, pa.list_(pa.int32()))], names=["sequence_id", "n_tokens", "ids"])

    in_order = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])
    met = pieces.where("NOT whole").groupBy("sequence_id").agg(in_order.alias("parts"))
    met = met.select("sequence_id", F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x)).alias("ids"))
    return pieces.where("whole").select("sequence_id", "ids").unionByName(met).mapInArrow(padded, "sequence_id long, n_tokens long, ids array<int>")


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
