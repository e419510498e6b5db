"""Media columns in Ogg: checked pages, packets rebuilt from lacing values, streams taken apart, times from granules.

mux() and demux() know nothing but the container. On top lies a mapping of 8-bit mono samples: a header packet, then
packets of samples whose granule position counts samples, and beside it a cue stream with a checksum for each stretch
of samples. Reading drops pages whose checksum is wrong, finds the next page by its mark, and drops packets of which
a page is missing; it never fails on damaged bytes.

Defined results: null text is the empty text; the payload always has 64 bytes at least; a null doc_id stays null; equal
texts have equal containers, as stream numbers are fixed; rows that repeat a doc_id are stored each; nothing is chosen, so
nothing ties; very long texts are stored whole, in as many pages as they need; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.scratch import bounded_batches, documents

MARK = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
RATE, PACKET, STRETCH, UNIT = 8000, 4096, 16384, 64
SAMPLES, CUES = 1, 2
HEAD, HEAD_SIZE = "<4sBBqIIIB", 27
SOUND = b"U8 MONO\0"
INFO, INFO_SIZE, CUE = "<8sIBQ", 21, "<QI"
#: Each byte with its bits in reverse.
MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(page: bytes) -> int:
    """The container's CRC: polynomial 0x04C11DB7 from 0, most significant bit first. zlib's is its mirror image, so both ends are mirrored."""
    crc = zlib.crc32(page.translate(MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(MIRROR), "big")


@dataclass
class Packet:
    data: bytes
    #: Set where the packet is the last to end on its page, else -1.
    granule: int = -1


@dataclass
class Stream:
    serial: int
    packets: list[Packet] = field(default_factory=list)
    ended: bool = False
    lost: int = 0
    pages: int = 0


def pages_of(serial: int, packets: list[Packet]) -> list[bytes]:
    """The pages of a stream, each as full as 255 lacing values allow; the first packet has a page of its own."""
    pages: list[list] = []  # lacing, parts, granule, continued

    def fresh(continued: bool) -> list:
        pages.append([bytearray(), [], -1, continued])
        return pages[-1]

    page = fresh(False)
    for k, p in enumerate(packets):
        if k == 1 or len(page[0]) == 255:
            page = fresh(False)
        lacing, at = b"\xff" * (len(p.data) // 255) + bytes([len(p.data) % 255]), 0
        while lacing:
            room = 255 - len(page[0])
            if not room:
                page, room = fresh(True), 255
            now, lacing = lacing[:room], lacing[room:]
            size = sum(now)
            page[0] += now
            page[1].append(p.data[at : at + size])
            at += size
        page[2] = p.granule
    out = []
    for n, (lacing, parts, granule, continued) in enumerate(pages):
        kind = CONTINUED * continued | FIRST * (n == 0) | LAST * (n == len(pages) - 1)
        body = bytes(lacing) + b"".join(parts)
        crc = checksum(struct.pack(HEAD, MARK, 0, kind, granule, serial, n, 0, len(lacing)) + body)
        out.append(struct.pack(HEAD, MARK, 0, kind, granule, serial, n, crc, len(lacing)) + body)
    return out


def mux(streams: dict[int, list[Packet]]) -> bytes:
    """All first pages, then the others by turns."""
    pages = {s: pages_of(s, p) for s, p in streams.items()}
    out = [p[0] for p in pages.values()]
    for n in range(1, max((len(p) for p in pages.values()), default=0)):
        out += [p[n] for p in pages.values() if n < len(p)]
    return b"".join(out)


def logical_streams(data: bytes) -> tuple[list[Stream], int]:
    """Streams as they begin, and how many marks led to no sound page. A last page ends a stream, and a first page or one after the last opens another of the same number, as where containers were joined."""
    found: list[Stream] = []
    streams: dict[int, Stream] = {}
    partial: dict[int, list[bytes] | None] = {}
    expected: dict[int, int] = {}
    at = bad = 0
    while (at := data.find(MARK, at)) >= 0:
        head_end = at + HEAD_SIZE
        if head_end > len(data):
            bad += 1
            break
        _, version, kind, granule, serial, number, crc, n = struct.unpack_from(HEAD, data, at)
        body = head_end + n
        lacing = data[head_end:body]
        end = body + sum(lacing)
        if version or len(lacing) < n or end > len(data) or checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            bad += 1
            at += 4
            continue
        if serial not in streams or kind & FIRST or streams[serial].ended:
            found.append(Stream(serial))
            streams[serial] = found[-1]
            partial.pop(serial, None)
            expected.pop(serial, None)
        s = streams[serial]
        s.pages += 1
        s.ended |= bool(kind & LAST)
        if number != expected.get(serial, 0):
            s.lost += 1
            partial[serial] = None
        expected[serial] = number + 1
        parts = partial.get(serial)
        if not kind & CONTINUED:
            parts = []
        done, pos, run = [], body, 0
        for x in lacing:
            run += x
            if x < 255:
                if parts is not None:
                    done.append(Packet(b"".join([*parts, data[pos : pos + run]])))
                parts, pos, run = [], pos + run, 0
        if run or lacing[-1:] == b"\xff":
            if parts is not None:
                parts.append(data[pos : pos + run])
        partial[serial] = parts
        if done:
            done[-1].granule = granule
        s.packets += done
        at = end
    return found, bad


def demux(data: bytes) -> tuple[dict[int, Stream], int]:
    """The first stream of each number, and how many marks led to no sound page."""
    found, bad = logical_streams(data)
    return {s.serial: s for s in reversed(found)}, bad


def timed(stream: Stream, rate: int = RATE) -> list[tuple[float, float]]:
    """(begin, end) in seconds of each packet of samples. A page states where its last packet ends; the others count back from there by their lengths."""
    packets, ends = stream.packets[1:], []
    end = None
    for p in reversed(packets):
        if p.granule >= 0:
            end = p.granule
        ends.append(end)
        end = None if end is None else end - len(p.data)
    return [((e - len(p.data)) / rate, e / rate) if e is not None else (float("nan"), float("nan")) for e, p in zip(reversed(ends), packets)]


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The text's bytes, zeros up to a positive multiple of 64, and how many bytes are text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % UNIT if data else UNIT), len(data)


def store(payload: bytes, n_bytes: int) -> bytes:
    packets = [Packet(struct.pack(INFO, SOUND, RATE, 1, n_bytes), 0)]
    packets += [Packet(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET)]
    cues = [Packet(b"CUES\0\0\0\0", 0)]
    cues += [Packet(struct.pack(CUE, i, zlib.crc32(payload[i : i + STRETCH])), min(i + STRETCH, len(payload))) for i in range(0, len(payload), STRETCH)]
    return mux({SAMPLES: packets, CUES: cues})


def _header(stream: Stream) -> tuple | None:
    """What the header packet says; None where its page was lost."""
    first = stream.packets[0].data if stream.packets else b""
    return struct.unpack(INFO, first) if len(first) == INFO_SIZE and first[:8] == SOUND else None


def load(media: bytes) -> tuple[bytes, dict]:
    """The samples as read back and what the container says of them. Of joined containers, all samples in order."""
    streams, bad = logical_streams(media)
    parts, about = [], {"rate": RATE, "n_bytes": 0, "packets": 0, "seconds": 0.0, "cues": 0, "n_cues": 0}
    cue_streams = [s for s in streams if s.serial == CUES]
    for i, sound in enumerate(s for s in streams if s.serial == SAMPLES):
        header = _header(sound)
        packets = sound.packets[1:] if header else sound.packets
        payload = b"".join([p.data for p in packets])
        rate = header[1] if header and header[1] else RATE
        cues = [struct.unpack(CUE, p.data) for p in cue_streams[i].packets if len(p.data) == struct.calcsize(CUE)] if i < len(cue_streams) else []
        times = timed(sound if header else Stream(SAMPLES, [Packet(b""), *packets]), rate)
        about["rate"] = rate
        about["n_bytes"] += min(header[3], len(payload)) if header else 0
        about["packets"] += len(packets)
        about["seconds"] += times[-1][1] if times else 0.0
        about["cues"] += sum(zlib.crc32(payload[at : at + STRETCH]) == crc for at, crc in cues)
        about["n_cues"] += len(cues)
        parts.append(payload)
    return b"".join(parts), about | {"pages": sum(s.pages for s in streams), "bad": bad, "lost": sum(s.lost for s in streams)}


def features(payload: bytes, about: dict) -> str:
    """Duration by granules, level, zero crossings, and the mean level of eight equal parts."""
    x = np.frombuffer(payload, np.uint8).astype(np.int16) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    parts = np.abs(x[: len(x) // 8 * 8].reshape(8, -1)).mean(1) if len(x) >= 8 else np.zeros(8)
    level = float(np.sqrt(np.mean(x.astype(np.float64) ** 2))) if len(x) else 0.0
    return f"seconds={about['seconds']:.6f};pages={about['pages']};packets={about['packets']};cues={about['cues']}/{about['n_cues']};bad={about['bad']};lost={about['lost']};mean={x.mean() if len(x) else 0:.4f};rms={level:.4f};crossings={crossings};parts={','.join(f'{p:.2f}' for p in parts)}"


def encode(docs: DataFrame) -> DataFrame:
    """(doc_id, media binary): the general form, a column of containers."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([store(*payload_of(t.as_py())) for t in batch.column(1)], pa.binary())], names=["doc_id", "media"])

    return _rows(docs).mapInArrow(run, "doc_id long, media binary")


def decode(media: DataFrame) -> DataFrame:
    """Containers, sound or damaged -> (doc_id, payload, pages, packets, bad, lost, seconds, n_bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [load(m.as_py() or b"") for m in batch.column(1)]
            about = {k: pa.array([a[k] for _, a in got], t) for k, t in (("pages", pa.int64()), ("packets", pa.int64()), ("bad", pa.int64()), ("lost", pa.int64()), ("seconds", pa.float64()), ("n_bytes", pa.int64()))}
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p for p, _ in got], pa.binary()), *about.values()], names=["doc_id", "payload", *about])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, payload binary, pages long, packets long, bad long, lost long, seconds double, n_bytes long")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def digests(docs: DataFrame) -> DataFrame:
    """Stores, reads back and describes each text, without keeping the containers."""
    bounded_batches(docs.sparkSession)
    fields = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                media = store(*payload_of(text.as_py()))
                back, about = load(media)
                rows.append((about["n_bytes"], len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), features(back, about)))
            columns = zip(*rows) if rows else [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, (_, t) in zip(columns, fields))], names=["doc_id", *(n for n, _ in fields)])

    return _rows(docs).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op8_ogg(spark, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
