"""Token files and centroid clustering against brute force; large ids beside nulls in every operator; joined containers; long texts of many lines."""

import hashlib
import math
import random
import struct
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm import prose, table

from lodestone.llm import centroids, ctw, fingerprints, language, line_dedup, media, mixing, near_dedup, packing, token_files, toxicity
from lodestone.llm.scratch import Scratch

BIG = (1 << 53) + 1


# token files


@pytest.mark.parametrize("n", [1, 2, 1023, 1024, 1025, 5000])
@pytest.mark.parametrize("most", [1, 2, 300, 50257, 1 << 32])
def test_blocks_give_back_their_ids(n, most):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, most, n, dtype=np.uint64).astype("<u4")
    ids[rng.random(n) < 0.03] = most - 1  # outliers
    blocks, starts = token_files.pack_blocks(ids)
    data = memoryview(b"".join(blocks))
    assert len(blocks) == -(-n // token_files.BLOCK) and starts[-1] == len(data)
    assert (token_files.unpack_blocks(data, starts.astype(np.int64), 0, len(blocks))[:n] == ids).all()


def test_a_block_is_as_wide_as_its_percentile():
    ids = np.full(token_files.BLOCK, 7, "<u4")
    ids[::2] = 10
    ids[5] = 60000
    (block,), _ = token_files.pack_blocks(ids)
    least, width, exceptions = struct.unpack_from(token_files.BLOCK_HEAD, block)
    assert (least, width, exceptions) == (7, 2, 1) and len(block) == token_files.BLOCK_HEAD_SIZE + 2 * token_files.BLOCK // 8 + 6


def test_a_run_of_ids_and_a_damaged_file():
    ids = np.random.default_rng(1).integers(0, 50257, 9000).astype("<u2")
    good = token_files.file_bytes(3, 1, 77, [5, None, BIG], [4000, 1, 4999], ids) + token_files.MAGIC
    file = token_files.TokenFile(good)
    assert file.doc_ids.to_pylist() == [5, None, BIG] and file.begins.tolist() == [0, 4000, 4001] and (file.part, file.number, file.before) == (3, 1, 77)
    for start, length in ((0, 1), (1020, 10), (4000, 1), (8999, 50), (9000, 1), (0, 9000)):
        assert (file.ids(start, length) == ids[start : start + length]).all()
    hurt = bytearray(good)
    hurt[len(good) // 2] ^= 1
    for bad in (good[:-1], good[: len(good) // 2], bytes(hurt), b"", token_files.MAGIC):
        with pytest.raises(ValueError):
            token_files.TokenFile(bytes(bad))


def brute_tokens(rows):
    """In the order of doc_id, nulls first."""
    import tokenizers

    tok = tokenizers.Tokenizer.from_file(packing.default_tokenizer())
    start, out = 0, []
    for i, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        out.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def test_token_files_of_odd_rows(spark):
    rows = [(7, "seven words are in this text here"), (None, "no id"), (BIG, None), (BIG + 1, ""), (3, prose(4, 4000)), (1, "é" * 500 + "漢字"), (2, "twice\n"), (2, "twice\n"), (5, "<|endoftext|> x")]
    docs = table(spark, [(i, t, None, "a") for i, t in rows])
    scratch = Scratch(spark, "test-files")
    for name, options in (("some", {}), ("small", {"ranges": 5, "file_ids": 100}), ("one", {"ranges": 1})):
        token_files.write_files(docs, f"{scratch.path}/{name}", **options)
        got = [tuple(r) for r in token_files.located(spark, f"{scratch.path}/{name}", scratch).orderBy("start").collect()]
        assert got == brute_tokens(rows), name
    assert spark.read.format("binaryFile").load(f"{scratch.path}/small").where("length > 0").count() > 3
    ids = token_files.located(spark, f"{scratch.path}/small", scratch, with_ids=True).where("doc_id = 7").first()["ids"]
    assert zlib.crc32(ids) == next(x[3] for x in brute_tokens(rows) if x[0] == 7)
    token_files.write_files(docs.limit(0), f"{scratch.path}/none")
    assert token_files.located(spark, f"{scratch.path}/none", scratch).count() == 0


def test_rows_of_one_doc_id_fill_several_ranges(spark):
    docs = spark.range(300).select(F.when(F.col("id") < 200, 9).otherwise(F.col("id")).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    scratch = Scratch(spark, "test-hot")
    token_files.write_files(docs, f"{scratch.path}/files", ranges=6)
    rows = token_files.read_files(spark, f"{scratch.path}/files")
    assert rows.where("doc_id = 9").select("range").distinct().count() >= 4
    got = token_files.located(spark, f"{scratch.path}/files", scratch).orderBy("start").collect()
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got) and len(got) == 300


def test_token_files_of_the_table(spark, sf_dir):
    want = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in token_files.op11_token_files(spark, sf_dir).orderBy("start").collect()]
    assert got == brute_tokens(want)


# centroids


def brute_clusters(rows, k, rounds, scale=64, dims=64):
    """rows (vec_id, vector) in plain numbers."""
    sound = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    if not sound:
        return []
    c = [v for _, _, v in sorted((i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in sound)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((far(v, x), j) for j, x in enumerate(c))
    for _ in range(rounds):
        groups = {}
        for _, v in sound:
            groups.setdefault(near(v)[1], []).append(v)
        c = [[sum(col) // len(groups[j]) for col in zip(*groups[j])] if j in groups else x for j, x in enumerate(c)]
    out = [(i, near(v)[1], near(v)[0]) for i, v in sound]
    sums = {}
    for _, j, d in out:
        sums[j] = sums.get(j, 0) + d
    return sorted(((i, j, d, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in out), key=repr)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, cluster string, distance int")


def test_clusters_of_odd_vectors(spark):
    rng = random.Random(3)
    f32 = lambda x: float(np.float32(x))
    rows = [(i, [f32(rng.uniform(-1, 1)) for _ in range(64)]) for i in range(60)]
    rows += [(i, [0.0] * 64) for i in (100, 101, 102)] + [(200, [f32(0.5)] * 64), (201, [f32(-0.5)] * 64)]  # ties of distance and norm
    rows += [(7, rows[7][1])] * 5 + [(None, [f32(0.25)] * 64), (BIG, [f32(0.1)] * 64)]
    rows += [(300, None), (301, []), (302, [1.0] * 63), (303, [1.0] * 63 + [None]), (304, [1.0] * 63 + [float("nan")]), (305, [1.0] * 63 + [float("inf")])]
    for k in (1, 3, 16, 500):
        got = sorted((tuple(r) for r in centroids.clustered(vectors(spark, rows), k=k).collect()), key=repr)
        assert got == brute_clusters(rows, k, 3), k
    assert centroids.clustered(vectors(spark, rows[:0])).count() == 0
    assert centroids.clustered(vectors(spark, rows[-6:])).count() == 0
    with pytest.raises(Exception, match="too large"):
        centroids.clustered(vectors(spark, [(1, [3e37] * 64)])).collect()


def test_annulus_leaves_no_nearest_centroid_out():
    rng = np.random.default_rng(5)
    for spread in (1, 3, 400):
        x, c = rng.integers(-spread, spread + 1, (500, 6)), rng.integers(-spread, spread + 1, (40, 6))
        c[10] = c[3]  # equal centroids: the smaller number
        x[:40] = c
        cluster, distance, done = centroids.nearest(x, c)
        d = ((x[:, None, :] - c[None]) ** 2).sum(2)
        assert (cluster == d.argmin(1)).all() and (distance == d.min(1)).all()
    far = np.repeat(np.arange(40)[:, None] * 1000, 6, 1)
    _, _, done = centroids.nearest(far[rng.integers(0, 40, 500)] + rng.integers(-3, 4, (500, 6)), far)
    assert done < 500 * 3  # of 500 * 40


# all operators: numbers that doubles cannot hold, beside a null


@pytest.fixture(scope="module")
def large_ids(spark):
    rows = [(None if i == 3 else BIG + 2 * i, prose(i, 40) if i % 3 else f"the same line of text here\n{prose(9, 60)}", "en" if i % 2 else "fr", "a") for i in range(12)]
    return table(spark, rows).coalesce(1).cache()


@pytest.mark.parametrize(
    "work",
    [
        lambda d: line_dedup.indexed(d).report(d),
        lambda d: language.identified(d),
        lambda d: packing.pack(d),
        lambda d: mixing.apportion(mixing.sized(d).withColumnRenamed("doc_id", "row")).withColumnRenamed("row", "doc_id"),
        lambda d: mixing.mixed(d),
        lambda d: ctw.score_documents(d),
        lambda d: media.digests(d),
        lambda d: near_dedup.near_duplicates(d),
    ],
    ids=["lines", "language", "packing", "mixing", "mixed", "ctw", "media", "near"],
)
def test_large_ids_beside_nulls(large_ids, work):
    known = {r.doc_id for r in large_ids.collect()}
    got = [r.doc_id for r in work(large_ids).select("doc_id").collect()]
    assert set(got) <= known and (len(got) != 12 or set(got) == known)


def test_large_ids_of_the_rest(spark, large_ids):
    known = {r.doc_id for r in large_ids.collect()}
    assert {r.doc_id for r in fingerprints.fingerprint_edits(large_ids).collect()} == known
    labels = spark.createDataFrame([(BIG + 2 * i, 1, i % 2) for i in range(12)], "doc_id long, quality int, toxic int")
    assert {r.doc_id for r in toxicity.score(large_ids, toxicity.teach(large_ids, labels)).collect()} == known


# mended


def test_a_text_of_many_lines_takes_linear_time(spark):
    def seconds(n):
        text = "\n".join(f"a line that three documents have, number {i}" for i in range(n))
        docs = spark.createDataFrame([(i, text) for i in range(3)], "doc_id long, text string")
        index = line_dedup.indexed(docs)
        began = time.time()
        got = index.report(docs).drop("text").orderBy("doc_id").collect()
        assert [r.n_dropped for r in got] == [n, n, 0]
        return time.time() - began

    seconds(1000)
    assert seconds(80_000) < 3 * max(1.0, seconds(40_000))


def test_joined_containers_are_read_one_after_the_other():
    texts = ["first text " * 900, "second", ""]
    stored = [media.store(*media.payload_of(t)) for t in texts]
    whole = b"".join(stored)
    back, about = media.load(whole)
    assert back == b"".join(media.payload_of(t)[0] for t in texts) and about["n_bytes"] == sum(len(t) for t in texts)
    assert about["bad"] == about["lost"] == 0 and about["cues"] == about["n_cues"] > 0
    assert len(media.logical_streams(whole)[0]) == 6
    rng = random.Random(1)
    for _ in range(150):
        hurt = bytearray(whole[: rng.randrange(len(whole))])
        for _ in range(rng.randint(0, 3)):
            if hurt:
                hurt[rng.randrange(len(hurt))] ^= 1 << rng.randrange(8)
        media.load(bytes(hurt))


def test_forged_packets_do_not_stop_the_reader():
    odd = [media.Packet(b""), media.Packet(b"x" * 21, 5), media.Packet(b"y" * 12, 9)]
    forged = struct.pack(media.INFO, media.SOUND, 0, 1, 1 << 63)
    for samples in (odd, [media.Packet(forged, 0), *odd], []):
        for cues in (odd, [media.Packet(b"CUES\0\0\0\0", 0), *odd], []):
            _, about = media.load(media.mux({media.SAMPLES: samples, media.CUES: cues}))
            pa.array([about["n_bytes"]], pa.int64())


def test_containers_by_an_independent_reader():
    """Pages taken apart by the letter of the container's description."""
    payload, n = media.payload_of("word " * 5000)
    data, at, streams = media.store(payload, n), 0, {}
    while at < len(data):
        assert data[at : at + 4] == b"OggS" and data[at + 4] == 0
        serial, n_segments = struct.unpack_from("<I", data, at + 14)[0], data[at + 26]
        lacing = data[at + 27 : at + 27 + n_segments]
        pos, packets = at + 27 + n_segments, streams.setdefault(serial, [[]])
        for x in lacing:
            packets[-1].append(data[pos : pos + x])
            pos += x
            if x < 255:
                packets.append([])
        at = pos
    assert b"".join(b"".join(p) for p in streams[media.SAMPLES][1:]) == payload
