"""The stored full-text index against scoring every text in plain Python."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.operators import index_search, lexical_index
from lodestone.operators.lexical_index import LexicalIndex, term_counts
from lodestone.sources.scratch import Scratch

WEIGHTS = {"title": 5.0, "body": 1.0}


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def brute(texts, questions, k):
    """texts: id -> (title, body)."""
    n = len(texts)
    tf = {i: Counter() for i in texts}
    length = {}
    for i, (title, body) in texts.items():
        for w in words(title):
            tf[i][w] += WEIGHTS["title"]
        for w in words(body):
            tf[i][w] += WEIGHTS["body"]
        length[i] = len(words(title)) + len(words(body))
    mean = sum(length.values()) / n if sum(length.values()) else 1.0
    df = Counter(w for c in tf.values() for w in c)
    out = []
    for q, text in questions:
        scores = {}
        for w in set(words(text)):
            if df[w]:
                idf = max(1e-6, math.log((n - df[w] + 0.5) / (df[w] + 0.5)))
                for i in texts:
                    if tf[i][w]:
                        scores[i] = scores.get(i, 0) + idf * tf[i][w] * 2.2 / (tf[i][w] + 1.2 * (0.25 + 0.75 * length[i] / mean))
        best = sorted(((-round(s, 6), i) for i, s in scores.items()))[:k]
        out += [(q, i, round(-s, 5), rank) for rank, (s, i) in enumerate(best, 1)]
    return sorted(out)


def frame(spark, texts, owner=lambda i: i.split("#")[0]):
    return spark.createDataFrame([(i, owner(i), *t) for i, t in texts.items()], "id string, owner string, title string, body string")


def some(seed, n, first=0):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    pick = lambda m: " ".join(rng.choices(vocabulary, [1 / (1 + i) for i in range(300)], k=m))
    return {f"d{(first + i) // 2:04}#{i % 2}": (pick(3) if i % 5 else None, pick(rng.randint(0, 60))) for i in range(n)}


def found(index, questions, k=10):
    asked = index.spark.createDataFrame(questions, "query_id int, query string")
    ranked, blocks, read = index.searched(asked, k, WEIGHTS)
    return sorted((r.query_id, r.id, round(r.score, 5), r.rank) for r in ranked.collect()), blocks, read


ASKED = [(1, "w1 w250"), (2, "W7, w8 w9 and nothing"), (3, "w299"), (4, "unknown"), (5, ""), (6, "w0 w1 w2 w3 w0")]


@pytest.fixture()
def index(spark):
    return LexicalIndex(spark, f"{Scratch(spark, 'test-index').path}/i", ["title", "body"], buckets=4, part_size=8)


def test_term_counts(spark):
    df = spark.createDataFrame([(["b", "a", "b"],), ([],), (["é"],)], "ws array<string>")
    got = [[tuple(t) for t in r.t] for r in df.select(term_counts(F.col("ws")).alias("t")).collect()]
    assert got == [[("a", 1), ("b", 2)], [], [("é", 1)]]


def test_search_is_exact_and_reads_less(index, spark):
    texts = some(1, 600)
    index.add(frame(spark, texts), 0)
    assert found(index, ASKED)[0] == brute(texts, ASKED, 10)
    asked = [(1, "w1 w250"), (2, "w0 w1 w2 w200 w201")]
    got, blocks, read = found(index, asked, k=2)
    assert got == brute(texts, asked, 2) and read.count() < 0.5 * blocks.count()


def test_turns_replace_forget_and_compact(index, spark, sf_dir):
    texts, live = some(2, 120), None
    index.add(frame(spark, texts), 0)
    new = some(3, 60, first=100)  # owners d0050 to d0079: some known, some new
    index.add(frame(spark, new), 1)
    owners = {i.split("#")[0] for i in new}
    live = {i: t for i, t in texts.items() if i.split("#")[0] not in owners} | new
    assert found(index, ASKED)[0] == brute(live, ASKED, 10)
    gone = sorted({i.split("#")[0] for i in live})[::3] + ["never seen"]
    index.add(frame(spark, live).limit(0), 2, spark.createDataFrame([(g,) for g in gone], "owner string"))
    live = {i: t for i, t in live.items() if i.split("#")[0] not in gone}
    assert found(index, ASKED)[0] == brute(live, ASKED, 10)
    back = {i: t for i, t in texts.items() if i.split("#")[0] == gone[0]}
    index.add(frame(spark, back), 3)  # one comes again
    live |= back
    want = brute(live, ASKED, 10)
    assert found(index, ASKED)[0] == want
    index.add(frame(spark, back), 3)  # a turn written again changes nothing
    assert found(index, ASKED)[0] == want and index.turns() == [0, 1, 2, 3]
    df = Counter(w for t in live.values() for w in set(words(t[0]) + words(t[1])))
    assert {r.term: r.df for r in index.document_frequencies().collect()} == df
    small = index.compacted(index.folder + "-small")
    assert found(small, ASKED)[0] == want and small.turns() == [0] and small.read("stale").count() == 0
    assert {r.id for r in small.live_units().collect()} == set(live) == {r.id for r in index.live_units().collect()}


def test_a_turn_without_its_counts_is_not_seen(index, spark):
    texts = some(4, 30)
    index.add(frame(spark, texts), 0)
    want = found(index, ASKED)[0]
    blocks = index.read("postings").where("turn = 0").drop("turn")
    blocks.write.partitionBy("bucket").parquet(f"{index.folder}/postings/turn=1")  # as after a loss in the middle of a turn
    assert found(index, ASKED)[0] == want and index.turns() == [0]


def test_empty_and_odd(index, spark):
    assert found(index, ASKED)[0] == [] and index.turns() == [] and index.totals() == (0, 0)
    index.add(frame(spark, {"a": ("x", "y")}).limit(0), 0)
    assert found(index, ASKED)[0] == []
    odd = {"a": (None, None), "b": ("", " \n"), "c": ("Straße ÉTÉ", "x_y x-y 12"), "d": ("w1 " * 3000, "w1 " * 3000), "e": ("same", "same"), "f": ("same", "same")}
    index.add(frame(spark, odd), 1)
    asked = [(1, "été"), (2, "x 12"), (3, "w1"), (4, "same")]
    assert found(index, asked)[0] == brute(odd, asked, 10)


def test_blocks_are_made_where_the_words_of_a_part_are(index, spark):
    """Texts are shuffled once, a row each: entries of words are not."""
    texts = {"a": ("one two", "two  three_two"), "b": (None, "ÉTÉ two"), "c": ("", "")}
    index.add(frame(spark, texts), 0)
    got = {(r.term, r.n, tuple(r.most), r.least): sorted((e.id, e.length, tuple(e.counts)) for e in r.entries) for r in index.read("postings").collect()}
    assert got[("two", 2, (1, 2), 2)] == [("a", 5, (1, 2)), ("b", 2, (0, 1))] and got[("été", 1, (0, 1), 2)] == [("b", 2, (0, 1))] and len(got) == 4
    assert {(r.id, r.length) for r in index.read("units").collect()} == {("a", 5), ("b", 2), ("c", 0)}
    many = spark.range(3000).select(F.col("id").cast("string").alias("id"), F.col("id").cast("string").alias("owner"), F.lit("x").alias("title"), F.concat_ws(" ", F.lit("y"), "id").alias("body"))
    index.part_size, index.folder = 4, index.folder + "-many"
    index.add(many, 0)
    files = spark.read.parquet(f"{index.folder}/postings/turn=0").select("part", F.input_file_name().alias("f"))
    tasks = files.select("part", F.regexp_extract("f", "part-([0-9]+)", 1).alias("task")).distinct().groupBy("part").count()
    assert tasks.where("count > 1").count() == 0  # a part's blocks come from one task, so were not shuffled again



def shuffled_rows(spark, act):
    """Rows that act's stages shuffle."""
    sc = spark.sparkContext._jsc.sc()
    gateway = spark.sparkContext._gateway

    def count():
        sc.listenerBus().waitUntilEmpty()
        stages = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = count()
    act()
    return count() - before


def test_questions_share_the_blocks_that_are_shuffled(index, spark):
    """No row stands for a question, word and unit: many questions of the same common words shuffle its entries no oftener than one."""
    texts = {f"d{i:03}#0": ("same title", f"one two three four five w{i}") for i in range(400)}
    index.part_size = 64
    index.add(frame(spark, texts), 0)
    asked = [(q, f"one two three four five same title w{q}") for q in range(60)]
    rows = spark.createDataFrame(asked, "query_id int, query string")
    assert shuffled_rows(spark, lambda: index.search(rows, 3, WEIGHTS).collect()) < 400 * 60
    assert found(index, asked, 3)[0] == brute(texts, asked, 3)


@pytest.mark.parametrize("masks", [0, 1 << 25])
def test_common_words_are_read_where_a_candidate_is_left(index, spark, monkeypatch, masks):
    """As are blocks that meet their masks in a shuffle, small pieces of parts, units of earlier turns and questions in several blocks."""
    monkeypatch.setattr(index_search, "MASKS", masks)
    monkeypatch.setattr(index_search, "ENTRIES", 50)
    monkeypatch.setattr(lexical_index, "QUESTIONS", 2)
    looked, hopeful = [], index_search.Answer.hopeful
    monkeypatch.setattr(index_search.Answer, "hopeful", lambda *a: looked.append(a) or hopeful(*a))
    texts = {f"d{i:03}#0": (None, f"the of and {'rare' + str(i // 9) if i % 3 == 0 else 'other'} {'x ' * (i % 5)}") for i in range(240)}
    new = {f"d{i:03}#0": ("of", "rare1 of rare2" if i % 2 else "rare2 the") for i in range(20, 40)}
    index.add(frame(spark, texts), 0)
    index.add(frame(spark, new), 1)
    asked = [(1, "the of rare1"), (2, "the of and rare2 unknown"), (3, "the"), (4, "rare77"), (None, "of rare5"), (5, "x x other")]
    live = texts | new
    got, held, read = found(index, asked[:4], 2)
    assert got == brute(live, asked[:4], 2)
    of = lambda rows, q, t: rows.where((F.col("query_id") == q) & (F.col("term") == t)).count()
    assert 0 < of(read, 1, "the") < 0.5 * of(held, 1, "the") and 0 < of(read, 1, "rare1") and looked
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    nobody = [(9 if q is None else q, t) for q, t in asked]
    want = [(None if q == 9 else q, *r) for q, *r in brute(live, nobody, 5)]
    assert sorted(found(index, asked[:4] + asked[5:], 5)[0], key=key) == sorted((r for r in want if r[0] is not None), key=key)
    ranked = index.search(spark.createDataFrame(asked, "query_id int, query string"), 5, WEIGHTS)
    assert sorted(((r.query_id, r.id, round(r.score, 5), r.rank) for r in ranked.collect()), key=key) == sorted(want, key=key)


def test_blocks_are_written_as_they_come(index, spark):
    """Files of all buckets are open at once: blocks are not sorted by bucket and term, which took twice the input of disk; the session's setting is as it was."""
    index.add(frame(spark, some(5, 200)), 0)
    files = sorted({r.f for r in spark.read.parquet(f"{index.folder}/postings/turn=0").select(F.input_file_name().alias("f")).collect()})
    for f in files:
        rows = [(r.part, r.term) for r in spark.read.parquet(f).select("part", "term").coalesce(1).collect()]
        assert [p for p, _ in rows] == sorted(p for p, _ in rows) and len({p for p, _ in rows}) > 1
    assert {r.bucket for r in index.read("postings").select("bucket").distinct().collect()} == {0, 1, 2, 3}
    assert spark.conf.get(lexical_index.WRITERS) == "0"
    spark.conf.set(lexical_index.WRITERS, "2")
    try:
        index.add(frame(spark, some(6, 20)), 1)
        assert spark.conf.get(lexical_index.WRITERS) == "2"
    finally:
        spark.conf.unset(lexical_index.WRITERS)
