"""Document fingerprints by a threshold-scaled sketch, in DataFrame functions only.

A sketch keeps every shingle hash below a fixed fraction of the hash range (and the least hash of a text in which none
is below it). So sketches grow with their texts, the sketch of a union is the union of sketches below the threshold,
and containment of a short text in a very long one is estimated without bias, which sketches of equal size can't do.

Shingles are five words; a text of one to four words is one shingle. Words are separated by ASCII white space.

The document that follows is found without a global sort in one task: ids are dealt to ranges, each range knows its
own order, and only the first id of each range is compared across ranges. What a document needs of its successor - a
prefix and a sketch - travels to it; whole texts are shuffled once, and each is sketched once.

Defined results: null text is the empty text, with an empty sketch; two empty sketches have likeness 1, an empty one
and another 0; a null doc_id has no successor, so its edited text only loses its tail and near_next is 0; where a
doc_id repeats, its rows have the same successor, and the row with the least text hash stands for it as a successor
(equal texts tie, and give the same); very long texts are read whole; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.scratch import Scratch, documents

WORDS, SCALE = 5, 8
SPACES = r"[\x20\x09-\x0D]+"


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Hashes of all shingles, repeats included."""
    w = F.filter(F.split(text, SPACES), lambda x: x != "")

    def hashes(a: Column) -> Column:
        n = F.size(a)
        whole = F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(a)))
        return F.when(n < words, whole).otherwise(F.transform(F.sequence(F.lit(1), n - (words - 1)), lambda i: F.xxhash64(F.slice(a, i, words))))

    return F.transform(F.array(w), hashes)[0]


def _limit(scale: int) -> Column:
    return F.lit(-(1 << 63) + (1 << 64) // scale)


def _kept(hashes: Column, scale: int) -> Column:
    """Of sorted distinct hashes those below the limit, or the least where there are none."""
    low = F.filter(hashes, lambda x: x < _limit(scale))
    return F.when(F.size(low) > 0, low).otherwise(F.slice(hashes, 1, 1))


def sketch(text: Column, words: int = WORDS, scale: int = SCALE) -> Column:
    """The sorted distinct hashes in the lowest 1 / scale of the range."""

    def keep(h: Column) -> Column:
        low = F.filter(h, lambda x: x < _limit(scale))
        return F.when(F.size(low) > 0, F.array_sort(F.array_distinct(low))).when(F.size(h) > 0, F.array(F.array_min(h))).otherwise(low)

    return F.transform(F.array(shingle_hashes(text, words)), keep)[0]


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of the shingles of two texts together: a stand-in of one goes as soon as the other has a hash below the limit."""
    return F.transform(F.array(F.array_sort(F.array_union(a, b))), lambda u: _kept(u, scale))[0]


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def as_text(s: Column) -> Column:
    return F.concat_ws(",", F.transform(s, lambda x: F.hex(x)))


def successors(ids: DataFrame, scratch: Scratch) -> DataFrame:
    """ids: unique id and other columns -> these and next_id, the id that follows; the first follows the last."""
    dealt = scratch.write(ids.repartitionByRange("id").withColumn("pid", F.spark_partition_id()), "ids")
    inside = dealt.withColumn("next_id", F.lead("id").over(Window.partitionBy("pid").orderBy("id")))
    firsts = dealt.groupBy("pid").agg(F.min("id").alias("first_id"))  # a row for each range
    order = Window.orderBy("pid")
    least = F.min("first_id").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = firsts.select("pid", F.coalesce(F.lead("first_id").over(order), least).alias("after_id"))
    return inside.join(after, "pid").withColumn("next_id", F.coalesce("next_id", "after_id")).drop("pid", "after_id")


def fingerprint_edits(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and how alike it is to that and to the next document."""
    scratch = Scratch(docs.sparkSession, "fingerprints")
    kinds = dict(docs.dtypes)
    # Bare columns where types allow: an alias makes two reads of one table look different, and the shuffle is not reused.
    base = docs.select(*(c if kinds[c] == t else F.col(c).cast(t).alias(c) for c, t in (("doc_id", "bigint"), ("text", "string"))))
    text = F.coalesce("text", F.lit(""))
    main = base.where("doc_id IS NOT NULL")  # shuffled once: bare columns, as plans with lambdas are not reused
    # Each text's sketch is built in the scan and written; what travels afterwards is an eighth of the hashes.
    made = scratch.write(main.select(F.col("doc_id").alias("id"), F.xxhash64(text).alias("h"), sketch(text, scale=scale).alias("sketch"), F.floor(F.char_length(text) / 4).cast("int").alias("quarter")), "sketches")
    ids = made.groupBy("id").agg(F.max("quarter").alias("most"))
    of_id = made.groupBy("id").agg(F.min(F.struct("h", "sketch")).alias("least")).select("id", F.col("least.h").alias("h"), F.col("least.sketch").alias("sketch"))
    links = scratch.write(successors(ids, scratch).select("next_id", F.col("id").alias("to_id"), "most"), "links")
    heads = main.join(links, main["doc_id"] == links["next_id"]).select("to_id", F.struct(F.xxhash64(text).alias("h"), F.substring(text, F.lit(1), F.col("most")).alias("head")).alias("next"))
    heads = heads.groupBy("to_id").agg(F.min("next").alias("next")).select("to_id", F.col("next.head").alias("head"))
    after = of_id.join(links, of_id["id"] == links["next_id"]).select(F.col("to_id").alias("after_id"), F.col("sketch").alias("next_sketch"))
    own = of_id.select(F.col("id").alias("own_id"), F.col("h").alias("own_h"), F.col("sketch").alias("own_sketch"))
    rows = main.join(heads, main["doc_id"] == heads["to_id"], "left").join(own, main["doc_id"] == own["own_id"], "left").join(after, main["doc_id"] == after["after_id"], "left")
    rows = rows.select("doc_id", text.alias("text"), "head", "next_sketch", F.when(F.xxhash64(text) == F.col("own_h"), F.col("own_sketch")).alias("own_sketch"))
    nothing = F.lit(None).cast("array<bigint>")
    lone = base.where("doc_id IS NULL").select("doc_id", text.alias("text"), F.lit("").alias("head"), nothing.alias("next_sketch"), nothing.alias("own_sketch"))
    rows = rows.unionByName(lone).withColumn("n_chars", F.char_length("text").cast("long")).withColumn("k", F.expr("cast(n_chars div 4 as int)"))
    # Only rows that repeat a doc_id with another text, and those without one, are sketched here.
    rows = rows.withColumn("sketch", F.when(F.col("own_sketch").isNotNull(), F.col("own_sketch")).otherwise(sketch(F.col("text"), scale=scale)))
    rows = rows.withColumn("edited", F.expr("concat(left(text, cast(n_chars as int) - k), left(head, k))"))
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited"), scale=scale))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        F.coalesce(likeness(F.col("sketch"), F.col("next_sketch")), F.lit(0.0)).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("kept_share"),
    )


def op9_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint_edits(documents(spark, sf_dir))
