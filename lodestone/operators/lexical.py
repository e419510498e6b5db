"""The lexical index and scorer: postings, document frequencies, BM25, coverage of files and directories, path policy, propagation.

Chunks have chunk_id, path, symbol, language and content. Terms come from functions.query and are few, so each term is
a Column over chunks and no term table is joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.classes import chain
from lodestone.functions.query import Features
from lodestone.sources.scratch import Scratch

# Path words too common to weigh.
COMMON_PATH_TERMS = ["broker", "code", "gpu", "inspect", "inspection", "main", "model", "repo", "repository", "service", "worker"]


def searchable() -> Column:
    return F.lower(F.concat_ws("\n", F.coalesce("symbol", F.lit("")), "content"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def path_parts(path: Column) -> Column:
    return F.array_union(T.identifier_pieces(path), F.filter(F.regexp_extract_all(F.lower(path), F.lit("([a-z0-9_]+)"), 1), lambda p: p != ""))


def n_words() -> Column:
    return F.size(F.filter(F.split(searchable(), "[^\\p{L}\\p{N}]+"), lambda w: w != ""))


def term_hits(terms: list[str]) -> Column:
    """array<struct<term, tf>>: non-overlapping occurrences of each term that occurs at all."""
    counts = T.bound(searchable(), lambda text: F.array(*(F.struct(F.lit(t).alias("term"), F.when(F.contains(text, F.lit(t)), T.occurrences(text, F.lit(t))).otherwise(F.lit(0).cast("long")).alias("tf")) for t in terms)))
    return F.filter(counts, lambda c: c["tf"] > 0)


def postings(chunks: DataFrame, terms: list[str]) -> DataFrame:
    """(term, chunk_id, path, tf). Chunks that come with a column hits are not read again."""
    hits = F.col("hits") if "hits" in chunks.columns else term_hits(terms)
    return chunks.select("chunk_id", "path", F.explode(hits).alias("p")).select("p.term", "chunk_id", "path", "p.tf")


def inverse_frequency(found: DataFrame, n: int, of: str, terms: list[str]) -> DataFrame:
    """(term, df, idf): ln((n + 1) / (df + 1)) + 1 over distinct values of a column; terms without any have df 0."""
    spark = found.sparkSession
    counted = found.groupBy("term").agg(F.count_distinct(of).alias("df"))
    known = spark.createDataFrame([(t,) for t in terms], "term string")
    out = known.join(counted, "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"))
    return out.withColumn("idf", F.log(F.lit(float(max(1, n) + 1)) / (F.col("df") + 1)) + 1.0)


def term_scores(found: DataFrame, idf: DataFrame) -> DataFrame:
    """By chunk: idf (1 + (tf - 1) / 4), tf counted to 3."""
    part = F.col("idf") * (1.0 + (F.least("tf", F.lit(3)) - 1) * 0.25)
    return found.join(F.broadcast(idf), "term").groupBy("chunk_id").agg(F.sum(part).alias("term_score"))


def _strongest(weights: Column, factor: float, terms: list[str]) -> tuple[Column, Column]:
    """Sum of the ten largest weights, and how many of ten there are."""
    top = F.slice(F.sort_array(weights, asc=False), 1, 10)
    return F.aggregate(top, F.lit(0.0), lambda a, x: a + x) * factor, F.size(top) / max(1, min(10, len(terms)))


def file_coverage(chunks: DataFrame, found: DataFrame, terms: list[str]) -> DataFrame:
    """(path, file_coverage) from the terms a file has, damped by its chunks."""
    files = chunks.groupBy("path").agg(F.count(F.lit(1)).alias("chunks"), F.flatten(F.collect_list(T.identifier_pieces(F.coalesce("symbol", F.lit(""))))).alias("pieces"))
    n = files.count()
    idf = inverse_frequency(found, n, "path", terms)
    terms_of = found.select("path", "term").distinct().join(F.broadcast(idf), "term")
    held = terms_of.groupBy("path").agg(F.collect_list(F.least(F.lit(5.0), "idf")).alias("weights"), F.collect_list(F.struct("term", "idf")).alias("terms"))
    rows = files.join(held, "path", "left").withColumn("weights", F.coalesce("weights", F.array().cast("array<double>")))
    total, ratio = _strongest(F.col("weights"), 0.55, terms)
    symbols = F.coalesce(F.aggregate(F.filter("terms", lambda t: F.array_contains("pieces", t["term"])), F.lit(0.0), lambda a, t: a + F.least(F.lit(2.0), t["idf"] * 0.35)), F.lit(0.0))
    score = (total + 5.0 * ratio + F.least(F.lit(4.0), symbols)) / (1.0 + 0.08 * F.log2(F.greatest(F.lit(1), F.col("chunks")).cast("double")))
    return rows.select("path", F.least(F.lit(20.0), score).alias("file_coverage"))


def directory_coverage(chunks: DataFrame, found: DataFrame, terms: list[str]) -> DataFrame:
    """(directory, directory_coverage) from the distinct terms of all its files."""
    paths = chunks.select("path").distinct().withColumn("directory", directory(F.col("path")))
    dirs = paths.groupBy("directory").agg(F.count(F.lit(1)).alias("files"))
    idf = inverse_frequency(found, paths.count(), "path", terms)
    held = found.withColumn("directory", directory(F.col("path"))).select("directory", "term").distinct().join(F.broadcast(idf), "term")
    held = held.groupBy("directory").agg(F.collect_list(F.least(F.lit(5.0), "idf")).alias("weights"))
    rows = dirs.join(held, "directory", "left").withColumn("weights", F.coalesce("weights", F.array().cast("array<double>")))
    total, ratio = _strongest(F.col("weights"), 0.6, terms)
    return rows.select("directory", F.least(F.lit(20.0), (total + 5.0 * ratio) / (1.0 + 0.12 * F.greatest(F.lit(0), F.col("files") - 1))).alias("directory_coverage"))


def matches_path(parts: Column, term: str) -> Column:
    return F.exists(parts, lambda p: (p == term) | p.startswith(term) | p.endswith(term))


def path_boost(chunks: DataFrame, f: Features) -> DataFrame:
    """(path, path_boost): rare query terms in a path weigh more, terms of the query itself more than their aliases."""
    terms = [t.lower() for t in f.terms if len(t) >= 3]
    direct = {t.lower() for t in f.direct_terms}
    paths = chunks.select("path").distinct().withColumn("parts", path_parts(F.col("path")))
    hit = F.filter(F.array(*(F.when(matches_path(F.col("parts"), t), F.lit(t)) for t in terms)), lambda t: t.isNotNull())
    pairs = paths.select("path", F.explode_outer(hit).alias("term"))
    idf = inverse_frequency(pairs.where("term IS NOT NULL"), paths.count(), "path", sorted(set(terms)))
    weight = F.when(F.col("term").isin(*COMMON_PATH_TERMS), 0.75).otherwise(F.least(F.lit(60.0), F.when(F.col("term").isin(*direct), 22.0).otherwise(9.0) * F.col("idf")))
    return pairs.join(F.broadcast(idf), "term", "left").groupBy("path").agg(F.coalesce(F.sum(F.when(F.col("term").isNotNull(), weight)), F.lit(0.0)).alias("path_boost"))


def path_flags(path: Column, language: Column) -> dict[str, Column]:
    p, base, parts = F.lower(path), F.lower(basename(path)), path_parts(path)
    return {
        "test": p.startswith("tests/") | F.contains(p, F.lit("/tests/")) | p.endswith("_test.go") | base.startswith("test_") | base.endswith("_test.py") | F.arrays_overlap(parts, T.lit_array(["fixture", "fixtures", "golden"])),
        "docs": p.startswith("docs/") | base.startswith("readme") | (language == "markdown"),
        "config": p.startswith("configs/") | language.isin("config", "json", "toml", "yaml"),
        "tooling": p.startswith("scripts/") | base.startswith("install"),
        "primary": p.startswith("broker/pkg/") | p.startswith("src/") | p.startswith("internal/"),
        "cmd": p.startswith("cmd/"),
        "examples": p.startswith("examples/"),
        "code": ~language.isin("json", "text", "yaml", "toml", "xml"),
    }


def path_policy(path: Column, language: Column, named: Column, f: Features, architecture: bool = False, call_chain: bool = False) -> dict[str, Column]:
    """pre, add and post: a score becomes (score * pre + add) * post. Tests, docs, configs, examples and tools count less unless the query is about them or names the path."""
    g = path_flags(path, language)
    test, docs = g["test"] & ~named, g["docs"] & ~named
    gentle = f.intent("tests") or f.intent("validation")
    unit = F.when(F.lower(path).startswith("tests/unit/"), 25.0).otherwise(0.0) if f.intent("tests") else F.lit(0.0)
    own = F.lit(2.0) + (chain([(g["primary"], 60.0 if call_chain else 3.0), (g["cmd"], 2.0)], 0.0) if architecture else F.lit(0.0))
    lower = lambda flag, intent, x: F.when(flag, x).otherwise(1.0) if not f.intent(intent) else F.lit(1.0)
    return {
        "pre": chain([(test, 0.7 if gentle else 0.08), (docs, 0.2)], 1.0),
        "add": chain([(test, unit + (20.0 if f.intent("validation") else 0.0)), (docs, 0.0), (g["code"], own)], 0.0),
        "post": lower(g["config"] & ~named, "configuration", 0.3) * lower(g["examples"], "examples", 0.3) * lower(g["tooling"], "tooling", 0.35),
    }


def named_in(path: Column, f: Features, query: str) -> Column:
    """The query names the path: in full, by its base name or by its end."""
    tokens = sorted({p.lower().split(":", 1)[0] for p in f.paths} - {""})
    if not tokens:
        return F.lit(False)
    p = F.lower(path)
    ends = reduce(lambda a, b: a | b, (p.endswith("/" + t) for t in tokens))
    return F.contains(F.lit(query.lower()), p) | p.isin(*tokens) | F.lower(basename(path)).isin(*tokens) | ends


def chunk_bonuses(f: Features) -> dict[str, Column]:
    """Bonuses of a chunk by itself: named identifiers, concepts in its symbol, quoted phrases."""
    symbol = F.lower(F.coalesce("symbol", F.lit("")))
    add = lambda cs: reduce(lambda a, b: a + b, cs, F.lit(0.0))
    return {
        "identifier": T.bound(searchable(), lambda text: add([F.when(symbol == i, 5.0).when(F.contains(text, F.lit(i)), 2.0).otherwise(0.0) for i in (x.lower() for x in f.identifiers)])),
        "concept": F.least(F.lit(30.0), T.bound(symbol, lambda s: T.times_contained(s, f.lexical)) * 8.0),
        "quoted": T.bound(searchable(), lambda text: add([F.when(F.contains(text, F.lit(q.lower())), 4.0).otherwise(0.0) for q in f.quoted])),
    }


def redundancy(chunks: DataFrame) -> DataFrame:
    """(path, symbol_key, redundancy): how often a symbol is in its file and in other files."""
    rows = chunks.withColumn("symbol_key", F.lower(F.coalesce("symbol", F.lit("")))).where("symbol_key <> ''")
    same = rows.groupBy("path", "symbol_key").agg(F.count(F.lit(1)).alias("same"))
    files = same.groupBy("symbol_key").agg(F.count(F.lit(1)).alias("files"))
    score = 10.0 * F.log2(F.lit(1.0) + F.col("same")) + 3.0 * F.greatest(F.lit(0), F.col("files") - 1)
    return same.join(files, "symbol_key").select("path", "symbol_key", F.least(F.lit(80.0), score).alias("redundancy"))


def bm25(found: DataFrame, chunks: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(chunk_id, bm25) over words of the searchable text; idf is ln((n - df + 0.5) / (df + 0.5)), 1e-6 at least."""
    sized = chunks.select("chunk_id", (F.col("n_words") if "n_words" in chunks.columns else n_words()).alias("length"))
    totals = sized.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).first()
    n, mean = totals["n"], totals["mean"] or 1.0
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = df.select("term", F.greatest(F.lit(1e-6), F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("idf"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / mean))
    return found.join(F.broadcast(idf), "term").join(sized, "chunk_id").groupBy("chunk_id").agg(F.sum(part).alias("bm25"))


def index_contribution(scored: DataFrame, top: int = 256) -> DataFrame:
    """(chunk_id, index_score): 1 / rank + 1 / (1 + bm25) of the best by BM25."""
    best = scored.orderBy(F.desc("bm25"), "chunk_id").limit(top)
    rank = F.row_number().over(Window.orderBy(F.desc("bm25"), "chunk_id"))
    return best.select("chunk_id", (1.0 / rank + 1.0 / (1.0 + F.abs("bm25"))).alias("index_score"))


def sibling_bonus(best: DataFrame) -> DataFrame:
    """best (path, best, chunk_id) -> (chunk_id, sibling_bonus): in directories of 2 to 6 files, the others' best chunks share in the strongest."""
    rows = best.withColumn("directory", directory(F.col("path")))
    tops = rows.groupBy("directory").agg(F.count(F.lit(1)).alias("files"), F.max("best").alias("top"), F.max_by("path", F.struct("best", "path")).alias("strongest")).where("files BETWEEN 2 AND 6")
    return rows.join(tops, "directory").where("path <> strongest AND best > 0").select("chunk_id", F.least(F.lit(25.0), F.col("top") * 0.22).alias("sibling_bonus"))


def wrapper_bonus(best: DataFrame, references: DataFrame, f: Features) -> DataFrame:
    """references (path, target): a thin file gets up to 0.9 of the best file that it names, 120 at most, less if it is a test or a document."""
    if not f.intent("wrapper"):
        return best.select("chunk_id", F.lit(0.0).alias("wrapper_bonus")).limit(0)
    target = best.select(F.col("path").alias("target"), F.col("best").alias("reached"))
    g = path_flags(F.col("path"), F.lit(""))
    factor = chain([(g["test"], 0.7 if f.intent("tests") else 0.4 if f.intent("validation") else 0.08), (g["docs"], 0.2)], 1.0)
    reached = references.join(target, "target").groupBy("path").agg(F.least(F.lit(120.0), F.max("reached") * 0.9).alias("bonus"))
    return best.join(reached, "path").select("chunk_id", (F.col("bonus") * factor).alias("wrapper_bonus"))


def references_of(chunks: DataFrame) -> DataFrame:
    """(path, target): base names in a file's text that belong to exactly one other file."""
    names = chunks.select("path").distinct().withColumn("base", basename(F.col("path")))
    unique = names.groupBy("base").agg(F.min("path").alias("target"), F.max("path").alias("last")).where("target = last").select("base", "target")
    said = chunks.select("path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit("([A-Za-z0-9_-]+\\.[A-Za-z0-9]{1,8})"), 1))).alias("base")).distinct()
    return said.join(unique, "base").where("path <> target").select("path", "target")


def file_first(scored: DataFrame, limit: int = 128) -> DataFrame:
    """The best chunk of every file first, then the rest, both by score and id. (chunk_id, path, score) -> rank."""
    lead = scored.withColumn("lead", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("score"), "chunk_id")) == 1)
    top = lead.orderBy(F.desc("lead"), F.desc("score"), "chunk_id").limit(limit)
    return top.select("chunk_id", "path", F.round("score", 8).alias("score"), F.row_number().over(Window.orderBy(F.desc("lead"), F.desc("score"), "chunk_id")).alias("rank"))


def search(chunks: DataFrame, query: str, f: Features, limit: int = 128, with_index: bool = False, ranked: DataFrame | None = None) -> DataFrame:
    """The whole scorer. Every table that it joins is keyed by chunk, path or directory; terms are the only broadcast. ranked (chunk_id, bm25) is what a stored index found, its fields weighted; with_index without it scores words here."""
    terms = f.lexical
    named = named_in(F.col("path"), f, query)
    policy = path_policy(F.col("path"), F.coalesce("language", F.lit("")), named, f)
    bonus = reduce(lambda a, b: a + b, chunk_bonuses(f).values())
    source = chunks
    # Texts are read once; what a chunk has of the query is a few numbers, which the joins below share.
    chunks = chunks.select("chunk_id", "path", "symbol", "language", directory(F.col("path")).alias("directory"), bonus.alias("own"), term_hits(terms).alias("hits"), n_words().alias("n_words"))
    chunks = Scratch(source.sparkSession, "lexical").write(chunks, "chunks")
    found = postings(chunks, terms)
    scores = term_scores(found, inverse_frequency(found, chunks.count(), "chunk_id", terms))
    rows = chunks.drop("hits", "n_words").join(scores, "chunk_id", "left")
    rows = rows.join(file_coverage(chunks, found, terms), "path", "left").join(directory_coverage(chunks, found, terms), "directory", "left").join(path_boost(chunks, f), "path", "left")
    base = F.coalesce("term_score", F.lit(0.0)) + F.col("own") + F.coalesce("file_coverage", F.lit(0.0)) + F.coalesce("directory_coverage", F.lit(0.0)) + F.coalesce("path_boost", F.lit(0.0))
    if f.intent("redundancy"):
        rows = rows.withColumn("symbol_key", F.lower(F.coalesce("symbol", F.lit("")))).join(redundancy(chunks), ["path", "symbol_key"], "left")
        base = base + F.coalesce("redundancy", F.lit(0.0))
    if with_index or ranked is not None:
        rows = rows.join(index_contribution(bm25(found, chunks) if ranked is None else ranked), "chunk_id", "left")
        base = base + F.coalesce("index_score", F.lit(0.0))
    rows = rows.select("chunk_id", "path", ((base * policy["pre"] + policy["add"]) * policy["post"]).alias("score"))
    best = rows.groupBy("path").agg(F.max("score").alias("best"), F.max_by("chunk_id", F.struct("score", "chunk_id")).alias("chunk_id"))
    rows = rows.join(sibling_bonus(best), "chunk_id", "left").join(wrapper_bonus(best, references_of(source), f), "chunk_id", "left") if f.intent("wrapper") else rows.join(sibling_bonus(best), "chunk_id", "left").withColumn("wrapper_bonus", F.lit(0.0))
    rows = rows.select("chunk_id", "path", (F.col("score") + F.coalesce("sibling_bonus", F.lit(0.0)) + F.coalesce("wrapper_bonus", F.lit(0.0))).alias("score"))
    return file_first(rows, limit)


