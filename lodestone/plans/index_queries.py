"""What is kept: full-text and vector indexes, chunks by content, fingerprints; built, added to, forgotten from and searched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import semantic
from lodestone.operators.chunk_store import ChunkStore
from lodestone.operators.chunking import fixed_windows
from lodestone.operators.incremental import tree_fingerprints
from lodestone.operators.lexical import index_contribution
from lodestone.operators.lexical_index import LexicalIndex
from lodestone.operators.vector_index import VectorIndex
from lodestone.plans.entities import CHUNKS, DOCS, docs, table
from lodestone.sources.scratch import Scratch

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


FIELDS = ["id", "path", "symbol", "content"]
# How much a word counts in each field.
WEIGHTS = {"id": 8.0, "path": 6.0, "symbol": 1.0, "content": 1.0}


def units(d: DataFrame) -> DataFrame:
    """Chunks of documents as units of an index; a chunk's symbol is its first word, its owner the document's path."""
    symbol = F.regexp_extract("content", "([A-Za-z]+)", 1)
    return fixed_windows(d).select(F.concat_ws("#", "doc_id", "line_start").alias("id"), F.col("path").alias("owner"), "path", symbol.alias("symbol"), "content")


def new_index(spark) -> LexicalIndex:
    return LexicalIndex(spark, f"{Scratch(spark, 'index').path}/index", FIELDS, buckets=16)


def revised(d: DataFrame) -> DataFrame:
    return d.where("doc_id % 6 = 0").withColumn("content", F.concat(F.lit("Revised edition "), "content"))


UNITS = f"{CHUNKS}, u AS (SELECT doc_id, doc_id || '#' || line_start AS id, path, regexp_extract(content, '([A-Za-z]+)', 1) AS symbol, content FROM chunks)"
WORDS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
#: Words of each unit and field.
POSTED = ", posted AS (" + " UNION ALL ".join(f"SELECT doc_id, id, {WEIGHTS[f]} AS weight, unnest({WORDS.format(f)}) AS term FROM u" for f in FIELDS) + ")"
FREQUENCIES = "SELECT term, count(DISTINCT id) AS df FROM posted GROUP BY term"


@query("lexical_index_build", f"WITH {UNITS}{POSTED} {FREQUENCIES}")
def lexical_index_build(spark, sf):
    """In how many chunks each term is."""
    index = new_index(spark)
    index.add(units(docs(spark, sf)), 0)
    return index.document_frequencies()


@query("lexical_index_insert", f"WITH {UNITS.replace('text AS content FROM documents', "CASE WHEN doc_id % 6 = 0 THEN 'Revised edition ' ELSE '' END || text AS content FROM documents")}{POSTED} {FREQUENCIES}")
def lexical_index_insert(spark, sf):
    """The same after two turns: even documents first, then odd ones and new texts of some even ones."""
    index, d = new_index(spark), docs(spark, sf)
    index.add(units(d.where("doc_id % 2 = 0")), 0)
    index.add(units(d.where("doc_id % 2 <> 0").unionByName(revised(d))), 1)
    return index.document_frequencies()


@query("lexical_index_delete", f"WITH {UNITS}{POSTED} {FREQUENCIES.replace('FROM posted', 'FROM posted WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)')}")
def lexical_index_delete(spark, sf):
    """The same after toxic documents are forgotten."""
    index, d = new_index(spark), docs(spark, sf)
    index.add(units(d), 0)
    gone = d.join(table(spark, sf, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi").select(F.col("path").alias("owner"))
    index.add(units(d).limit(0), 1, gone)
    return index.document_frequencies()


RANKED = f"""{UNITS}{POSTED}, tf AS (SELECT id, term, sum(weight) AS tf FROM posted GROUP BY 1, 2), df AS ({FREQUENCIES}), sz AS (SELECT id, count(*) AS length FROM posted GROUP BY 1),
 av AS (SELECT (SELECT count(*) FROM u) AS n, (SELECT sum(length) FROM sz) / (SELECT count(*) FROM u) AS mean),
 sc AS (SELECT query_id, id, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term) JOIN sz USING (id), av GROUP BY 1, 2)"""


@query("lexical_index_topk", f"WITH q AS (SELECT item_id AS query_id, unnest(list_distinct({WORDS.format('text')})) AS term FROM benchmark), {RANKED} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM sc QUALIFY rank <= 10")
def lexical_index_topk(spark, sf):
    """The ten best chunks for each benchmark passage, from the parts of the index that can hold them."""
    index = new_index(spark)
    index.add(units(docs(spark, sf)), 0)
    return index.search(table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), 10, WEIGHTS)


ASKED = "src1 documents thshe inner elle un"


@query("lexical_fts_weighted", f"WITH q AS (SELECT 0 AS query_id, unnest(list_distinct({WORDS.format(repr(ASKED))})) AS term), {RANKED}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM sc QUALIFY rank <= 256) SELECT id AS chunk_id, round(1.0 / rank + 1.0 / (1.0 + abs(score)), 8) AS index_score FROM r")
def lexical_fts_weighted(spark, sf):
    """What full-text rank adds to a chunk's score: 256 chunks at most, words of ids and paths weigh more."""
    index = new_index(spark)
    index.add(units(docs(spark, sf)), 0)
    asked = table(spark, sf, "region").where("r_regionkey = 0").select(F.lit(0).alias("query_id"), F.lit(ASKED).alias("query"))
    found = index.search(asked, 256, WEIGHTS).select(F.col("id").alias("chunk_id"), F.col("score").alias("bm25"))
    return index_contribution(found).withColumn("index_score", F.round("index_score", 8))


DIMS = 64
COSINE = "list_dot_product(a.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])))"
NEAREST = "SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id)::INT AS rank FROM p QUALIFY rank <= 10"


def vectors_of(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "embedding")


def asked_vectors(spark, sf) -> DataFrame:
    """The questions: every hundredth vector."""
    return vectors_of(spark, sf).where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query("vector_index_topk", f"WITH p AS (SELECT q.vec_id AS query_id, a.vec_id AS id, {COSINE} AS score FROM embeddings q JOIN embeddings a ON q.vec_id % 100 = 0) {NEAREST}")
def vector_index_topk(spark, sf):
    """The ten nearest of all vectors for each question, from the cells that can hold them."""
    index = VectorIndex(spark, f"{Scratch(spark, 'vectors').path}/index", DIMS)
    index.build(vectors_of(spark, sf))
    return index.search(asked_vectors(spark, sf)).withColumn("score", F.round("score", 6))


@query(
    "vector_index_upsert",
    f"""WITH a AS (SELECT vec_id, CASE WHEN vec_id % 5 = 1 THEN list_reverse(embedding) ELSE embedding END AS embedding FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
    p AS (SELECT q.vec_id AS query_id, a.vec_id AS id, {COSINE} AS score FROM embeddings q JOIN a ON q.vec_id % 100 = 0) {NEAREST}""",
)
def vector_index_upsert(spark, sf):
    """The same after vectors changed (their components reversed) and those of toxic documents were forgotten."""
    index = VectorIndex(spark, f"{Scratch(spark, 'vectors').path}/index", DIMS)
    rows = vectors_of(spark, sf)
    index.build(rows)
    gone = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    changed = rows.where("vec_id % 5 = 1").withColumn("embedding", F.reverse("embedding")).join(gone, F.col("vec_id") == F.col("id"), "left_anti")
    index.add(changed, 1, gone)
    return index.search(asked_vectors(spark, sf)).withColumn("score", F.round("score", 6))


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_vectors(rows: DataFrame) -> DataFrame:
    """A stand-in for an embedding service: how often each letter occurs."""
    lower = F.lower("content")
    counts = F.array(*((F.length(lower) - F.length(F.replace(lower, F.lit(c), F.lit("")))).cast("double") for c in LETTERS))
    return rows.select("content_hash", counts.alias("embedding"))


def semantic_chunks(d: DataFrame) -> DataFrame:
    return fixed_windows(d).select(F.concat_ws("#", "doc_id", "line_start").alias("chunk_id"), F.col("chunk_hash").alias("content_hash"), "content")


def semantic_outcome(spark, sf) -> semantic.Outcome:
    """The index of a corpus, brought up to date after toxic documents went and every sixth was revised, then searched."""
    index = VectorIndex(spark, f"{Scratch(spark, 'semantic').path}/index", len(LETTERS), "string")
    d = docs(spark, sf)
    semantic.ensure(index, semantic_chunks(d), letter_vectors, "letters", 0)
    kept = d.join(table(spark, sf, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_anti")
    kept = kept.withColumn("content", F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("Revised edition "), "content")).otherwise(F.col("content")))
    return semantic.retrieved(index, semantic_chunks(kept), "the quick brown fox jumps over the lazy dog", letter_vectors, "letters", 50)


VECTOR = "[" + ", ".join(f"(length(lower({{0}})) - length(replace(lower({{0}}), '{c}', '')))::DOUBLE" for c in LETTERS) + "]"
REVISED = CHUNKS.replace("text AS content FROM documents", "CASE WHEN doc_id % 6 = 0 THEN 'Revised edition ' ELSE '' END || text AS content FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")


@query(
    "semantic_retrieval",
    f"""WITH {REVISED}, v AS (SELECT doc_id || '#' || line_start AS chunk_id, {VECTOR.format('content')} AS v FROM chunks), q AS (SELECT {VECTOR.format("'the quick brown fox jumps over the lazy dog'")} AS q),
    s AS (SELECT chunk_id, round(CASE WHEN list_dot_product(v, v) = 0 THEN 0 ELSE list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))) END, 9) AS score FROM v, q)
    SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id)::INT AS rank FROM s QUALIFY rank <= 50""",
)
def semantic_retrieval(spark, sf):
    return semantic_outcome(spark, sf).rows


def files_of(d: DataFrame) -> DataFrame:
    return d.select("path", F.lit("").alias("language"), "content")


def stored_twice(spark, sf) -> ChunkStore:
    """A corpus and what became of it: files of toxic documents went, every sixth was revised, every seventh moved."""
    store, d = ChunkStore(spark, f"{Scratch(spark, 'chunks').path}/store", lambda f: fixed_windows(f.withColumn("input_type", F.lit("file"))), "windows-1"), docs(spark, sf)
    store.add(files_of(d), 0)
    kept = d.join(table(spark, sf, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_anti")
    kept = kept.withColumn("content", F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("Revised edition "), "content")).otherwise(F.col("content")))
    store.add(files_of(kept.withColumn("path", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path")))), 1)
    return store


LATER = f"""{DOCS}, later AS (
  SELECT CASE WHEN doc_id % 7 = 0 THEN 'moved/' ELSE '' END || path AS path, CASE WHEN doc_id % 6 = 0 THEN 'Revised edition ' ELSE '' END || content AS content
  FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
)"""


@query(
    "chunk_incremental",
    f"""WITH {LATER}, ls AS (SELECT path, CASE WHEN content = '' THEN [] ELSE string_split(CASE WHEN ends_with(content, chr(10)) THEN left(content, length(content) - 1) ELSE content END, chr(10)) END AS ls FROM later),
    w AS (SELECT *, unnest(range(0, ((len(ls) - 1) // 40 + 1)::BIGINT)) AS k FROM ls WHERE len(ls) > 0),
    c AS (SELECT path, (k * 40 + 1)::INT AS line_start, least(k * 40 + 40, len(ls))::INT AS line_end, array_to_string(ls[(k * 40 + 1)::BIGINT : least(k * 40 + 40, len(ls))::BIGINT], chr(10)) AS content FROM w)
    SELECT path, line_start, line_end, 'sha256:' || sha256(content) AS content_hash, greatest(1, (length(content) + 2) // 3)::INT AS token_estimate,
      'chunk_' || left(sha256('corpus' || chr(0) || path || chr(0) || line_start || chr(0) || line_end || chr(0) || 0 || chr(0) || 'sha256:' || sha256(content)), 20) AS chunk_id FROM c""",
)
def chunk_incremental(spark, sf):
    """The chunks of the corpus as it became, most of them not cut again."""
    return stored_twice(spark, sf).chunks(1, "corpus").select("path", "line_start", "line_end", "content_hash", "token_estimate", "chunk_id")


@query("chunk_incremental_reuse", f"WITH {LATER}, k AS (SELECT DISTINCT content FROM later), o AS (SELECT DISTINCT content FROM docs) SELECT (SELECT count(*) FROM later) AS files, count(*) FILTER (o.content IS NULL) AS cut, count(*) FILTER (o.content IS NOT NULL) AS reused FROM k LEFT JOIN o ON k.content = o.content")
def chunk_incremental_reuse(spark, sf):
    return stored_twice(spark, sf).reuse(1)


SUMS = "sha256(concat_ws('|', count(*), " + ", ".join(f"sum(('0x' || substr(e, {16 * i + 1}, 16))::UBIGINT::HUGEINT)" for i in range(4)) + "))"


@query(
    "tree_fingerprints",
    f"""WITH {DOCS}, f AS (SELECT 'corpus/' || source || '/' || (doc_id // 50) AS directory, doc_id || '.txt' AS name, sha256(content) AS digest FROM docs),
    c AS (SELECT directory AS path, 3 AS level, count(*) AS entries, {SUMS} AS fingerprint FROM (SELECT directory, sha256(name || chr(0) || digest) AS e FROM f) GROUP BY directory),
    b AS (SELECT p AS path, 2 AS level, count(*) AS entries, {SUMS} AS fingerprint FROM (SELECT regexp_replace(path, '/[^/]*$', '') AS p, sha256(split_part(path, '/', -1) || chr(0) || fingerprint) AS e FROM c) GROUP BY p),
    a AS (SELECT 'corpus' AS path, 1 AS level, count(*) AS entries, {SUMS} AS fingerprint FROM (SELECT sha256(split_part(path, '/', -1) || chr(0) || fingerprint) AS e FROM b)),
    r AS (SELECT '' AS path, 0 AS level, count(*) AS entries, {SUMS} AS fingerprint FROM (SELECT sha256(path || chr(0) || fingerprint) AS e FROM a))
    SELECT * FROM c UNION ALL SELECT * FROM b UNION ALL SELECT * FROM a UNION ALL SELECT * FROM r""",
)
def tree_fingerprint_rows(spark, sf):
    """Fingerprints of all directories of documents laid out in a tree."""
    d = docs(spark, sf).select(F.concat_ws("/", F.lit("corpus"), "source", F.expr("doc_id div 50"), F.concat("doc_id", F.lit(".txt"))).alias("path"), F.sha2("content", 256).alias("digest"))
    return tree_fingerprints(d)
