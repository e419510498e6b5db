"""Strategies, merge, rerank, budgets, evidence, lexical scoring, vectors, fusion, evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions.query import Features, features
from lodestone.operators import evaluation, lexical, retrieval, selection, vectors
from lodestone.operators.chunking import fixed_windows
from lodestone.operators.retrieval import Query
from lodestone.plans.entities import CHUNKS, DOCS, chunks, docs, table
from lodestone.sources.scratch import Scratch

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


ASK = Query("the elle un")
DEBUG = Query("error in src1", "debug_with_local_context", suspects=["src1/"])
ORDER = ["doc_id", "line_start"]
TERMS = ASK.terms


def count_terms(text: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"contains({text}, '{t}')::INT" for t in terms) + ")"


#: What stands before a text where documents are to look like code with open work.
CODED = "CASE doc_id % 4 WHEN 0 THEN concat('# TODO ', source, chr(10)) WHEN 1 THEN concat('def f', doc_id, '():', chr(10), 'class K:', chr(10), '# fixme', chr(10)) WHEN 2 THEN concat('type T interface {', chr(10)) ELSE '' END"


def strategy_query(name: str, strategy: str, q: Query, score_sql: str, extra: str = "", source: str = "chunks", coded: bool = False):
    cut = CHUNKS.replace("text AS content FROM documents", f"concat({CODED}, text) AS content FROM documents") if coded else CHUNKS

    @query(
        name,
        f"""WITH {cut}{extra}, s AS (SELECT chunk_id, doc_id, line_start, round({score_sql}, 3) AS score FROM (SELECT *, lower(content) AS lc, lower(path) AS lp FROM {source}))
        SELECT doc_id, line_start::INT AS line_start, chunk_id, score, place::INT AS place FROM (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id, line_start) AS place FROM s WHERE score > 0) WHERE place <= 24""",
    )
    def run(spark, sf):
        d = docs(spark, sf)
        d = d.withColumn("content", F.concat(F.expr(CODED), "content")) if coded else d
        c = retrieval.grepped_chunks(d, q.terms) if strategy == "ripgrep" else fixed_windows(d)
        return retrieval.candidates_of(c, q, strategy, ORDER).select("doc_id", F.col("line_start").cast("int").alias("line_start"), "chunk_id", "score", F.col("rank").alias("place"))

    return run


HITS = f""", hit AS (SELECT *, ({" + ".join(f"len(list_filter(string_split(content, chr(10)), lambda x: contains(x, '{t}')))" for t in TERMS)}) AS here FROM chunks),
 grepped AS (SELECT *, sum(here) OVER (PARTITION BY input_id) AS hits FROM hit)"""
CODE = "(" + " + ".join(f"contains(lc, '{n}')::INT * 1.5" for n in ("func ", "def ", "class ", "type ", "interface ")) + " + (contains(lc, 'todo') OR contains(lc, 'fixme'))::INT * 0.5)"
LOG = "(" + " + ".join(f"contains(lc, '{n}')::INT * 2.5" for n in ("fatal error", "undefined reference", "exception", "traceback", "failed", "error")) + r" + regexp_matches(lc, '\b(test|fail|panic|exception|traceback)\b')::INT * 2.0)"

strategy_query("strategy_substring", "bm25", ASK, f"{count_terms('lc', TERMS)} * 2.0")
strategy_query("strategy_log_signal", "bm25", Query("the un", "summarize_logs"), f"{count_terms('lc', ['the', 'un'])} * 2.0 + CASE WHEN input_type = 'log' THEN {LOG} ELSE 0 END")
strategy_query("strategy_overlap", "embeddings", ASK, f"CASE WHEN input_type = 'document' THEN {count_terms('lc', TERMS)} * 0.6 ELSE 0 END")
strategy_query("strategy_stack_trace", "stack_trace_path", DEBUG, "regexp_matches(lc, 'trace|panic|error|fail')::INT * 1.5 + contains(lp, 'src1/')::INT * 2.0")
strategy_query("strategy_history", "git_diff_history", DEBUG, "(contains(lc, 'todo') OR contains(lc, 'fixme'))::INT * 0.75", coded=True)
strategy_query("strategy_code_structure", "tree_sitter", ASK, f"CASE WHEN input_type IN ('repo', 'file') THEN {CODE} ELSE 0 END", coded=True)
strategy_query("strategy_grep", "ripgrep", ASK, f"CASE WHEN hits > 0 THEN hits * 2.5 + here + CASE WHEN input_type = 'log' THEN least(hits, 3) * 0.5 ELSE 0 END ELSE {count_terms('lp', TERMS)} * 3.0 + CASE WHEN input_type = 'log' THEN {count_terms('lc', TERMS)} * 1.5 ELSE 0 END END", HITS, "grepped")
strategy_query(
    "strategy_repo_structure",
    "repo_structure",
    Query("src1 the", "inspect_repo"),
    r"CASE WHEN input_type IN ('repo', 'file') THEN 1.0 + 2.2 + (line_start = 1)::INT * 0.6 + regexp_matches(content, '\b(func|class|def|type|interface|struct)\b')::INT * 0.6 + len(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(trim(x), '^(func|def|class) ')))::BOOLEAN::INT * 0.8 + " + f"{count_terms('lp', ['src1', 'the'])} * 2.0 ELSE 0 END",
)

S = {n: f"s_{n}" for n in ("ripgrep", "bm25", "tree_sitter")}
MERGE = f"""{CHUNKS}{HITS}, x AS (SELECT *, lower(content) AS lc, lower(path) AS lp FROM grepped),
 a AS (SELECT *, 0 AS turn, round(CASE WHEN hits > 0 THEN hits * 2.5 + here + CASE WHEN input_type = 'log' THEN least(hits, 3) * 0.5 ELSE 0 END ELSE {count_terms('lp', TERMS)} * 3.0 + CASE WHEN input_type = 'log' THEN {count_terms('lc', TERMS)} * 1.5 ELSE 0 END END, 3) AS score FROM x
   UNION ALL SELECT *, 1, round({count_terms('lc', TERMS)} * 2.0, 3) FROM x
   UNION ALL SELECT *, 2, round(CASE WHEN input_type IN ('repo', 'file') THEN {CODE} ELSE 0 END, 3) FROM x),
 top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY turn ORDER BY score DESC, doc_id, line_start) AS rank FROM a WHERE score > 0) WHERE rank <= 24),
 m AS (SELECT chunk_id, round(sum(score), 3) AS score, min(turn * 100 + rank) AS came, count(DISTINCT turn) AS strategies, arg_min(doc_id, turn * 100 + rank) AS doc_id, arg_min(line_start, turn * 100 + rank) AS line_start FROM top GROUP BY chunk_id),
 best AS (SELECT *, row_number() OVER (ORDER BY score DESC, came) - 1 AS idx FROM m QUALIFY idx < 48)"""


def found(spark, sf):
    """Best candidates of ripgrep, bm25 and tree_sitter, and the chunks of their documents, which are cut again only there."""
    merged = retrieval.merged(retrieval.grepped_chunks(docs(spark, sf), TERMS), ASK, ["ripgrep", "bm25", "tree_sitter"], ORDER)
    best = retrieval.best_candidates(merged)
    rows = Scratch(spark, "found").write(best.select("chunk_id", "score", "came", "matched_strategies", "idx", "at.*"), "rows")  # read twice below
    return rows, fixed_windows(docs(spark, sf, few=rows.select("doc_id").distinct()))  # 48 ids at most


@query("retrieval_merge_topk", f"WITH {MERGE} SELECT chunk_id, score, strategies, idx::INT AS idx FROM best")
def retrieval_merge_topk(spark, sf):
    rows, _ = found(spark, sf)
    return rows.select("chunk_id", "score", F.size("matched_strategies").cast("long").alias("strategies"), F.col("idx").cast("int").alias("idx"))


@query("plan_fallback", f"WITH {CHUNKS}, s AS (SELECT chunk_id, doc_id, line_start, round(1.0 + CASE WHEN input_type IN ('repo', 'file') THEN {CODE} ELSE 0 END, 3) AS score FROM (SELECT *, lower(content) AS lc FROM chunks)), r AS (SELECT *, row_number() OVER (ORDER BY doc_id, line_start) - 1 AS idx FROM s QUALIFY idx < 24) SELECT chunk_id, score, 'fallback' AS strategies, idx::INT AS idx FROM r")
def plan_fallback(spark, sf):
    """A plan of which no strategy finds anything gives the first chunks."""
    out = retrieval.executed(fixed_windows(docs(spark, sf)), Query("qqqqzzzz", "propose_patch"), {"repo", "file"}, ORDER, ["bm25", "stack_trace_path"])
    return out.select("chunk_id", "score", F.array_join("matched_strategies", ",").alias("strategies"), F.col("idx").cast("int").alias("idx"))


@query("plan_executed", f"WITH {MERGE} SELECT chunk_id, score, strategies, idx::INT AS idx FROM best")
def plan_executed(spark, sf):
    """The default plan of a task over all types of input, in one scan."""
    out = retrieval.executed(retrieval.grepped_chunks(docs(spark, sf), TERMS), ASK, {"log", "repo", "file", "document"}, ORDER)
    return out.select("chunk_id", "score", F.size("matched_strategies").cast("long").alias("strategies"), F.col("idx").cast("int").alias("idx"))


RERANK = f"""{MERGE}, j AS (SELECT b.*, c.path, c.content, c.input_type, c.line_end, c.chunk_hash, c.token_estimate FROM best b JOIN chunks c ON b.doc_id = c.doc_id AND b.line_start = c.line_start),
 r AS (SELECT *, round(score + CASE WHEN idx < 3 THEN 0.4 ELSE 0 END + CASE WHEN {count_terms('lower(path)', TERMS)} > 0 THEN 0.8 ELSE 0 END, 3) AS rerank_score FROM j),
 rr AS (SELECT *, row_number() OVER (ORDER BY rerank_score DESC, idx) AS place FROM r)"""


def reranked(spark, sf):
    rows, c = found(spark, sf)
    return retrieval.reranked(rows.join(c.drop("chunk_id"), ORDER), ASK)


@query("rerank", f"WITH {RERANK} SELECT chunk_id, rerank_score, place::INT AS place FROM rr")
def rerank(spark, sf):
    return reranked(spark, sf).select("chunk_id", "rerank_score", "place")


SELECT = f"""{RERANK}, d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_hash ORDER BY place) AS nth FROM rr) WHERE nth = 1),
 u AS (SELECT *, sum(token_estimate) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (ORDER BY place) AS n FROM d), sel AS (SELECT * FROM u WHERE (used <= 64000 OR n = 1) AND n <= 12)"""


def selected(spark, sf):
    return selection.prefix_budget(reranked(spark, sf), "place", 64000)


@query("select_prefix_budget", f"WITH {SELECT} SELECT chunk_id, n::INT AS n, used::BIGINT AS used FROM sel")
def select_prefix_budget(spark, sf):
    return selected(spark, sf).select("chunk_id", "n", "used")


KIND = """CASE WHEN contains(lc, 'fatal error') THEN 'build_error' WHEN contains(lc, 'undefined reference') THEN 'linker_error' WHEN contains(lc, 'exception') OR contains(lc, 'traceback') THEN 'runtime_exception'
 WHEN contains(lc, 'failed') THEN 'test_failure' WHEN contains(lc, 'error') THEN 'generic_error' WHEN contains(lc, 'func ') OR contains(lc, 'def ') THEN 'function' WHEN contains(lc, 'class ') THEN 'class'
 WHEN contains(lc, 'type ') THEN 'type' WHEN contains(lc, 'interface ') THEN 'interface' WHEN input_type = 'log' THEN 'log_context' ELSE 'code_context' END"""
EVIDENCE = rf"""{SELECT}, e AS (SELECT *, {KIND} AS kind, round(least(rerank_score / 10, 0.99), 2) AS relevance, path || ':' || line_start || '-' || line_end AS span,
  trim(list_filter(string_split(content, chr(10)), lambda x: trim(x) <> '')[1]) AS first, array_to_string(list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> '')[1:48], ' ') AS words FROM (SELECT *, lower(content) AS lc FROM sel)),
 ev AS (SELECT 'ev_' || lpad(n::VARCHAR, 3, '0') AS evidence_id, n::INT AS n, kind, CASE WHEN kind IN ('build_error', 'linker_error', 'runtime_exception', 'test_failure', 'generic_error') THEN span || ' contains ' || replace(kind, '_', ' ') || ' context: ' ||
   CASE WHEN length(first) <= 140 THEN first ELSE rtrim(left(first, 137)) || '...' END ELSE span || ' is relevant ' || replace(kind, '_', ' ') || ' context for the query.' END AS claim, chunk_id, path, chunk_hash, relevance,
   CASE WHEN relevance >= 0.5 THEN 0.82 ELSE 0.64 END AS confidence, CASE WHEN length(words) <= 220 THEN words ELSE rtrim(left(words, 217)) || '...' END AS excerpt_preview FROM e)"""


def pack(spark, sf):
    return selection.evidence(selected(spark, sf))


@query("evidence_pack", f"WITH {EVIDENCE} SELECT * FROM ev")
def evidence_pack(spark, sf):
    return pack(spark, sf).drop("line_start", "line_end")


@query("evidence_budget", f"WITH {EVIDENCE} SELECT sum(greatest(1, length(claim) // 4))::BIGINT AS compressed_tokens, sum(greatest(1, length(claim) // 4) + greatest(1, length(excerpt_preview) // 4))::BIGINT AS final_pack_tokens FROM ev")
def evidence_budget(spark, sf):
    return selection.pack_budget(pack(spark, sf))


@query(
    "pack_trim",
    f"WITH {EVIDENCE} SELECT evidence_id, pack_tokens::BIGINT AS pack_tokens FROM (SELECT *, sum(greatest(1, length(claim) // 4) + greatest(1, length(excerpt_preview) // 4)) OVER (ORDER BY n ROWS UNBOUNDED PRECEDING) AS pack_tokens FROM ev) WHERE pack_tokens <= 300 OR n = 1",
)
def pack_trim(spark, sf):
    return selection.trim_pack(pack(spark, sf), 300).select("evidence_id", "pack_tokens")


@query(
    "agent_summary",
    f"""WITH {EVIDENCE} SELECT n, claim AS summary, CASE WHEN kind IN ('build_error', 'linker_error', 'runtime_exception', 'test_failure', 'generic_error') THEN 'observation' ELSE 'hypothesis' END AS claim_type,
    CASE WHEN kind IN ('build_error', 'linker_error', 'runtime_exception', 'test_failure') THEN 'high' WHEN kind = 'generic_error' THEN 'medium' ELSE 'low' END AS severity,
    CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.65 THEN 'medium' ELSE 'low' END AS confidence, evidence_id AS evidence_ref FROM ev WHERE n <= 5""",
)
def agent_summary(spark, sf):
    return selection.findings(pack(spark, sf))


@query("log_clusters", f"WITH {EVIDENCE} SELECT n, kind, count, evidence_id AS representative_evidence_ref FROM (SELECT *, count(*) OVER (PARTITION BY kind) AS count FROM ev) WHERE n <= 4")
def log_clusters(spark, sf):
    return selection.clusters(pack(spark, sf))


@query("debug_hypotheses", f"WITH {EVIDENCE} SELECT n, 'ROOT_' || upper(kind) AS code, claim, confidence, evidence_id FROM ev WHERE n <= 3")
def debug_hypotheses(spark, sf):
    return selection.hypotheses(pack(spark, sf))


@query("retrieval_policy_signals", f"WITH {SELECT} SELECT 2 AS real_modes, 'tree_sitter,runtime_backend' AS degraded, 'LOCAL_RETRIEVAL_DEGRADED,NO_REAL_RETRIEVAL_BACKEND' || CASE WHEN count(*) FILTER (contains(path, 'src3/')) > 0 THEN ',IGNORED_PATH_RETRIEVAL_CONTAMINATION' ELSE '' END AS warnings, coalesce(array_to_string(list_sort(list(path) FILTER (starts_with(path, 'src3/')))[1:8], ','), '') AS contaminated_paths FROM sel")
def retrieval_policy_signals(spark, sf):
    s = retrieval.policy_signals([("ripgrep", "real"), ("bm25", "real"), ("tree_sitter", "fallback")], "heuristic", "rag_compress", selected(spark, sf), ["src3"])
    return s.select("real_modes", *(F.array_join(c, ",").alias(c) for c in ("degraded", "warnings", "contaminated_paths")))


# Lexical scoring: a chunk's symbol is its first word.
LEX_QUERY = "the elle un 'of the' thshe_inner src1"
LEX_TERMS = ["of the", "of", "the", "thshe_inner", "thshe", "inner", "elle", "un", "src1"]
LEX = Features(["of the"], [], ["thshe_inner"], LEX_TERMS, LEX_TERMS, '"of the" OR "thshe_inner" OR "of" OR "the" OR "thshe" OR "inner" OR "elle" OR "un" OR "src1"')
LT = LEX.lexical


def lex_chunks(spark, sf, lines: bool = False):
    c = chunks(spark, sf)
    return c.select(*(["line_start", "line_end"] if lines else []), F.concat_ws("#", "doc_id", "line_start").alias("chunk_id"), "path", "content", F.regexp_extract("content", "([A-Za-z]+)", 1).alias("symbol"), F.expr("CASE doc_id % 4 WHEN 0 THEN 'markdown' WHEN 1 THEN 'python' WHEN 2 THEN 'go' ELSE 'shell' END").alias("language"))


LEXC = f"""{CHUNKS}, lc AS (SELECT doc_id || '#' || line_start AS chunk_id, path, split_part(path, '/', 1) AS directory, regexp_extract(content, '([A-Za-z]+)', 1) AS symbol, lower(regexp_extract(content, '([A-Za-z]+)', 1) || chr(10) || content) AS t FROM chunks),
 terms AS (SELECT unnest([{", ".join(f"'{t}'" for t in LT)}]) AS term), post AS (SELECT * FROM (SELECT term, chunk_id, path, directory, (length(t) - length(replace(t, term, ''))) // length(term) AS tf FROM lc, terms) WHERE tf > 0),
 n AS (SELECT count(*) AS chunks, count(DISTINCT path) AS files FROM lc),
 df AS (SELECT terms.term, count(DISTINCT chunk_id) AS df, count(DISTINCT path) AS fdf FROM terms LEFT JOIN post USING (term) GROUP BY 1),
 idf AS (SELECT term, df, ln((chunks + 1.0) / (df + 1)) + 1 AS idf, ln((files + 1.0) / (fdf + 1)) + 1 AS fidf FROM df, n)"""


@query("lexical_idf", f"WITH {LEXC} SELECT term, df, round(idf, 6) AS idf FROM idf")
def lexical_idf(spark, sf):
    c = lex_chunks(spark, sf)
    return lexical.inverse_frequency(lexical.postings(c, LT), c.count(), "chunk_id", LT).select("term", "df", F.round("idf", 6).alias("idf"))


@query("lexical_term_scores", f"WITH {LEXC} SELECT chunk_id, round(sum(idf * (1 + (least(tf, 3) - 1) * 0.25)), 6) AS term_score FROM post JOIN idf USING (term) GROUP BY chunk_id")
def lexical_term_scores(spark, sf):
    c = lex_chunks(spark, sf)
    p = lexical.postings(c, LT)
    return lexical.term_scores(p, lexical.inverse_frequency(p, c.count(), "chunk_id", LT)).select("chunk_id", F.round("term_score", 6).alias("term_score"))


@query(
    "lexical_directory_coverage",
    f"""WITH {LEXC}, h AS (SELECT DISTINCT directory, term FROM post), g AS (SELECT directory, list_sort(list(least(5.0, fidf)), 'DESC')[1:10] AS w FROM h JOIN idf USING (term) GROUP BY 1), d AS (SELECT directory, count(DISTINCT path) AS files FROM lc GROUP BY 1)
    SELECT directory, round(least(20.0, (0.6 * coalesce(list_sum(w), 0) + 5.0 * coalesce(len(w), 0) / {max(1, min(10, len(LT)))}) / (1 + 0.12 * (files - 1))), 6) AS directory_coverage FROM d LEFT JOIN g USING (directory)""",
)
def lexical_directory_coverage(spark, sf):
    c = lex_chunks(spark, sf)
    return lexical.directory_coverage(c, lexical.postings(c, LT), LT).select("directory", F.round("directory_coverage", 6).alias("directory_coverage"))


@query(
    "lexical_file_coverage",
    rf"""WITH {LEXC}, h AS (SELECT DISTINCT path, term FROM post), g AS (SELECT path, list_sort(list(least(5.0, fidf)), 'DESC')[1:10] AS w FROM h JOIN idf USING (term) GROUP BY 1), d AS (SELECT path, count(*) AS chunks FROM lc GROUP BY 1),
     sp AS (SELECT DISTINCT path, unnest(list_transform(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(symbol, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[^A-Za-z0-9]+'), lambda x: length(x) >= 2), lambda x: lower(x))) AS term FROM lc),
     sy AS (SELECT h.path, sum(least(2.0, fidf * 0.35)) AS s FROM h JOIN sp ON h.path = sp.path AND h.term = sp.term JOIN idf ON idf.term = h.term GROUP BY 1)
    SELECT path, round(least(20.0, (0.55 * coalesce(list_sum(w), 0) + 5.0 * coalesce(len(w), 0) / {max(1, min(10, len(LT)))} + least(4.0, coalesce(s, 0))) / (1 + 0.08 * log2(chunks))), 6) AS file_coverage FROM d LEFT JOIN g USING (path) LEFT JOIN sy USING (path)""",
)
def lexical_file_coverage(spark, sf):
    c = lex_chunks(spark, sf)
    return lexical.file_coverage(c, lexical.postings(c, LT), LT).select("path", F.round("file_coverage", 6).alias("file_coverage"))


@query(
    "lexical_bm25",
    rf"""WITH {LEXC}, sz AS (SELECT chunk_id, len(list_filter(regexp_split_to_array(t, '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) AS len FROM lc), av AS (SELECT avg(len) AS mean, count(*) AS n FROM sz)
    SELECT chunk_id, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS bm25 FROM post JOIN idf USING (term) JOIN sz USING (chunk_id), av GROUP BY chunk_id""",
)
def lexical_bm25(spark, sf):
    c = lex_chunks(spark, sf)
    return lexical.bm25(lexical.postings(c, LT), c).select("chunk_id", F.round("bm25", 6).alias("bm25"))


@query("lexical_redundancy", f"WITH {LEXC}, s AS (SELECT path, lower(symbol) AS symbol_key, count(*) AS same FROM lc WHERE symbol <> '' GROUP BY 1, 2), f AS (SELECT symbol_key, count(*) AS files FROM s GROUP BY 1) SELECT path, symbol_key, round(least(80.0, 10 * log2(1 + same) + 3.0 * (files - 1)), 6) AS redundancy FROM s JOIN f USING (symbol_key)")
def lexical_redundancy(spark, sf):
    return lexical.redundancy(lex_chunks(spark, sf)).withColumn("redundancy", F.round("redundancy", 6))


@query("lexical_total")
def lexical_total(spark, sf):
    return lexical.search(lex_chunks(spark, sf), LEX_QUERY, LEX, with_index=True)


@query("lexical_path_policy", "SELECT DISTINCT source || '/t' || (doc_id % 4) AS path, CASE doc_id % 4 WHEN 0 THEN 0.08 WHEN 1 THEN 0.2 ELSE 1.0 END AS pre, CASE doc_id % 4 WHEN 2 THEN 0.3 WHEN 3 THEN 0.35 ELSE 1.0 END AS post FROM documents")
def lexical_path_policy(spark, sf):
    """Each kind of path under made-up directories."""
    d = table(spark, sf, "documents").select(F.expr("concat(source, '/t', doc_id % 4)").alias("path"), F.expr("CASE doc_id % 4 WHEN 0 THEN 'tests/a_test.go' WHEN 1 THEN 'docs/a.py' WHEN 2 THEN 'examples/a.py' ELSE 'scripts/a.py' END").alias("p")).distinct()
    rule = lexical.path_policy(F.col("p"), F.lit("python"), F.lit(False), features(spark, "cache key"))
    return d.select("path", rule["pre"].alias("pre"), rule["post"].alias("post"))


def query_vector(spark, sf):
    """The vector of row 0: one row, by its key."""
    return table(spark, sf, "embeddings").where("vec_id = 0").first()["embedding"]


COSINE = "list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])))"


@query("vector_topk", f"SELECT e.vec_id, round({COSINE}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {COSINE} DESC, e.vec_id LIMIT 20")
def vector_topk(spark, sf):
    return vectors.top_k(table(spark, sf, "embeddings"), query_vector(spark, sf), 20).select("vec_id", F.round("score", 6).alias("score"))


@query("vector_merge", "WITH d AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(0, len(embedding))) AS dim FROM embeddings), s AS (SELECT label, dim, sum(x) AS x, count(*) AS n FROM d GROUP BY 1, 2) SELECT label, max(n) AS segments, round(sum(x) / sqrt(sum(x * x)), 6) AS total FROM s GROUP BY label")
def vector_merge(spark, sf):
    m = vectors.merge_segments(table(spark, sf, "embeddings"), "label", "embedding")
    return m.select("label", "segments", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("vector_upsert", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label FROM embeddings WHERE vec_id % 10 <> 7")
def vector_upsert(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.lit(1).alias("version"))
    changed = e.where("vec_id % 3 = 0").select("vec_id", (F.col("label") + 100).alias("label"), F.lit(3).alias("version")).unionByName(e.where("vec_id % 3 = 0").withColumn("version", F.lit(2)))
    return vectors.upsert(e, changed, e.where("vec_id % 10 = 7"), "vec_id", "version").select("vec_id", "label")


@query(
    "rrf_fusion",
    f"""WITH a AS (SELECT e.vec_id, {COSINE} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q), v AS (SELECT vec_id, row_number() OVER (ORDER BY s DESC, vec_id) AS rank FROM a QUALIFY rank <= 100),
    l AS (SELECT doc_id AS vec_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 100), f AS (SELECT vec_id::VARCHAR AS chunk_id, round(sum(1.0 / (60 + rank)), 10) AS rrf_score FROM (SELECT * FROM v UNION ALL SELECT * FROM l) GROUP BY 1)
    SELECT chunk_id, rrf_score, row_number() OVER (ORDER BY rrf_score DESC, chunk_id)::INT AS rank FROM f QUALIFY rank <= 64""",
)
def rrf_fusion(spark, sf):
    v = vectors.ranked_top_k(table(spark, sf, "embeddings"), query_vector(spark, sf), 100).select(F.col("vec_id").cast("string").alias("chunk_id"), "rank")
    longest = table(spark, sf, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(100)
    lexical_rank = longest.select(F.col("doc_id").cast("string").alias("chunk_id"), F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")).alias("rank"))
    return selection.reciprocal_rank_fusion([("semantic", v), ("lexical", lexical_rank)]).select("chunk_id", "rrf_score", "rank")


def ranked_docs(spark, sf):
    return docs(spark, sf).select(F.col("source"), F.col("doc_id"), F.col("doc_id").cast("string").alias("chunk_id"), F.expr("greatest(1, char_length(content) div 3)").cast("int").alias("token_estimate"))


@query(
    "greedy_budget",
    f"""WITH RECURSIVE {DOCS}, r AS (SELECT source, doc_id::VARCHAR AS chunk_id, greatest(1, length(content) // 3) AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM docs QUALIFY n <= 16),
    f AS (SELECT source, chunk_id, n, t AS used, TRUE AS took FROM r WHERE n = 1 UNION ALL SELECT r.source, r.chunk_id, r.n, CASE WHEN f.used + r.t <= 4000 THEN f.used + r.t ELSE f.used END, f.used + r.t <= 4000 FROM f JOIN r ON r.source = f.source AND r.n = f.n + 1)
    SELECT source, row_number() OVER (PARTITION BY source ORDER BY n)::INT AS place, chunk_id, used::BIGINT AS used FROM f WHERE took""",
)
def greedy_budget(spark, sf):
    return selection.greedy_budget(ranked_docs(spark, sf), ["doc_id"], 4000, ["source"], 16)


@query("diverse_selection")
def diverse_selection(spark, sf):
    rows = docs(spark, sf).select("source", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("rank"), F.col("doc_id").cast("string").alias("chunk_id"), F.expr("concat('p', doc_id div 60)").alias("path"), F.lit("").alias("namespace"), F.sha2("content", 256).alias("content_hash"), F.expr("cast(greatest(1, char_length(content) div 3) AS int)").alias("token_estimate"))
    return selection.diverse(rows, ["source"], 3000)


@query("pack_trim_longest")
def pack_trim_longest(spark, sf):
    rows = docs(spark, sf).select("source", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("place"), F.col("content").alias("excerpt")).where("place <= 12")
    return selection.trim_longest(rows, ["source"], 1500)


@query(
    "citation_subset",
    """WITH e AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1), f AS (SELECT c.conv_id, c.turn, n, 'ev_' || c.turn AS a, 'ev_' || (c.turn + 2) AS b FROM conversations c JOIN e USING (conv_id))
    SELECT conv_id AS group_id, turn AS finding_id, CASE WHEN turn + 2 < n THEN '' ELSE b END AS unknown_refs, turn + 2 < n AS accepted FROM f""",
)
def citation_subset(spark, sf):
    c = table(spark, sf, "conversations")
    numbered = c.select(F.col("conv_id").alias("group_id"), (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).alias("k"))
    ids = numbered.select("group_id", F.concat(F.lit("ev_"), "k").alias("evidence_id"))
    f = c.select(F.col("conv_id").alias("group_id"), F.col("turn").alias("finding_id"), F.array(F.concat(F.lit("ev_"), "turn"), F.concat(F.lit("ev_"), F.col("turn") + 2)).alias("refs"))
    return selection.cited(f, ids).select("group_id", "finding_id", F.array_join("unknown_refs", ",").alias("unknown_refs"), "accepted")


@query(
    "eval_recall_mrr",
    """WITH r AS (SELECT b.item_id, d.doc_id, row_number() OVER (PARTITION BY b.item_id ORDER BY d.doc_id) AS rank FROM benchmark b JOIN documents d ON d.source = 'src' || (b.item_id % 20) QUALIFY rank <= 30),
    w AS (SELECT item_id, 'src' || (item_id % 20) || '/' || d AS expected, d FROM (SELECT item_id, unnest([item_id % 20, item_id % 20 + 20, item_id % 20 + 400]) AS d FROM benchmark)), h AS (SELECT w.item_id, w.d, min(rank) AS rank FROM w LEFT JOIN r ON r.item_id = w.item_id AND r.doc_id = w.d GROUP BY 1, 2)
    SELECT item_id AS query_id, round(count(*) FILTER (rank <= 10) / count(*), 6) AS recall_at_10, round(coalesce(1.0 / min(rank), 0), 6) AS reciprocal_rank FROM h GROUP BY 1""",
)
def eval_recall_mrr(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.expr("concat('src', item_id % 20)").alias("source"), F.expr("item_id % 20").alias("k"))
    d = table(spark, sf, "documents").select("doc_id", "source")
    ranked = b.join(d, "source").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id"))).where("rank <= 30").select("query_id", F.concat(F.lit("root/"), "source", F.lit("/"), "doc_id").alias("path"), "rank")
    want = b.select("query_id", F.explode(F.array("k", F.col("k") + 20, F.col("k") + 400)).alias("d"), "source").select("query_id", F.concat(F.lit("./"), "source", F.lit("/"), "d").alias("expected"))
    return evaluation.per_query(evaluation.hits(ranked, want))


@query(
    "eval_ordering",
    """WITH r AS (SELECT doc_id % 7 AS query_id, source || '/' AS path, row_number() OVER (PARTITION BY doc_id % 7 ORDER BY n_chars, doc_id) AS rank FROM documents), g AS (SELECT query_id, min(rank) FILTER (path = 'src1/') AS higher_rank, min(rank) FILTER (path = 'src2/') AS lower_rank FROM r GROUP BY 1)
    SELECT query_id, higher_rank::INT AS higher_rank, lower_rank::INT AS lower_rank, higher_rank IS NULL OR coalesce(higher_rank >= lower_rank, FALSE) AS failed FROM g""",
)
def eval_ordering(spark, sf):
    d = table(spark, sf, "documents").select((F.col("doc_id") % 7).alias("query_id"), F.concat("source", F.lit("/")).alias("path"), "n_chars", "doc_id")
    ranked = d.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("n_chars", "doc_id"))).select("query_id", "path", "rank")
    rules = ranked.select("query_id").distinct().select("query_id", F.lit("order").alias("rule"), F.lit("src1/").alias("higher"), F.lit("src2/").alias("lower"))
    return evaluation.ordering_failures(ranked, rules).select("query_id", "higher_rank", "lower_rank", "failed")
