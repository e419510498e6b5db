"""Chunking, text functions, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import classes as C
from lodestone.functions import text as T
from lodestone.operators import chunking, summaries
from lodestone.plans.entities import CHUNKS, DOCS, LINES, chunks, docs, table
from lodestone.sources import files

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("chunk_fixed_window", f"WITH {CHUNKS} SELECT chunk_id, chunk_hash, input_id, input_type, classification, path, line_start::INT AS line_start, line_end::INT AS line_end, token_estimate::INT AS token_estimate FROM chunks")
def chunk_fixed_window(spark, sf):
    return chunks(spark, sf).select("chunk_id", "chunk_hash", "input_id", "input_type", "classification", "path", F.col("line_start").cast("int").alias("line_start"), F.col("line_end").cast("int").alias("line_end"), "token_estimate")


@query(
    "chunk_manifest",
    f"""WITH {CHUNKS} SELECT count(*) AS chunk_count, sum(token_estimate)::BIGINT AS token_estimate, count(DISTINCT path) AS path_count,
    count(*) FILTER (input_type = 'artifact') AS artifact_chunks, count(*) FILTER (input_type = 'document') AS document_chunks, count(*) FILTER (input_type = 'file') AS file_chunks,
    count(*) FILTER (input_type = 'log') AS log_chunks, count(*) FILTER (input_type = 'repo') AS repo_chunks FROM chunks""",
)
def chunk_manifest(spark, sf):
    return chunking.manifest(chunks(spark, sf))


@query("chunk_path_counts", f"WITH {CHUNKS} SELECT path, count(*) AS chunk_count, min(doc_id) AS first_seen FROM chunks GROUP BY path ORDER BY chunk_count DESC, first_seen LIMIT 24")
def chunk_path_counts(spark, sf):
    return chunking.path_counts(chunks(spark, sf), "doc_id")


@query(
    "chunk_dedup",
    f"""WITH {CHUNKS} SELECT chunk_hash, doc_id, line_start::INT AS line_start, duplicates FROM (
    SELECT *, count(*) OVER (PARTITION BY chunk_hash) - 1 AS duplicates, row_number() OVER (PARTITION BY chunk_hash ORDER BY doc_id, line_start) AS rn FROM chunks) WHERE rn = 1""",
)
def chunk_dedup(spark, sf):
    rows = chunks(spark, sf).select("chunk_hash", "doc_id", F.col("line_start").cast("int").alias("line_start"))
    return chunking.drop_repeated(rows, ["doc_id", "line_start"]).select("chunk_hash", "doc_id", "line_start", "duplicates")


@query(
    "chunk_regions_overlap",
    f"""WITH {DOCS}, {LINES}, w AS (SELECT *, unnest(range(0, (greatest(0, ceil((len(ls) - 12) / 8.0)) + 1)::BIGINT)) AS k FROM lines WHERE len(ls) > 0),
    c AS (SELECT doc_id, k * 8 + 1 AS line_start, least(k * 8 + 12, len(ls)) AS line_end, array_to_string(ls[(k * 8 + 1)::BIGINT : least(k * 8 + 12, len(ls))::BIGINT], chr(10)) AS content FROM w)
    SELECT doc_id, line_start::INT AS line_start, line_end::INT AS line_end, sha256(content) AS content_sha256, greatest(1, (length(content) + 2) // 3)::INT AS token_estimate
    FROM c WHERE trim(content, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''""",
)
def chunk_regions_overlap(spark, sf):
    """Windows of 12 lines with 4 in common, so that many documents have several."""
    rows = chunking.region_windows(docs(spark, sf), size=12, overlap=4)
    return rows.select("doc_id", F.col("line_start").cast("int").alias("line_start"), F.col("line_end").cast("int").alias("line_end"), F.sha2("content", 256).alias("content_sha256"), T.tokens_v2(F.col("content")).alias("token_estimate"))


@query("chunk_v2_ids")
def chunk_v2_ids(spark, sf):
    """Whole v2 chunking: markers, regions, byte limit, ids."""
    rows = docs(spark, sf).select("path", F.lit("python").alias("language"), "content")
    return chunking.source_regions(rows, namespace="corpus").drop("content")


# A source text for each page, of eight lines in one of seven languages, from its id and url.
SOURCES = {
    "go": ["package p{n}", "", "func (s *S) Run{n}(x int) {{", "}}", "type T{n} struct {{", "  x int // {u}", "}}", "func main() {{}}"],
    "javascript": ["// {u}", "export async function f{n}(a) {{", "}}", "const h{n} = (a) => a", "class K{n} {{", "  m() {{}}", "}}", "let z{n}=1"],
    "java": ["// {u}", "public class A{n} {{", "  synchronized void f{n}() {{", "  }}", "  private static int g{n}(int x) {{", "  }}", "}}", "// end"],
    "cpp": ["// {u}", "template <class T> int f{n}(T x) {{", "  return 0;", "}}", "int g{n}(int x) {{", "  return x;", "}}", "// end"],
    "rust": ["// {u}", "pub(crate) async fn f{n}() {{", "}}", "pub struct P{n};", "impl P{n} {{", "  fn m(&self) {{}}", "}}", "// end"],
    "shell": ["# {u}", "f{n}() {{", "  echo 1", "}}", "function g{n} () {{", "  echo 2", "}}", "# end"],
    "python": ["# {u}", "def f{n}(a):", "    return a", "class K{n}:", "    def m(self):", "        pass", "async def h{n}():", "    pass"],
}
# What stands where in them, by the rules of the markers: a declaration after a blank line begins with that line's end.
DECLARED = {"go": [(3, "Run{n}"), (5, "T{n}"), (8, "main")], "javascript": [(2, "f{n}"), (4, "h{n}"), (5, "K{n}"), (8, "z{n}")], "java": [(2, "A{n}"), (3, "f{n}"), (5, "g{n}")], "cpp": [(2, "f{n}"), (5, "g{n}")], "rust": [(2, "f{n}"), (4, "P{n}"), (5, "P{n}"), (6, "m")], "shell": [(2, "f{n}"), (5, "g{n}")], "python": [(2, "f{n}"), (4, "K{n}"), (5, "K{n}.m"), (7, "h{n}")]}


def _filled(template: str) -> str:
    """SQL of a template with a page's id and url in place of n and u."""
    said = template.replace("{{", "{").replace("}}", "}")
    return "replace(replace('" + said.replace("'", "''") + "', '{n}', page_id::VARCHAR), '{u}', coalesce(url, ''))"


@query(
    "symbol_markers",
    "WITH p AS (SELECT page_id, url, CASE page_id % 7 " + " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(SOURCES)) + " END AS language FROM pages) "
    + " UNION ALL ".join(f"SELECT page_id, language, {line}::INT AS line, {_filled(symbol)} AS symbol FROM p WHERE language = '{name}'" for name, found in DECLARED.items() for line, symbol in found),
)
def symbol_markers(spark, sf):
    """Declarations in generated source texts of seven languages."""
    name = F.element_at(T.lit_array(list(SOURCES)), (F.col("page_id") % 7 + 1).cast("int"))
    fill = lambda t: F.replace(F.replace(F.lit(t.replace("{{", "{").replace("}}", "}")), F.lit("{n}"), F.col("page_id").cast("string")), F.lit("{u}"), F.coalesce("url", F.lit("")))
    content = F.coalesce(*(F.when(F.col("language") == k, F.concat_ws("\n", *map(fill, v))) for k, v in SOURCES.items()))
    p = table(spark, sf, "pages").select("page_id", "url", name.alias("language")).withColumn("content", content)
    return p.select("page_id", "language", F.inline(chunking.markers_of(F.col("content"), F.col("language"))))


@query(
    "text_tokens",
    "SELECT doc_id, greatest(1, length(text) // 4)::INT AS tokens_v1, greatest(1, (length(text) + 2) // 3)::INT AS tokens_v2, sha256(text) AS text_sha256, strlen(text)::INT AS n_bytes FROM documents",
)
def text_tokens(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.tokens_v1(F.col("text")).alias("tokens_v1"), T.tokens_v2(F.col("text")).alias("tokens_v2"), F.sha2("text", 256).alias("text_sha256"), F.octet_length("text").alias("n_bytes"))


WORDS_SQL = r"list_filter(regexp_split_to_array(text, '[\s\x1C-\x1F\x{85}\x{A0}]+'), lambda x: x <> '')"


@query(
    "text_compress",
    rf"""WITH w AS (SELECT doc_id, text, array_to_string(({WORDS_SQL})[1:48], ' ') AS c FROM documents)
    SELECT doc_id, CASE WHEN length(c) <= 220 THEN c ELSE rtrim(left(c, 217)) || '...' END AS compressed, CASE WHEN length(t) <= 60 THEN t ELSE rtrim(left(t, 57), ' ' || chr(10)) || '...' END AS truncated
    FROM (SELECT *, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM w)""",
)
def text_compress(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.compress(F.col("text")).alias("compressed"), T.truncate(F.col("text"), 60).alias("truncated"))


@query(
    "identifier_pieces",
    r"""SELECT DISTINCT p_name, array_to_string(list_transform(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(v, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[^A-Za-z0-9]+'), lambda x: length(x) >= 2), lambda x: lower(x)), ',') AS pieces
    FROM (SELECT p_name, p_name || '_' || p_brand || 'HTTPServer/' || p_type AS v FROM part)""",
)
def identifier_pieces(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_name", F.array_join(T.identifier_pieces(F.concat("p_name", F.lit("_"), "p_brand", F.lit("HTTPServer/"), "p_type")), ",").alias("pieces")).distinct()


@query("query_terms", "SELECT item_id, array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z0-9_./:-]+'), lambda x: length(x) > 1), ',') AS terms FROM benchmark")
def query_terms(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(T.query_terms_column(F.col("text")), ",").alias("terms"))


@query(
    "language_and_role_maps",
    f"""WITH {DOCS} SELECT path, CASE WHEN ends_with(path, '.go') THEN 'go' WHEN ends_with(path, '.py') THEN 'python' WHEN ends_with(path, '.md') THEN 'docs' ELSE 'shell' END AS language,
    CASE WHEN contains(n, 'worker') THEN 'worker runtime' WHEN contains(n, 'config') THEN 'configuration' WHEN contains(n, 'test') THEN 'tests' ELSE 'repository subsystem' END AS role,
    'file:' || path AS source_ref FROM (SELECT *, CASE doc_id % 4 WHEN 0 THEN 'Workers' WHEN 1 THEN 'my-config' WHEN 2 THEN 'latest' ELSE source END AS m, lower(CASE doc_id % 4 WHEN 0 THEN 'Workers' WHEN 1 THEN 'my-config' WHEN 2 THEN 'latest' ELSE source END) AS n FROM docs)""",
)
def language_and_role_maps(spark, sf):
    d = docs(spark, sf).withColumn("m", F.expr("CASE doc_id % 4 WHEN 0 THEN 'Workers' WHEN 1 THEN 'my-config' WHEN 2 THEN 'latest' ELSE source END"))
    return d.select("path", C.summary_language(F.col("path")).alias("language"), C.role(F.col("m")).alias("role"), C.source_ref(F.lit("file"), F.col("path")).alias("source_ref"))


KIND_SQL = """CASE WHEN contains(lc, 'fatal error') THEN 'build_error' WHEN contains(lc, 'undefined reference') THEN 'linker_error' WHEN contains(lc, 'exception') OR contains(lc, 'traceback') THEN 'runtime_exception'
 WHEN contains(lc, 'failed') THEN 'test_failure' WHEN contains(lc, 'error') THEN 'generic_error' WHEN contains(lc, 'func ') OR contains(lc, 'def ') THEN 'function' WHEN contains(lc, 'class ') THEN 'class'
 WHEN contains(lc, 'type ') THEN 'type' WHEN contains(lc, 'interface ') THEN 'interface' WHEN input_type = 'log' THEN 'log_context' ELSE 'code_context' END"""


@query(
    "chunk_kind",
    f"""WITH {CHUNKS}, k AS (SELECT *, {KIND_SQL} AS kind FROM (SELECT *, lower(content) AS lc FROM chunks))
    SELECT kind, input_type, count(*) AS chunks, CASE WHEN kind IN ('build_error', 'linker_error', 'runtime_exception', 'test_failure') THEN 'high' WHEN kind = 'generic_error' THEN 'medium' ELSE 'low' END AS severity,
    CASE WHEN kind IN ('build_error', 'linker_error', 'runtime_exception', 'test_failure', 'generic_error') THEN 'observation' ELSE 'hypothesis' END AS claim_type FROM k GROUP BY kind, input_type""",
)
def chunk_kind(spark, sf):
    k = chunks(spark, sf).select(C.chunk_kind(F.col("content"), F.col("input_type")).alias("kind"), "input_type")
    return k.groupBy("kind", "input_type").agg(F.count(F.lit(1)).alias("chunks")).select("kind", "input_type", "chunks", C.severity(F.col("kind")).alias("severity"), C.claim_type(F.col("kind")).alias("claim_type"))


@query(
    "document_summary",
    rf"""WITH {DOCS}, {LINES}, f AS (SELECT doc_id, ls, content, len({WORDS_SQL.replace("text", "content")}) AS wc, array_to_string({WORDS_SQL.replace("text", "content")}, ' ') AS flat,
      list_filter(list_transform(ls, lambda x: trim(x, ' ' || chr(9))), lambda x: x <> '') AS filled FROM lines)
    SELECT doc_id, len(ls)::INT AS line_count, wc::INT AS word_count,
      CASE WHEN wc = 0 THEN 'The document is empty.' ELSE 'The document contains ' || wc || ' words across ' || len(ls) || ' lines. Opening sentence: ' ||
        CASE WHEN contains(flat, '. ') THEN left(split_part(flat, '. ', 1), 240) || '.' WHEN contains(flat, '! ') THEN left(split_part(flat, '! ', 1), 240) || '!' WHEN contains(flat, '? ') THEN left(split_part(flat, '? ', 1), 240) || '?' ELSE left(flat, 240) END END AS summary,
      array_to_string(CASE WHEN len(list_filter(filled, lambda x: regexp_matches(x, '^(-|\*|[123]\.)'))) > 0 THEN list_transform(list_filter(filled, lambda x: regexp_matches(x, '^(-|\*|[123]\.)'))[1:5], lambda x: left(x, 240)) ELSE list_transform(filled[1:3], lambda x: left(x, 240)) END, '|') AS key_points,
      sha256(array_to_string(list_transform(list_filter(ls, lambda x: trim(x, ' ' || chr(9)) <> ''), lambda x: rtrim(x, ' ' || chr(9)))[1:20], chr(10))) AS excerpt_sha256 FROM f""",
)
def document_summary(spark, sf):
    return summaries.document_summary(docs(spark, sf)).withColumn("key_points", F.array_join("key_points", "|")).withColumn("excerpt_sha256", F.sha2("excerpt", 256)).drop("excerpt")


HOT = "regexp_matches(lower(x), 'error|failed|exception|fatal|undefined')"


@query(
    "log_findings",
    f"""WITH {DOCS}, {LINES}, f AS (SELECT doc_id, ls, list_filter(ls, lambda x: {HOT}) AS hot, content FROM lines WHERE input_type = 'log')
    SELECT doc_id, len(ls)::INT AS line_count, left(ls[1], 32) AS log_start, left(coalesce(hot[len(hot)], ls[len(ls)]), 32) AS failure,
      CASE WHEN len(ls) = 0 THEN '' WHEN array_to_string(known, ',') = '' THEN 'GENERIC_LOG_FAILURE' ELSE array_to_string(known, ',') END AS codes,
      sha256(array_to_string(list_transform(CASE WHEN len(hot) > 0 THEN hot[1:20] ELSE ls[1:20] END, lambda x: rtrim(x, ' ' || chr(9))), chr(10))) AS excerpt_sha256
    FROM (SELECT *, list_filter([CASE WHEN contains(content, 'fatal error:') THEN 'MISSING_GENERATED_HEADER' END, CASE WHEN contains(content, 'undefined reference') THEN 'UNDEFINED_REFERENCE' END,
      CASE WHEN contains(content, 'ModuleNotFoundError') THEN 'MODULE_NOT_FOUND' END, CASE WHEN contains(content, 'FAILED') THEN 'TEST_FAILURE' END], lambda x: x IS NOT NULL) AS known FROM f)""",
)
def log_findings(spark, sf):
    s = summaries.log_summary(docs(spark, sf).where("input_type = 'log'"))
    return s.select("doc_id", "line_count", "log_start", "failure", F.array_join("codes", ",").alias("codes"), F.sha2("excerpt", 256).alias("excerpt_sha256"))


@query(
    "log_shard_reduce",
    f"""WITH {DOCS}, k AS (SELECT source, doc_id, contains(content, 'FAILED') AS failed FROM docs WHERE input_type = 'log'),
    u AS (SELECT source, count(*) AS shards, min(CASE WHEN failed THEN doc_id END) AS f, min(CASE WHEN NOT failed THEN doc_id END) AS g FROM k GROUP BY source)
    SELECT source, shards, CASE WHEN f IS NULL THEN 'GENERIC_LOG_FAILURE' WHEN g IS NULL THEN 'TEST_FAILURE' WHEN f < g THEN 'TEST_FAILURE,GENERIC_LOG_FAILURE' ELSE 'GENERIC_LOG_FAILURE,TEST_FAILURE' END AS codes,
    'Aggregated ' || shards || ' log shard analyses. Primary classified issue: ' || CASE WHEN f IS NULL OR g < f THEN 'GENERIC_LOG_FAILURE' ELSE 'TEST_FAILURE' END || '.' AS summary FROM u""",
)
def log_shard_reduce(spark, sf):
    d = docs(spark, sf).where("input_type = 'log'")
    s = summaries.log_summary(d).join(d.select("doc_id", "source"), "doc_id")
    return summaries.reduce_logs(s, "source", "doc_id").select("source", "shards", F.array_join("codes", ",").alias("codes"), "summary")


@query(
    "log_redaction",
    r"""SELECT doc_id, CASE WHEN contains(l, 'token=') THEN split_part(l, 'token=', 1) || 'token=[REDACTED]' ELSE l END AS line_redacted, regexp_replace(l, '(?i)(token=)([^&\s]+)', '\1[REDACTED]', 'g') AS log_redacted
    FROM (SELECT doc_id, 'id ' || doc_id || CASE WHEN doc_id % 2 = 0 THEN ' token=' || n_chars || '&a=1 rest' ELSE ' plain' END AS l FROM documents)""",
)
def log_redaction(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.expr("concat('id ', doc_id, CASE WHEN doc_id % 2 = 0 THEN concat(' token=', n_chars, '&a=1 rest') ELSE ' plain' END)").alias("l"))
    return d.select("doc_id", T.redact_line(F.col("l")).alias("line_redacted"), T.redact_log(F.col("l")).alias("log_redacted"))


@query(
    "repo_manifest",
    f"""WITH {DOCS}, c AS (SELECT source AS repo, CASE doc_id % 4 WHEN 0 THEN 'docs' WHEN 1 THEN 'python' WHEN 2 THEN 'go' ELSE 'shell' END AS language, count(*) AS files, min(path) AS first_path FROM docs GROUP BY 1, 2)
    SELECT repo, language, files, first_path, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY files DESC, first_path) AS place FROM c) WHERE place <= 3""",
)
def repo_manifest(spark, sf):
    files = summaries.manifest(docs(spark, sf).select(F.col("source").alias("repo"), "path", F.octet_length("content").alias("size")))
    return summaries.languages(files)


@query(
    "repo_subsystems",
    f"""WITH {DOCS}, h AS (SELECT *, row_number() OVER (PARTITION BY input_type ORDER BY path) AS n FROM docs), c AS (SELECT input_type AS repo, split_part(path, '/', 1) AS name, count(*) AS file_count, min(path) AS first_path FROM h WHERE n <= 500 GROUP BY 1, 2)
    SELECT repo, place::INT AS place, name, 'repository subsystem' AS role, name || '/' AS path, file_count FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY file_count DESC, first_path) AS place FROM c) WHERE place <= 5""",
)
def repo_subsystems(spark, sf):
    return summaries.subsystems(docs(spark, sf).select(F.col("input_type").alias("repo"), "path")).drop("confidence")


@query(
    "repo_dependencies",
    f"""WITH {DOCS} SELECT source AS repo, CASE WHEN bool_or(ends_with(path, '.py')) THEN 'Python 3' ELSE '' END AS dependencies,
    'Repository does not yet contain a dedicated broker package.|No tests directory was found.' AS risks FROM docs GROUP BY source""",
)
def repo_dependencies(spark, sf):
    return summaries.dependencies_and_risks(docs(spark, sf).select(F.col("source").alias("repo"), "path")).select("repo", F.array_join("dependencies", ",").alias("dependencies"), F.array_join("risks", "|").alias("risks"))


@query(
    "shard_left_join_coverage",
    """WITH c AS (SELECT l_orderkey AS parent, l_linenumber AS child, CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_returnflag = 'A' THEN 'pending' ELSE 'ready' END AS o FROM (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2))
    SELECT parent, count(*) AS children_total, count(*) FILTER (o = 'ready') AS children_succeeded, count(*) FILTER (o <> 'ready') AS children_failed, round(count(*) FILTER (o = 'ready') / count(*), 6) AS coverage_fraction FROM c GROUP BY parent""",
)
def shard_left_join_coverage(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("parent"), "l_linenumber").agg(F.max("l_returnflag").alias("l_returnflag"))
    rows = rows.select("parent", F.concat_ws("-", "parent", "l_linenumber").alias("child"), "l_returnflag")
    results = rows.where("l_returnflag NOT IN ('R', 'A')").select("child", F.lit("{}").alias("payload"))
    states = rows.select("child", F.when(F.col("l_returnflag") == "R", "failed").otherwise("running").alias("state"))
    return summaries.coverage(summaries.child_outcomes(rows.select("parent", "child"), results, states)).withColumn("coverage_fraction", F.round("coverage_fraction", 6))


@query(
    "path_filters",
    """WITH p AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'a/node_modules/x.js' WHEN 1 THEN 'src/slurm-12.out' WHEN 2 THEN 'keep/go.mod' WHEN 3 THEN 'private/k.toml' WHEN 4 THEN 'x/.env' ELSE 'b/c.TSX' END AS path FROM documents)
    SELECT doc_id, path, doc_id % 6 IN (0, 1, 3) AS skipped, CASE doc_id % 6 WHEN 0 THEN 'javascript' WHEN 1 THEN '' WHEN 2 THEN 'go-module' WHEN 3 THEN 'toml' WHEN 4 THEN 'config' ELSE 'typescript' END AS language FROM p""",
)
def path_filters(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.expr("CASE doc_id % 6 WHEN 0 THEN 'a/node_modules/x.js' WHEN 1 THEN 'src/slurm-12.out' WHEN 2 THEN 'keep/go.mod' WHEN 3 THEN 'private/k.toml' WHEN 4 THEN 'x/.env' ELSE 'b/c.TSX' END").alias("path"))
    return d.select("doc_id", "path", C.is_skipped(F.col("path"), below=["private"]).alias("skipped"), C.language_of_path(F.col("path")).alias("language"))


@query("uri_normalize", r"SELECT page_id, 'file:///' || regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '/+', '/', 'g'), '/$', '') AS normalized, regexp_replace(url, '^https?://', '') AS artifact_id FROM pages")
def uri_normalize(spark, sf):
    p = table(spark, sf, "pages")
    rest = F.regexp_replace("url", "^https?://", "")
    return p.select("page_id", files.normalized_uri(F.concat(F.lit("repo://"), rest)).alias("normalized"), files.artifact_id(F.concat(F.lit("artifact://"), rest)).alias("artifact_id"))


@query("grep_lines", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '' ELSE 'src/p' || page_id END AS path, CASE WHEN page_id % 3 = 1 THEN page_id ELSE 0 END::INT AS line_no, CASE WHEN page_id % 3 = 0 THEN '' ELSE url END AS text FROM pages")
def grep_lines(spark, sf):
    line = F.expr("CASE page_id % 3 WHEN 0 THEN concat('src/p', page_id) WHEN 1 THEN concat('src/p', page_id, ':', page_id, ':', url) ELSE concat('src/p', page_id, ':x:', url) END")
    return table(spark, sf, "pages").select("page_id", files.grep_line(line).alias("g")).select("page_id", "g.path", "g.line_no", "g.text")


@query("log_lines", f"WITH {DOCS}, {LINES}, e AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS n FROM lines WHERE input_type = 'log') SELECT doc_id, count(*) AS lines, count(*) FILTER (regexp_matches(lower(line), 'error|failed|exception|fatal|undefined')) AS interesting, max(n)::INT AS last_line FROM e GROUP BY 1")
def log_lines(spark, sf):
    rows = files.numbered_lines(docs(spark, sf).where("input_type = 'log'").select("doc_id", "content"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(T.interesting(F.col("line"))).alias("interesting"), F.max("line_no").alias("last_line"))


@query("embedding_segments")
def embedding_segments(spark, sf):
    return chunking.segments_for_embedding(docs(spark, sf).select("doc_id", "content"))


@query(
    "batch_packing",
    f"""WITH RECURSIVE {DOCS}, r AS (SELECT source, doc_id, least(2048, greatest(1, length(content) // 4)) AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM docs),
    f AS (SELECT source, doc_id, n, t, 1 AS items, 0 AS batch FROM r WHERE n = 1 UNION ALL SELECT r.source, r.doc_id, r.n, CASE WHEN f.items >= 16 OR f.t + r.t > 2048 THEN r.t ELSE f.t + r.t END, CASE WHEN f.items >= 16 OR f.t + r.t > 2048 THEN 1 ELSE f.items + 1 END, f.batch + (f.items >= 16 OR f.t + r.t > 2048)::INT FROM f JOIN r ON r.source = f.source AND r.n = f.n + 1)
    SELECT source, doc_id, batch::INT AS batch FROM f""",
)
def batch_packing(spark, sf):
    rows = docs(spark, sf).select("source", "doc_id", F.least(F.lit(2048), T.tokens_v1(F.col("content"))).alias("token_estimate"))
    return chunking.pack_batches(rows, "source", ["doc_id"]).select("source", "doc_id", "batch")
