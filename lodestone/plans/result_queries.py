"""Results, stores, placement details, inspection end to end and its evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import chunking, evaluation, inspection, jobs, results, retrieval, summaries, vectors
from lodestone.operators.incremental import key
from lodestone.plans import entities as E
from lodestone.plans import retrieval_queries as R
from lodestone.plans.entities import DOCS, JOBS, LINES, docs, table
from lodestone.sources import records

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def e(text: str):
    return F.expr(text)


NODE = [
    "s_suppkey",
    "CASE s_suppkey % 4 WHEN 0 THEN 'P40,avx2' WHEN 1 THEN 'v100,nvlink' WHEN 2 THEN 'a100' ELSE '' END AS features",
    "CASE s_suppkey % 3 WHEN 0 THEN 'p40 & avx2' WHEN 1 THEN '(a100|h100)' ELSE ' ' END AS asked",
    "CASE s_suppkey % 5 WHEN 0 THEN 'gpu:p40:4' WHEN 1 THEN 'gpu:v100(S:0)' WHEN 2 THEN 'shard:1,gpu:a100' WHEN 3 THEN 'gpu:p400:1' ELSE '' END AS gres",
    "CASE s_suppkey % 3 WHEN 0 THEN 'P40' WHEN 1 THEN 'v100' ELSE 'a100' END AS accelerator",
]


@query(
    "node_constraints",
    f"""WITH n AS (SELECT {', '.join(NODE)} FROM supplier) SELECT s_suppkey, trim(asked) = '' OR len(list_filter(string_split_regex(lower(asked), '[&|,()]'), lambda w: trim(w) <> '' AND contains(lower(features), trim(w)))) > 0 AS constraint_ok,
    regexp_matches(lower(gres), 'gpu:' || lower(accelerator) || '([:(,]|$)') AS gres_ok FROM n""",
)
def node_constraints(spark, sf):
    n = table(spark, sf, "supplier").selectExpr(*NODE)
    return n.select("s_suppkey", jobs.constraint_matches(F.col("asked"), F.col("features")).alias("constraint_ok"), jobs.gres_matches(F.col("gres"), F.col("accelerator")).alias("gres_ok"))


@query(
    "best_tier",
    """WITH c AS (SELECT s_nationkey, s_suppkey AS place, 'tier' || (s_suppkey % 7) AS tier, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey % 5 END AS score FROM supplier)
    SELECT s_nationkey, coalesce(arg_max(tier, score * 1000000 - place) FILTER (score IS NOT NULL), arg_min(tier, place)) AS tier FROM c GROUP BY 1""",
)
def best_tier(spark, sf):
    c = table(spark, sf, "supplier").select("s_nationkey", F.col("s_suppkey").alias("place"), e("concat('tier', s_suppkey % 7)").alias("tier"), e("CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey % 5 END").alias("score"))
    return jobs.best_tier(c, "s_nationkey")


@query("live_services", "SELECT s_suppkey, s_suppkey % 4 AS k FROM supplier WHERE s_suppkey % 4 = 1 AND s_suppkey % 3 <> 2")
def live_services(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", e("s_suppkey % 4").alias("k"), e("concat('tier', s_suppkey % 4)").alias("tier"), e("element_at(array('starting', 'ready', 'draining'), cast(s_suppkey % 3 AS int) + 1)").alias("state"))
    return jobs.live_records(s, F.lit("tier1")).select("s_suppkey", "k")


@query(
    "artifact_owner",
    f"""WITH {JOBS}, h AS (SELECT job_id, owner, created_at, 'art' || (job_id % 50 + k) AS artifact_id, 'p/' || job_id || '/' || k AS path FROM jobs, (SELECT unnest([0, 1]) AS k) WHERE job_id % 3 <> 0),
    q AS (SELECT c_custkey AS request_id, 'art' || (c_custkey % 60) AS artifact_id, 'user' || (c_custkey % 10) AS usr, CASE WHEN c_custkey % 9 = 0 THEN 'admin' ELSE 'user' END AS role FROM customer),
    m AS (SELECT request_id, h.job_id, path, row_number() OVER (PARTITION BY request_id ORDER BY created_at DESC, job_id DESC, path DESC) AS n FROM q JOIN h USING (artifact_id) WHERE role = 'admin' OR owner = usr)
    SELECT q.request_id, q.artifact_id, m.job_id, m.path FROM q LEFT JOIN m ON m.request_id = q.request_id AND n = 1""",
)
def artifact_owner(spark, sf):
    """Customers ask for artifacts; each order holds two."""
    held = E.jobs(spark, sf).where("job_id % 3 <> 0").withColumn("artifacts", F.transform(F.array(F.lit(0), F.lit(1)), lambda k: F.struct(F.concat(F.lit("art"), F.col("job_id") % 50 + k).alias("artifact_id"), F.concat_ws("/", F.lit("p"), "job_id", k).alias("path"), F.lit("log").alias("artifact_type"))))
    asked = table(spark, sf, "customer").select(F.col("c_custkey").alias("request_id"), e("concat('art', c_custkey % 60)").alias("artifact_id"), e("concat('user', c_custkey % 10)").alias("user"), e("CASE WHEN c_custkey % 9 = 0 THEN 'admin' ELSE 'user' END").alias("role"))
    return jobs.artifact_owner(asked, held.withColumn("artifacts", jobs.allowed_artifacts(F.col("artifacts"), ["log"])))


@query("action_usage", "SELECT o_custkey AS root_job_id, count(*) FILTER (o_orderkey % 3 = 0) AS retries, count(DISTINCT o_orderkey % 7) FILTER (o_orderkey % 3 = 1) AS forced_chunks FROM orders GROUP BY 1")
def action_usage(spark, sf):
    return jobs.action_usage(table(spark, sf, "orders").select(F.col("o_custkey").alias("root_job_id"), e("element_at(array('retry', 'force', 'release'), cast(o_orderkey % 3 AS int) + 1)").alias("action"), e("o_orderkey % 7").alias("chunk")))


@query("job_list", f"WITH {JOBS} SELECT job_id, row_number() OVER (ORDER BY created_at, job_id)::INT AS place FROM jobs WHERE root_job_id = (SELECT min(root_job_id) FROM jobs)")
def job_list(spark, sf):
    j = E.jobs(spark, sf)
    return jobs.listed(jobs.of_root(j, F.lit(j.agg(F.min("root_job_id")).first()[0]))).select("job_id", "place")


@query(
    "reducer_requests",
    f"""WITH {JOBS}, c AS (SELECT root_job_id, list(job_id ORDER BY shard_index, job_id) AS ids, arg_min('p' || (job_id % 3), shard_index * 100000000 + job_id) AS p FROM jobs WHERE strategy <> 'aggregator' GROUP BY 1)
    SELECT root_job_id, 'log_analysis' AS task_type, CASE WHEN root_job_id % 4 = 0 THEN 'urgent' ELSE p END AS priority, array_to_string(ids, ',') AS child_ids FROM c""",
)
def reducer_requests(spark, sf):
    j = E.jobs(spark, sf).where("strategy <> 'aggregator'").select("root_job_id", "job_id", "shard_index", "task_type", e("concat('p', job_id % 3)").alias("priority"))
    roots = j.select("root_job_id").distinct().select("root_job_id", F.lit(None).cast("string").alias("task_type"), e("CASE WHEN root_job_id % 4 = 0 THEN 'urgent' END").alias("priority"))
    return jobs.reducer_requests(roots, j).withColumn("child_ids", F.array_join("child_ids", ","))


@query(
    "backend_modes",
    "SELECT s_nationkey, CASE min(s_suppkey % 4) WHEN 0 THEN 'real' WHEN 1 THEN 'fallback' WHEN 2 THEN 'heuristic' ELSE 'unavailable' END AS mode FROM supplier GROUP BY 1",
)
def backend_modes(spark, sf):
    return results.combined_mode(table(spark, sf, "supplier").select("s_nationkey", e("element_at(array('real', 'fallback', 'heuristic', 'unavailable'), cast(s_suppkey % 4 AS int) + 1)").alias("mode")), "s_nationkey")


@query("strategy_hit_counts", f"WITH {R.MERGE} SELECT ['ripgrep', 'bm25', 'tree_sitter'][turn + 1] AS strategy, count(*) AS hits FROM top GROUP BY 1")
def strategy_hit_counts(spark, sf):
    return retrieval.hit_counts(retrieval.grepped_chunks(docs(spark, sf), R.TERMS), R.ASK, ["ripgrep", "bm25", "tree_sitter"], R.ORDER)


@query(
    "token_budgets",
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 100 WHEN 1 THEN 200 ELSE 32000 END AS retrieval_token_budget, CASE doc_id % 4 WHEN 1 THEN 7 ELSE 12000 END AS evidence_token_budget,
    CASE doc_id % 4 WHEN 1 THEN 7 ELSE 8000 END AS final_pack_token_budget, 16000 AS synthesis_context_token_budget FROM documents""",
)
def token_budgets(spark, sf):
    given = e("CASE doc_id % 4 WHEN 0 THEN map('retrieval_token_budget', '100') WHEN 1 THEN map('retrieved_chunk_budget', '200', 'final_evidence_pack_budget', '7') WHEN 2 THEN map('retrieval_token_budget', 'many', 'retrieved_chunk_budget', '300') ELSE cast(map() AS map<string,string>) END")
    return table(spark, sf, "documents").select("doc_id", given.alias("c")).select("doc_id", *results.token_budgets(F.col("c")))


@query(
    "result_degraded",
    "SELECT doc_id, doc_id % 7 = 0 OR doc_id % 3 = 0 OR doc_id % 5 = 0 AS degraded, doc_id % 4 = 0 AS recommended, CASE WHEN doc_id % 4 = 0 THEN lang ELSE '' END AS reason, doc_id % 6 = 0 AS in_order FROM documents",
)
def result_degraded(spark, sf):
    d = table(spark, sf, "documents")
    quality = e("CASE WHEN doc_id % 7 = 0 THEN 'failed' ELSE 'evidence_only' END")
    modes = e("CASE WHEN doc_id % 3 = 0 THEN array('heuristic', 'fallback') ELSE array('fallback', 'real') END")
    warnings = e("CASE WHEN doc_id % 5 = 0 THEN array('x', 'LOCAL_RETRIEVAL_DEGRADED') ELSE array('x') END")
    payload = F.when(F.col("doc_id") % 4 == 0, F.to_json(F.struct(F.struct(F.lit(True).alias("recommended"), F.col("lang").alias("reason")).alias("retry_recommendation")))).otherwise("{}")
    attempts = e("element_at(array(array('retrieval', 'reranking', 'synthesis'), array('reranking', 'retrieval', 'synthesis'), array('retrieval', 'synthesis'), array('retrieval', 'synthesis', 'reranking'), cast(array() AS array<string>), array('synthesis')), cast(doc_id % 6 AS int) + 1)")
    r = results.retry_recommendation(payload)
    return d.select("doc_id", results.is_degraded(quality, modes, warnings).alias("degraded"), r["recommended"].alias("recommended"), r["reason"].alias("reason"), results.ordered_attempts(attempts).alias("in_order"))


@query(
    "result_shapes",
    """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'log_analysis.findings must be a list' WHEN 2 THEN 'rag_compress.summary must be a string,rag_compress.evidence must be a list' WHEN 3 THEN 'unknown schema' WHEN 4 THEN 'payload must be an object' ELSE 'payload must be an object' END AS errors FROM documents""",
)
def result_shapes(spark, sf):
    d = table(spark, sf, "documents")
    schema = e("element_at(array('document_summary', 'log_analysis', 'rag_compress', 'poem', 'propose_patch', 'repo_summary'), cast(doc_id % 6 AS int) + 1)")
    full = F.to_json(F.struct(F.col("text").alias("summary"), F.array("lang").alias("key_points"), F.struct("source").alias("findings")))
    payload = F.when(F.col("doc_id") % 6 == 2, '{"summary":["x"]}').when(F.col("doc_id") % 6 == 4, '["x"]').when(F.col("doc_id") % 6 == 5, "no json").otherwise(full)
    return d.select("doc_id", F.array_join(results.shape_errors(schema, payload), ",").alias("errors"))


@query(
    "result_ingest",
    f"""WITH {JOBS} SELECT job_id, CASE WHEN job_id % 3 = 0 AND state <> 'succeeded' THEN state WHEN job_id % 3 = 1 THEN 'succeeded' ELSE 'failed' END AS state,
    CASE WHEN job_id % 3 = 0 AND state <> 'succeeded' OR job_id % 3 = 1 THEN '' WHEN job_id % 3 = 0 THEN 'result is missing' ELSE 'log_analysis.findings must be a list' END AS errors FROM jobs""",
)
def result_ingest(spark, sf):
    j = E.jobs(spark, sf).select("job_id", "state")
    found = j.where("job_id % 3 <> 0").select("job_id", F.lit("log_analysis").alias("schema"), e("CASE WHEN job_id % 3 = 1 THEN '{\"summary\":\"s\",\"findings\":[]}' ELSE '{\"summary\":\"s\"}' END").alias("payload"))
    return results.ingested(j, found).withColumn("errors", F.array_join("errors", ","))


@query("request_echo", "SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN 'query differs from the request' WHEN turn % 3 = 2 THEN 'mode differs from the request' ELSE '' END AS errors FROM conversations")
def request_echo(spark, sf):
    c = table(spark, sf, "conversations")
    said = F.when(F.col("turn") % 3 == 1, F.concat("text", F.lit("?"))).otherwise(F.col("text"))
    errors = results.echo_errors(F.col("text"), F.lit("auto"), said, F.when(F.col("turn") % 3 == 2, "answer").otherwise("auto"))
    return c.select("conv_id", "turn", F.array_join(errors, ",").alias("errors"))


@query(
    "stage_keys",
    """SELECT doc_id, sha256('{"budget0":' || n_chars || ',"budget1":12000,"fingerprint":"' || sha256(text) || '","query":' || to_json(lang) || ',"signature":"v2"}') AS stage_key,
    sha256('{"config":"c1","content":"' || sha256(text) || '","language":"python","namespace":' || to_json(source) || ',"path":"' || doc_id || '.py"}') AS chunk_key,
    sha256('{"accelerator":"gpu","model":' || to_json(source) || ',"runtime":"vllm","tier":' || to_json(lang) || '}') AS profile_key FROM documents""",
)
def stage_keys(spark, sf):
    d = table(spark, sf, "documents")
    stage = results.stage_key(F.col("lang"), F.sha2("text", 256), F.lit("v2"), [F.col("n_chars"), F.lit(12000)])
    chunk = results.chunk_key(F.col("source"), F.concat(F.col("doc_id").cast("string"), F.lit(".py")), F.lit("python"), F.col("text"), F.lit("c1"))
    profile = key(results.stable_profile(F.concat(F.lit(" "), F.upper("lang")), F.col("source"), F.lit("VLLM"), F.lit("gpu ")))
    return d.select("doc_id", stage.alias("stage_key"), chunk.alias("chunk_key"), profile.alias("profile_key"))


@query(
    "cache_alias_rows",
    f"""WITH {JOBS}, i AS (SELECT cache_key, arg_max(job_id, (created_at, job_id)) AS j FROM jobs WHERE cache_key <> '' AND state = 'succeeded' AND has_result GROUP BY 1)
    SELECT 'alias_' || c_custkey AS job_id, cache_key, 'user' || (c_custkey % 10) AS owner, 'succeeded' AS state, j AS alias_of FROM customer JOIN i ON cache_key = 'key' || (c_custkey % 120)""",
)
def cache_alias_rows(spark, sf):
    asked = table(spark, sf, "customer").select(F.col("c_custkey").alias("request_id"), e("concat('key', c_custkey % 120)").alias("cache_key"), e("concat('user', c_custkey % 10)").alias("owner"))
    return results.alias_rows(asked, records.cache_index(E.jobs(spark, sf)).select("cache_key", "job_id"))


@query("vector_rerank", f"SELECT vec_id, row_number() OVER (ORDER BY round(s, 9) DESC, vec_id)::INT AS place FROM (SELECT e.vec_id, {R.COSINE} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label = 3) QUALIFY place <= 16")
def vector_rerank(spark, sf):
    """Documents of one label in the order of their likeness to the question."""
    some = vectors.chosen(table(spark, sf, "embeddings"), table(spark, sf, "embeddings").where("label = 3").select("vec_id"), "vec_id")
    return vectors.reranked(some, R.query_vector(spark, sf), 16).select("vec_id", "place")


@query("job_store_import", f"WITH {JOBS} SELECT root_job_id, job_id, state, strftime(created_at, '%Y-%m-%d') AS day FROM jobs")
def job_store_import(spark, sf):
    """A root's jobs as one JSON object, read back as rows."""
    j = E.jobs(spark, sf)
    one = F.struct(F.col("job_id").cast("string").alias("key"), F.to_json(F.struct("state", F.date_format("created_at", "yyyy-MM-dd").alias("day"))).alias("value"))
    stores = j.groupBy("root_job_id").agg(F.concat(F.lit("{"), F.array_join(F.transform(F.collect_list(one), lambda x: F.concat(F.lit('"'), x["key"], F.lit('":'), x["value"])), ","), F.lit("}")).alias("text"))
    rows = records.job_store(stores)
    return rows.select("root_job_id", F.col("job_id").cast("long").alias("job_id"), F.get_json_object("job", "$.state").alias("state"), F.get_json_object("job", "$.day").alias("day"))


@query(
    "audit_lines",
    """WITH l AS (SELECT conv_id, turn, conv_id % 4 = 0 AND turn = 2 AS bad, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations), f AS (SELECT conv_id, min(n) FILTER (bad) AS stop FROM l GROUP BY 1)
    SELECT conv_id, turn, bad FROM l JOIN f USING (conv_id) WHERE stop IS NULL OR n <= stop""",
)
def audit_lines(spark, sf):
    """Every fourth conversation has a broken line, after which nothing counts."""
    c = table(spark, sf, "conversations")
    line = F.when((F.col("conv_id") % 4 == 0) & (F.col("turn") == 2), F.concat(F.lit('{"text'), "text")).otherwise(F.to_json(F.struct("role", "text")))
    return records.audit_lines(c.select("conv_id", "turn", line.alias("line")), "conv_id", "turn").select("conv_id", "turn", "bad")


@query("result_records", "SELECT doc_id, 'r' || doc_id AS id, lang AS said FROM documents WHERE lang IS NOT NULL UNION ALL SELECT doc_id, 's' || doc_id, source FROM documents WHERE lang IS NOT NULL")
def result_records(spark, sf):
    """Two records a file, in each of four shapes."""
    one = lambda prefix, c: F.to_json(F.struct(F.concat(F.lit(prefix), "doc_id").alias("id"), F.struct(F.col(c).alias("said")).alias("result")))
    bare = lambda prefix, c: F.concat(F.lit('"'), F.lit(prefix), "doc_id", F.lit('":'), F.to_json(F.struct(F.struct(F.col(c).alias("said")).alias("result"))))
    a, b = one("r", "lang"), one("s", "source")
    listed = F.concat(F.lit("["), a, F.lit(","), b, F.lit("]"))
    text = F.when(F.col("doc_id") % 4 == 0, listed).when(F.col("doc_id") % 4 == 1, F.concat(F.lit('{"results":'), listed, F.lit("}"))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("{"), bare("r", "lang"), F.lit(","), bare("s", "source"), F.lit("}"))).otherwise(F.concat(a, F.lit("\n\n"), b, F.lit("\n")))
    rows = records.result_records(table(spark, sf, "documents").where("lang IS NOT NULL").select("doc_id", text.alias("text")), "doc_id")
    return rows.select("doc_id", "id", F.get_json_object(records.unwrapped(F.col("record")), "$.said").alias("said"))


@query("run_states", "SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 3 = 0 THEN 'completed' WHEN o_orderkey % 3 = 1 AND o_orderkey % 2 = 0 THEN 'running' ELSE 'unknown' END AS state FROM orders")
def run_states(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"))
    return records.run_states(o, o.where("run_id % 3 = 0").withColumn("state", F.lit("COMPLETED")), o.where("run_id % 2 = 0 AND run_id % 3 <> 2").withColumn("state", F.lit("RUNNING")))


@query("array_manifest", f"WITH {JOBS} SELECT root_job_id, job_id, (row_number() OVER (PARTITION BY root_job_id ORDER BY job_id) - 1)::INT AS task FROM jobs")
def array_manifest(spark, sf):
    return records.array_manifest(E.jobs(spark, sf).select("root_job_id", "job_id"), "root_job_id", "job_id").select("root_job_id", "job_id", "task")


@query("patch_plan", f"WITH {R.SELECT} SELECT (SELECT arg_min(path, n) FROM sel WHERE n <= 12 AND (path LIKE '%.py' OR path LIKE '%.go' OR path LIKE '%.sh')) AS target_path, 'ev_001,ev_002,ev_003' AS evidence_refs")
def patch_plan(spark, sf):
    return results.patch_plan(R.pack(spark, sf)).select("target_path", F.array_join("evidence_refs", ",").alias("evidence_refs"))


@query("validation_report", f"WITH {R.SELECT} SELECT count(*) AS evidence_count, TRUE AS all_evidence_refs_present, 8 AS stages, 'a' AS warnings FROM sel")
def validation_report(spark, sf):
    r = results.validation_report(R.pack(spark, sf), 8000, ["a"])
    return r.select("evidence_count", "all_evidence_refs_present", F.size("pipeline_stages").alias("stages"), F.array_join("warnings", ",").alias("warnings"))


@query("inspect_corpus")
def inspect_corpus(spark, sf):
    """The whole inspection over the corpus with words alone: chunk, score, fuse, budget, diversify, trim."""
    return inspection.inspect(R.lex_chunks(spark, sf, lines=True), R.LEX_QUERY, inspection.Budgets(16000, 6000, 4000))


@query(
    "repo_shard_reduce",
    """WITH d AS (SELECT source, doc_id, left(text, 300) AS t, lang, doc_id % 5 AS k FROM documents), u AS (SELECT source, lang, min(doc_id) AS f FROM d GROUP BY 1, 2), r AS (SELECT source, 'risk' || k AS risk, min(doc_id) AS f FROM d GROUP BY 1, 2)
    SELECT source, count(*) AS shards, left(arg_min(t, doc_id) FILTER (trim(t) <> ''), 240) AS summary, (SELECT string_agg(lang, ',' ORDER BY f) FROM u WHERE u.source = d.source) AS subsystems,
    (SELECT string_agg(risk, ',' ORDER BY f) FROM (SELECT * FROM r WHERE r.source = d.source ORDER BY f LIMIT 3)) AS risks FROM d GROUP BY source""",
)
def repo_shard_reduce(spark, sf):
    """Documents as the shards of their source."""
    d = table(spark, sf, "documents")
    none = F.array().cast("array<string>")
    rows = d.select("source", "doc_id", F.substring("text", 1, 300).alias("summary"), F.array("lang").alias("subsystems"), none.alias("entrypoints"), none.alias("dependencies"), F.array(F.concat(F.lit("risk"), F.col("doc_id") % 5)).alias("risks"))
    out = summaries.reduce_repos(rows, "source", "doc_id", {"risks": 3})
    return out.select("source", "shards", "summary", F.array_join("subsystems", ",").alias("subsystems"), F.array_join("risks", ",").alias("risks"))


@query(
    "log_timeline",
    f"""WITH {DOCS}, {LINES}, l AS (SELECT source, doc_id, left(ls[1], 32) AS a, left(coalesce(list_filter(ls, lambda x: regexp_matches(lower(x), 'error|failed|exception|fatal|undefined'))[-1], ls[-1]), 32) AS b FROM lines WHERE input_type = 'log'),
    t AS (SELECT source, doc_id * 2 AS o, a AS x FROM l UNION ALL SELECT source, doc_id * 2 + 1, b FROM l)
    SELECT source, count(*) // 2 AS shards, array_to_string(list(coalesce(x, '') ORDER BY o)[1:12], chr(10)) AS timeline FROM t GROUP BY source""",
)
def log_timeline(spark, sf):
    """Start and failure of each log of a source, in order, twelve of them."""
    d = docs(spark, sf).where("input_type = 'log'")
    logs = summaries.log_summary(d.select("doc_id", "content")).join(d.select("doc_id", "source"), "doc_id")
    out = summaries.reduce_logs(logs, "source", "doc_id")
    return out.select("source", "shards", F.array_join(F.transform("timeline", lambda x: F.coalesce(x, F.lit(""))), "\n").alias("timeline"))


@query("chunk_first_paths", f"WITH {E.CHUNKS}, f AS (SELECT path, min(doc_id) AS came FROM chunks GROUP BY 1) SELECT path, row_number() OVER (ORDER BY came, path)::INT AS place FROM f QUALIFY place <= 64")
def chunk_first_paths(spark, sf):
    return chunking.first_paths(E.chunks(spark, sf), ["doc_id", "line_start"])


@query(
    "reducer_actions",
    """WITH o AS (SELECT l_orderkey AS parent, count(DISTINCT l_linenumber) FILTER (l_linenumber = 3 OR l_linenumber % 5 = 4) AS pending, max(l_orderkey % 90) AS waited_s FROM lineitem GROUP BY 1)
    SELECT parent, pending, waited_s, CASE WHEN pending = 0 THEN 'reduce' WHEN waited_s >= 60 THEN 'partial' ELSE 'wait' END AS action FROM o""",
)
def reducer_actions(spark, sf):
    """Third lines have no result yet, and those after a multiple of five a broken one; second lines failed."""
    c = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("parent"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("child"), "l_linenumber").dropDuplicates(["child"])
    payload = F.when(F.col("l_linenumber") % 5 != 4, F.lit("{}"))
    found = c.where("l_linenumber NOT IN (2, 3)").select("child", payload.alias("payload"))
    states = c.where("l_linenumber = 2").select("child", F.lit("FAILED").alias("state"))
    return summaries.reducer_action(summaries.child_outcomes(c.select("parent", "child"), found, states), F.col("parent") % 90)


def _questions(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


WORDS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
RANKED = f"""{DOCS}, sz AS (SELECT path, {WORDS.format('content')} AS ws FROM docs), av AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM sz), q AS (SELECT item_id AS query_id, unnest(list_distinct({WORDS.format('text')})) AS word FROM benchmark),
 p AS (SELECT path, any_value(length) AS length, word, count(*) AS tf FROM (SELECT path, len(ws) AS length, unnest(ws) AS word FROM sz) WHERE word IN (SELECT word FROM q) GROUP BY path, word), df AS (SELECT word, count(*) AS df FROM p GROUP BY 1),
 sc AS (SELECT query_id, path, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM q JOIN p USING (word) JOIN df USING (word), av GROUP BY 1, 2),
 ranked AS (SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM sc QUALIFY rank <= 10)"""


@query("questions_ranked", f"WITH {RANKED} SELECT query_id, path, rank::INT AS rank FROM ranked")
def questions_ranked(spark, sf):
    """The ten best documents for each benchmark passage, all passages in one plan."""
    return inspection.bm25_of_queries(docs(spark, sf), _questions(spark, sf)).select("query_id", "path", "rank")


@query(
    "questions_recall",
    f"""WITH {RANKED}, want AS (SELECT item_id AS query_id, path FROM benchmark JOIN docs ON contains(content, text)), h AS (SELECT w.query_id, w.path, r.rank FROM want w LEFT JOIN ranked r ON r.query_id = w.query_id AND r.path = w.path)
    SELECT query_id, round(count(*) FILTER (rank IS NOT NULL) / count(*), 6) AS recall_at_10, round(coalesce(1.0 / min(rank), 0), 6) AS reciprocal_rank FROM h GROUP BY 1""",
)
def questions_recall(spark, sf):
    """Recall at 10 and reciprocal rank of retrieval that is run: a passage's relevant documents are those that contain it."""
    d, asked = docs(spark, sf), _questions(spark, sf)
    want = evaluation.containing(d, asked).withColumnRenamed("path", "expected")
    return evaluation.per_query(evaluation.hits(inspection.bm25_of_queries(d, asked), want))
