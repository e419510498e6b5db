"""Results and requests made from conversations and documents, and what their contracts say of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import contracts
from lodestone.plans.entities import table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# A turn as an attempt: what it does follows from its place and the length of its text.
OPERATION = "CASE WHEN n % 7 = 0 THEN 'plan' WHEN i = 1 THEN 'semantic_retrieval' WHEN i = 2 THEN 'rerank' ELSE 'synthesis' END"
TIER = "CASE WHEN n % 19 = 0 THEN 'cpu' WHEN i <= 2 AND n % 5 > 0 THEN 'p40-retrieval' WHEN n % 3 = 0 OR i = 3 THEN 'p40-synthesis' WHEN n % 3 = 1 THEN 'v100-reasoning' ELSE 'a100-single' END"
STATUS = "CASE WHEN n % 6 = 0 THEN 'failed' WHEN n % 23 = 0 THEN 'late' ELSE 'succeeded' END"
GPUS = "CASE WHEN n % 8 = 0 THEN 2 WHEN n % 29 = 0 THEN 0 WHEN n % 19 > 0 AND NOT (i <= 2 AND n % 5 > 0) AND NOT (n % 3 = 0 OR i = 3) AND n % 3 = 1 THEN 4 ELSE 1 END"

RESULTS = f"""WITH n0 AS (SELECT conv_id, turn, role, text, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
  a AS (SELECT *, {OPERATION} AS op, {TIER} AS tier, {STATUS} AS status, {GPUS} AS gpus, CASE WHEN n % 9 > 0 THEN 'm' || role ELSE '' END AS model, CASE WHEN n % 10 > 0 THEN conv_id || '-' || turn ELSE '' END AS job FROM n0),
  h AS (SELECT conv_id, arg_min(n, i) AS first, arg_max(n, i) AS last, arg_max(role, i) = 'assistant' AS ends, count(*) AS turns FROM a GROUP BY 1),
  c AS (SELECT *, ends AND last % 10 > 0 AS answered, CASE first % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'evidence' ELSE 'answer' END AS mode FROM h),
  s AS (SELECT a.*, count(*) FILTER (op = 'synthesis' AND tier = 'p40-synthesis') OVER w AS p40, count(*) FILTER (op = 'synthesis' AND tier = 'v100-reasoning') OVER w AS v100, row_number() OVER (PARTITION BY conv_id, op, status ORDER BY i) AS turn_of FROM a WINDOW w AS (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  late AS (SELECT *, CASE WHEN op = 'synthesis' AND tier = 'v100-reasoning' AND p40 = 0 THEN 'v100_before_p40' WHEN op = 'synthesis' AND tier LIKE 'a100%' AND (p40 = 0 OR v100 = 0) THEN 'a100_before_v100' END AS late FROM s),
  rule AS (SELECT *, CASE WHEN op = 'plan' THEN 'operation' WHEN tier = 'cpu' THEN 'tier' WHEN status = 'late' THEN 'status' WHEN gpus < 1 THEN 'gpu_count' WHEN gpus <> CASE WHEN tier = 'v100-reasoning' THEN 4 ELSE 1 END THEN 'tier_gpu_count' WHEN op <> 'synthesis' AND tier <> 'p40-retrieval' THEN 'retrieval_tier' WHEN op = 'synthesis' AND tier = 'p40-retrieval' THEN 'synthesis_tier' ELSE late END AS code FROM late),
  won AS (SELECT conv_id, op, i, gpus, tier, model, job FROM rule WHERE status = 'succeeded' AND turn_of = 1 AND op <> 'plan'),
  place AS (SELECT conv_id, max(i) FILTER (op = 'semantic_retrieval') AS r, max(i) FILTER (op = 'rerank') AS k, max(i) FILTER (op = 'synthesis') AS y FROM won GROUP BY 1),
  cite AS (SELECT conv_id, i, unnest(CASE WHEN n % 5 > 0 THEN ['ev_' || before % 40] ELSE [] END || CASE WHEN n % 3 = 0 THEN ['ev_' || n % 41] ELSE [] END) AS ref FROM a WHERE role = 'assistant'),
  finds AS (SELECT conv_id, count(*) AS findings, count(*) FILTER (n % 5 = 0 AND n % 3 > 0) AS bare FROM a WHERE role = 'assistant' GROUP BY 1),
  hits AS (SELECT conv_id, count(*) FILTER (known) AS valid, count(*) FILTER (NOT known) AS wrong FROM (SELECT cite.conv_id, EXISTS (SELECT 1 FROM a WHERE a.conv_id = cite.conv_id AND 'ev_' || a.n % 40 = cite.ref) AS known FROM cite) GROUP BY 1),
  wide AS (SELECT c.*, coalesce(findings, 0) * (answered OR first % 6 = 0)::INT AS found, coalesce(bare, 0) AS bare, coalesce(valid, 0) AS valid, coalesce(wrong, 0) AS wrong, place.r, place.k, place.y FROM c LEFT JOIN finds USING (conv_id) LEFT JOIN hits USING (conv_id) LEFT JOIN place USING (conv_id)),
  e AS (SELECT conv_id, unnest([
      CASE WHEN first % 13 = 0 THEN 'schema_version' END, CASE WHEN first % 7 = 0 THEN 'quality_reranking' END, CASE WHEN first % 17 = 0 THEN 'warnings' END,
      CASE WHEN ends AND NOT answered THEN 'answer_text' END,
      CASE WHEN answered AND mode = 'evidence' THEN 'mode_forbids_answer' END, CASE WHEN answered AND first % 11 = 0 THEN 'answer_retrieval' END, CASE WHEN answered AND first % 7 = 0 THEN 'answer_reranking' END,
      CASE WHEN answered AND last % 4 = 0 THEN 'answer_not_ready' END, CASE WHEN answered AND found = 0 THEN 'no_findings' END,
      CASE WHEN answered AND (r IS NULL OR k IS NULL OR y IS NULL) THEN 'missing_success' END, CASE WHEN answered AND NOT (r < k AND k < y) THEN 'success_order' END,
      CASE WHEN NOT answered AND ends THEN 'answer_not_omitted' END, CASE WHEN NOT answered AND found > 0 THEN 'findings_without_answer' END,
      CASE WHEN NOT answered AND last % 3 = 0 AND mode <> 'answer' THEN 'failed_needs_answer_mode' END, CASE WHEN NOT answered AND last % 3 = 0 AND last % 8 = 0 THEN 'failed_but_ready' END,
      CASE WHEN NOT answered AND last % 3 > 0 AND last % 8 = 0 THEN 'evidence_only_expected' END, CASE WHEN NOT answered AND last % 3 > 0 AND mode = 'answer' THEN 'answer_mode_unanswered' END]) AS code FROM wide
    UNION ALL SELECT conv_id, 'evidence_repeats' FROM a GROUP BY conv_id, n % 40 HAVING count(*) > 1
    UNION ALL SELECT conv_id, 'evidence_sources' FROM a WHERE role <> 'user' AND n % 12 = 0
    UNION ALL SELECT conv_id, op || '_gpu_count' FROM won JOIN c USING (conv_id) WHERE answered AND gpus <> CASE WHEN tier = 'v100-reasoning' THEN 4 ELSE 1 END
    UNION ALL SELECT conv_id, op || '_model' FROM won JOIN c USING (conv_id) WHERE answered AND model = ''
    UNION ALL SELECT conv_id, op || '_job' FROM won JOIN c USING (conv_id) WHERE answered AND job = ''
    UNION ALL SELECT conv_id, late FROM late JOIN c USING (conv_id) WHERE answered),
  said AS (SELECT conv_id, string_agg(DISTINCT code, ',' ORDER BY code) AS errors FROM e WHERE code IS NOT NULL GROUP BY 1),
  tried AS (SELECT conv_id, string_agg(code || '[' || (i - 1) || ']', ',' ORDER BY i) FILTER (code IS NOT NULL) AS attempt_errors FROM rule GROUP BY 1)
  SELECT wide.conv_id, coalesce(errors, '') AS errors, coalesce(attempt_errors, '') AS attempt_errors, CASE WHEN answered THEN valid ELSE 0 END AS valid_citations, CASE WHEN answered THEN wrong ELSE 0 END AS invalid_citations,
    CASE WHEN answered THEN bare + (found = 0)::INT ELSE 0 END AS missing_references FROM wide LEFT JOIN said USING (conv_id) LEFT JOIN tried USING (conv_id)"""


def results(spark, sf):
    """A result's JSON for each conversation: its turns are evidence and attempts, its answers findings."""
    e = F.expr
    t = table(spark, sf, "conversations").selectExpr("conv_id", "turn", "role", "text", "length(text) AS n", "row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i", "lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS before")
    t = t.withColumn("attempt", e(f"named_struct('operation', {OPERATION}, 'tier', {TIER}, 'status', {STATUS}, 'gpu_count', {GPUS}, 'model_profile', CASE WHEN n % 9 > 0 THEN concat('m', role) ELSE '' END, 'slurm_job_id', CASE WHEN n % 10 > 0 THEN concat(conv_id, '-', turn) ELSE '' END)"))
    t = t.withColumn("item", e("named_struct('id', concat('ev_', n % 40), 'source_refs', CASE WHEN role = 'user' OR n % 12 > 0 THEN array(role) ELSE cast(array() AS array<string>) END)"))
    t = t.withColumn("finding", e("CASE WHEN role = 'assistant' THEN named_struct('evidence_refs', concat(CASE WHEN n % 5 > 0 THEN array(concat('ev_', before % 40)) ELSE cast(array() AS array<string>) END, CASE WHEN n % 3 = 0 THEN array(concat('ev_', n % 41)) ELSE cast(array() AS array<string>) END)) END"))
    turns = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("i", "n", "role", "text", "attempt", "item", "finding"))).alias("t"))
    turns = turns.selectExpr("conv_id", "t", "t[0].n AS first", "t[size(t) - 1].n AS last", "t[size(t) - 1].role = 'assistant' AS ends", "trim(t[0].text) AS query", "CASE t[0].n % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'evidence' ELSE 'answer' END AS mode")
    turns = turns.withColumn("answered", e("ends AND last % 10 > 0"))
    quality = """CASE WHEN answered THEN named_struct('result', 'answer_ready', 'retrieval', CASE WHEN first % 11 = 0 THEN 'lexical_degraded' ELSE 'gpu' END, 'reranking', CASE WHEN first % 7 = 0 THEN 'cpu' ELSE 'gpu' END, 'synthesis', 'gpu', 'answer_ready', last % 4 > 0)
      ELSE named_struct('result', CASE WHEN last % 3 = 0 THEN 'failed' ELSE 'evidence_only' END, 'retrieval', 'gpu', 'reranking', CASE WHEN first % 7 = 0 THEN 'cpu' ELSE 'unavailable' END, 'synthesis', 'not_requested', 'answer_ready', last % 8 = 0) END"""
    body = f"""to_json(named_struct('mode', mode, 'query', query, 'quality', {quality}, 'answer', CASE WHEN answered THEN t[size(t) - 1].text WHEN ends THEN '' END,
      'findings', CASE WHEN answered OR first % 6 = 0 THEN array_compact(t.finding) ELSE slice(array_compact(t.finding), 1, 0) END, 'evidence', t.item, 'retrieval', map('turns', size(t)), 'runtime', named_struct('attempts', t.attempt), 'provenance', map('conv_id', conv_id)))"""
    rows = turns.select("conv_id", "mode", "query", "first", e(body).alias("body"))
    # what to_json can't give: a list in most rows, a text in some
    whole = F.concat(F.lit('{"schema_name":"repo_inspection_v2","schema_version":"'), e("CASE WHEN first % 13 = 0 THEN '2.0' ELSE '2.0.0' END"), F.lit('","payload":'), e("substr(body, 1, length(body) - 1)"), F.lit(',"warnings":'), e("CASE WHEN first % 17 = 0 THEN '\"none\"' ELSE '[]' END"), F.lit("}}"))
    return rows.select("conv_id", "mode", "query", whole.alias("result"))


@query("result_contract", RESULTS)
def result_contract(spark, sf):
    checked = contracts.checked_results(results(spark, sf))
    return checked.select("conv_id", F.array_join("errors", ",").alias("errors"), F.array_join("attempt_errors", ",").alias("attempt_errors"), "valid_citations", "invalid_citations", "missing_references")


@query(
    "request_contract",
    """WITH r AS (SELECT doc_id, text, lang, source, length(text) AS n, CASE WHEN lang IS NULL THEN 'auto' WHEN lang = 'en' THEN 'answer' WHEN lang = 'fr' THEN 'evidence' ELSE lang END AS mode FROM documents),
    k AS (SELECT *, CASE WHEN mode = 'answer' THEN 4096 ELSE 2048 END AS least, coalesce(nullif(n % 5000 - 40, 0), 0) AS pack, n * 20 - 2000 AS runtime FROM r)
    SELECT doc_id, rtrim(CASE WHEN NOT runtime BETWEEN 0 AND 86400 THEN 'runtime,' ELSE '' END || CASE WHEN n % 3 = 0 THEN 'output_schema,' ELSE '' END || CASE WHEN text IS NULL OR trim(text) = '' THEN 'query_required,' ELSE '' END || CASE WHEN strlen(text) > 2048 THEN 'query_bytes,' ELSE '' END
      || CASE WHEN mode NOT IN ('auto', 'evidence', 'answer') THEN 'mode,' ELSE '' END || CASE WHEN n % 4 = 0 THEN 'reserved_key,' ELSE '' END || CASE WHEN n % 100 < 20 THEN 'evidence_token_budget,' ELSE '' END || CASE WHEN pack < 0 THEN 'final_pack_token_budget,' ELSE '' END || CASE WHEN pack > 0 AND pack < least THEN 'final_pack_least,' ELSE '' END, ',') AS errors,
      rtrim(CASE WHEN n % 5000 - 40 < least THEN 'final_pack_least,' ELSE '' END || CASE WHEN NOT runtime BETWEEN 0 AND 86400 THEN 'runtime,' ELSE '' END, ',') AS worker_errors FROM k WHERE text IS NOT NULL
    UNION ALL SELECT doc_id, 'query_required', '' FROM documents WHERE text IS NULL AND (lang IS NULL OR lang IN ('en', 'fr')) UNION ALL SELECT doc_id, 'query_required,mode', '' FROM documents WHERE text IS NULL AND lang NOT IN ('en', 'fr')""",
)
def request_contract(spark, sf):
    """Every document asks with its whole text; its budgets and runtime are its length."""
    d = table(spark, sf, "documents").withColumn("n", F.length("text"))
    params = "to_json(named_struct('query', text, 'mode', CASE WHEN lang IS NULL THEN ' ' WHEN lang = 'en' THEN 'Answer ' WHEN lang = 'fr' THEN 'EVIDENCE' ELSE lang END, 'GPU_Service_url', CASE WHEN n % 4 = 0 THEN source END))"
    limits = "to_json(named_struct('max_runtime_seconds', n * 20 - 2000, 'evidence_token_budget', n % 100 - 20, 'final_pack_token_budget', n % 5000 - 40))"
    request = F.concat(F.lit('{"task_type":"inspect_repo","output_schema":{"name":"'), F.expr("CASE WHEN n % 3 = 0 THEN 'repo_inspection_v1' ELSE 'repo_inspection_v2' END"), F.lit('"},"task_params":'), F.expr(params), F.lit(',"constraints":'), F.expr(limits), F.lit("}"))
    checked = contracts.checked_requests(d.select("doc_id", request.alias("request")))
    return checked.select("doc_id", F.array_join("errors", ",").alias("errors"), F.array_join("worker_errors", ",").alias("worker_errors"))
