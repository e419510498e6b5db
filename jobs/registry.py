"""The jobs as queries over the given tables, and SQL that gives the same rows.

Each query runs its job twice into a folder of its own under the shared folder, leaves the files there, and returns the
output as it stands after the second run.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from jobs import index_documents, log_digest
from lodestone.operators.summaries import LOG_PATTERNS
from lodestone.sources.scratch import shared_dir

QUERIES, SQL = {}, {}


def new_folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/jobs/{name}-{uuid.uuid4().hex}"


def job1_index_documents(spark, sf_dir: str):
    folder = new_folder(spark, "index_documents")
    paths = f"{sf_dir}/documents.parquet", f"{folder}/target", f"{folder}/checkpoint"
    index_documents.run(spark, *paths)
    out = index_documents.run(spark, *paths)
    return out.select("doc_id", "path", "lang", "chunk_id", "chunk_hash", "line_start", "line_end", "token_estimate", "n_words", F.sha2("content", 256).alias("content_sha256"))


WORDS = r"len(list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''))"
JOB1_SQL = f"""WITH d AS (
  SELECT doc_id, lang, coalesce(source, 'unknown') || '/' || doc_id AS path, coalesce(text, '') AS content FROM documents WHERE doc_id IS NOT NULL
), l AS (
  SELECT *, CASE WHEN content = '' THEN [] ELSE string_split(CASE WHEN ends_with(content, chr(10)) THEN left(content, length(content) - 1) ELSE content END, chr(10)) END AS ls FROM d
), w AS (
  SELECT *, unnest(range(0, ((len(ls) - 1) // 40 + 1)::BIGINT)) AS wi FROM l WHERE len(ls) > 0
), c AS (
  SELECT doc_id, path, lang, (wi * 40 + 1)::INT AS line_start, least((wi + 1) * 40, len(ls))::INT AS line_end, array_to_string(ls[(wi * 40 + 1)::BIGINT : least((wi + 1) * 40, len(ls))::BIGINT], chr(10)) AS content FROM w
)
SELECT doc_id, path, lang, 'chunk_' || left(sha256(content), 12) || '_' || line_start AS chunk_id, 'sha256:' || sha256(content) AS chunk_hash, line_start, line_end,
       greatest(1, length(content) // 4)::INT AS token_estimate, ({WORDS.format('path')} + {WORDS.format('content')})::INT AS n_words, sha256(content) AS content_sha256
FROM c"""



def job2_log_digest(spark, sf_dir: str):
    args = f"{sf_dir}/documents.parquet", f"{new_folder(spark, 'log_digest')}/target", "2026-01-31"
    log_digest.run(spark, *args)
    out = log_digest.run(spark, *args)
    return out.select("source", "logs", "lines", "known_failures", "severity", "first_high", "first_medium", F.array_join("codes", ",").alias("codes"), F.array_join("timeline", chr(31)).alias("timeline"), "summary")


CODES = ", ".join(f"CASE WHEN contains(content, '{needle}') THEN '{code}' END" for code, needle, _, _ in LOG_PATTERNS)
SEVERITY = " ".join(f"WHEN '{code}' THEN '{severity}'" for code, _, severity, _ in LOG_PATTERNS)
HOT = "regexp_matches(lower(x), 'error|failed|exception|fatal|undefined')"
HIDDEN = "CASE " + " ".join(f"WHEN contains(failure, '{t}') THEN split_part(failure, '{t}', 1) || '{t}[REDACTED]'" for t in ("api_key=", "apikey=", "token=", "bearer ", "Bearer ")) + " ELSE failure END"
JOB2_SQL = f"""WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS content FROM documents WHERE doc_id IS NOT NULL
), l AS (
  SELECT *, CASE WHEN content = '' THEN [] ELSE string_split(CASE WHEN ends_with(content, chr(10)) THEN left(content, length(content) - 1) ELSE content END, chr(10)) END AS ls FROM d
), k AS (
  SELECT *, list_filter([{CODES}], lambda x: x IS NOT NULL) AS known, list_filter(ls, lambda x: {HOT}) AS hot FROM l
), r AS (
  SELECT doc_id, source, len(ls) AS n, ls[1] AS begins, coalesce(hot[len(hot)], ls[len(ls)]) AS failure, len(ls) > 0 AND len(known) > 0 AS is_known,
         CASE WHEN len(ls) = 0 THEN [] WHEN len(known) = 0 THEN ['GENERIC_LOG_FAILURE'] ELSE known END AS codes FROM k
), e AS (
  SELECT source, doc_id, unnest(codes) AS code, unnest(range(0, len(codes))) AS pos FROM r
), s AS (
  SELECT *, CASE code {SEVERITY} ELSE 'medium' END AS severity FROM e
), w AS (
  SELECT source, doc_id, CASE WHEN bool_or(severity = 'high') THEN 'high' ELSE 'medium' END AS severity FROM s GROUP BY 1, 2
), c AS (
  SELECT source, string_agg(code, ',' ORDER BY came) AS codes, arg_min(code, came) AS first FROM (
    SELECT source, code, min(doc_id * 16 + pos) AS came FROM s GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY source ORDER BY min(doc_id * 16 + pos)) <= 8) GROUP BY 1
), t AS (
  SELECT source, string_agg(concat_ws(chr(31), left(begins, 32), left({HIDDEN}, 240)), chr(31) ORDER BY doc_id) FILTER (n > 0) AS timeline
  FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth FROM r) WHERE nth <= 6 GROUP BY 1
), g AS (
  SELECT r.source, count(*) AS logs, sum(n)::BIGINT AS lines, count(*) FILTER (is_known) AS known_failures, min(w.severity) AS worst, min(r.doc_id) FILTER (w.severity = 'high') AS first_high, min(r.doc_id) FILTER (w.severity = 'medium') AS first_medium
  FROM r LEFT JOIN w ON r.doc_id = w.doc_id AND r.source IS NOT DISTINCT FROM w.source GROUP BY 1
)
SELECT g.source, logs, lines, known_failures, coalesce(worst, 'none') AS severity, first_high, first_medium, coalesce(codes, '') AS codes, coalesce(timeline, '') AS timeline,
       'Aggregated ' || logs || ' log shard analyses' || CASE WHEN first IS NULL THEN ' with no merged findings.' ELSE '. Primary classified issue: ' || first || '.' END AS summary
FROM g LEFT JOIN c ON g.source IS NOT DISTINCT FROM c.source LEFT JOIN t ON g.source IS NOT DISTINCT FROM t.source"""

QUERIES["job2_log_digest"], SQL["job2_log_digest"] = job2_log_digest, JOB2_SQL
QUERIES["job1_index_documents"], SQL["job1_index_documents"] = job1_index_documents, JOB1_SQL
