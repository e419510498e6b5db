"""Job analytics, placement, governance, incremental upkeep, heartbeats."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import classes as C
from lodestone.functions import tiers
from lodestone.operators import governance, incremental, jobs
from lodestone.plans import entities as E
from lodestone.plans.entities import DOCS, EFFECTIVE, JOBS, docs, table
from lodestone.sources import files
from lodestone.sources.scratch import Scratch
from lodestone.sources.versions import VersionedTable
from lodestone.streaming import heartbeats, sinks

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("job_effective_attempt", f"WITH {JOBS}, {EFFECTIVE} SELECT root_job_id, shard_key, aggregation_key, job_id, state FROM effective")
def job_effective_attempt(spark, sf):
    return jobs.effective(jobs.split_reducers(E.jobs(spark, sf))[0], jobs.SHARD).select("root_job_id", "shard_key", "aggregation_key", "job_id", "state")


@query(
    "job_root_status",
    f"""WITH {JOBS}, {EFFECTIVE}, red AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY root_job_id ORDER BY created_at DESC, job_id DESC) AS rr FROM (SELECT *, row_number() OVER (PARTITION BY root_job_id, aggregation_key ORDER BY
      CASE WHEN state IN ('running', 'dispatching') THEN 0 WHEN state = 'succeeded' THEN 1 ELSE 2 END, created_at DESC, job_id DESC) AS rn FROM jobs WHERE strategy = 'aggregator') WHERE rn = 1) WHERE rr = 1),
     al AS (SELECT root_job_id, job_id, state, run_id, error, aggregation_key, FALSE AS red FROM effective UNION ALL SELECT root_job_id, job_id, state, run_id, error, aggregation_key, TRUE FROM red),
     g AS (SELECT root_job_id, count(*) AS total_jobs, count(*) FILTER (state IN ('accepted', 'queued', 'dispatching')) AS queued_jobs, count(*) FILTER (state = 'running') AS running_jobs, count(*) FILTER (state = 'succeeded') AS succeeded_jobs,
       count(*) FILTER (state IN ('failed', 'preempted', 'timed_out')) AS failed_jobs, count(*) FILTER (state = 'cancelled') AS cancelled_jobs, coalesce(array_to_string(list_sort(list(job_id) FILTER (NOT red)), ','), '') AS child_job_ids,
       array_to_string(list_sort(list(DISTINCT aggregation_key)), ',') AS aggregation_keys, arg_min(error, red::INT * 1e15 + job_id) FILTER (error <> '') AS representative_error, max(job_id) FILTER (red) AS reducer_job_id, max(state) FILTER (red) AS reducer_state,
       coalesce(bool_or(red AND state = 'dispatching' AND run_id = ''), FALSE) AS reducer_deferred FROM al GROUP BY 1)
    SELECT *, CASE WHEN reducer_state IS NOT NULL THEN reducer_state WHEN running_jobs > 0 THEN 'running' WHEN failed_jobs > 0 THEN 'failed' WHEN queued_jobs > 0 THEN 'queued' WHEN cancelled_jobs = total_jobs THEN 'cancelled' WHEN succeeded_jobs = total_jobs THEN 'succeeded' ELSE 'queued' END AS state FROM g""",
)
def job_root_status(spark, sf):
    return jobs.root_status(E.jobs(spark, sf))


@query(
    "job_root_progress",
    f"""WITH {JOBS}, {EFFECTIVE}, red AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY root_job_id, aggregation_key ORDER BY CASE WHEN state IN ('running', 'dispatching') THEN 0 WHEN state = 'succeeded' THEN 1 ELSE 2 END, created_at DESC, job_id DESC) AS rn FROM jobs WHERE strategy = 'aggregator') WHERE rn = 1),
     m AS (SELECT root_job_id, job_id FROM effective UNION ALL SELECT root_job_id, job_id FROM red),
     p AS (SELECT job_id, max(struct_pack(a := seen, b := percent, c := phase)) AS p FROM (SELECT event_id % 15000 AS job_id, CASE WHEN event_id % 4 = 0 THEN ts + INTERVAL 1 DAY ELSE ts END AS seen, value AS percent, event_type AS phase FROM events) GROUP BY 1),
     r AS (SELECT root_job_id, count(*) AS members, count(p) AS reporting, max(CASE WHEN p IS NOT NULL THEN struct_pack(a := p.a, b := p.b, c := p.c, d := m.job_id) END) AS b FROM m LEFT JOIN p USING (job_id) GROUP BY 1)
    SELECT root_job_id, members, reporting, b.a AS progress_at, b.b AS percent, b.c AS phase, b.d AS progress_job_id FROM r""",
)
def job_root_progress(spark, sf):
    """The newest progress of each root, from events as beats; every fourth says when it was last updated."""
    b = table(spark, sf, "events").select((F.col("event_id") % 15000).alias("job_id"), F.expr("CASE WHEN event_id % 4 = 0 THEN ts + INTERVAL 1 DAY END").alias("last_updated"), "ts", F.col("event_type").alias("phase"), F.col("value").alias("percent"))
    return jobs.root_progress(E.jobs(spark, sf), b)


@query("job_children", f"WITH {JOBS}, {EFFECTIVE} SELECT root_job_id, row_number() OVER (PARTITION BY root_job_id ORDER BY job_id)::INT AS place, job_id FROM effective")
def job_children(spark, sf):
    return jobs.children_of(E.jobs(spark, sf))


@query(
    "job_release_set",
    f"""WITH {JOBS}, d AS (SELECT * FROM jobs WHERE state = 'dispatching' AND run_id = ''), s AS (SELECT * FROM d WHERE strategy <> 'aggregator'),
    p AS (SELECT root_job_id, chunk, row_number() OVER (PARTITION BY root_job_id ORDER BY chunk) AS turn FROM (SELECT DISTINCT root_job_id, chunk FROM s)),
    a AS (SELECT root_job_id, count(DISTINCT chunk) FILTER (run_id <> '' AND state IN ('running', 'dispatching')) AS active FROM jobs WHERE strategy <> 'aggregator' GROUP BY 1)
    SELECT s.root_job_id, s.job_id, s.chunk, FALSE AS is_reducer FROM s JOIN p USING (root_job_id, chunk) JOIN a USING (root_job_id) WHERE turn <= greatest(0, 6 - active)
    UNION ALL SELECT root_job_id, job_id, chunk, TRUE FROM d WHERE strategy = 'aggregator' AND root_job_id NOT IN (SELECT root_job_id FROM s)""",
)
def job_release_set(spark, sf):
    return jobs.release_set(E.jobs(spark, sf), max_active=6)


def job_store(spark, sf) -> VersionedTable:
    """Three versions of a store of jobs: a third of them queued and a fifth not there, then new states and the rest, then what was cancelled went."""
    store = VersionedTable(spark, f"{Scratch(spark, 'store').path}/jobs", "job_id long, root_job_id long, state string, owner string", "job_id")
    j = E.jobs(spark, sf).select("job_id", "root_job_id", "state", "owner")
    store.put(j.where("job_id % 5 <> 4").withColumn("state", F.expr("CASE WHEN job_id % 3 = 0 THEN 'queued' ELSE state END")), 0)
    store.put(j.where("job_id % 3 = 0 OR job_id % 5 = 4"), 1)
    store.put(j.limit(0), 2, j.where("state = 'cancelled'"))
    return store


@query("store_as_of", f"WITH {JOBS} SELECT job_id, root_job_id, CASE WHEN job_id % 3 = 0 THEN 'queued' ELSE state END AS state, owner, 0 AS version FROM jobs WHERE job_id % 5 <> 4")
def store_as_of(spark, sf):
    """The store as it stood before two later versions."""
    return job_store(spark, sf).as_of(0)


@query("store_changes", f"WITH {JOBS} SELECT job_id, CASE WHEN state = 'cancelled' THEN 'removed' WHEN job_id % 5 = 4 THEN 'added' ELSE 'changed' END AS change FROM jobs WHERE (state = 'cancelled' AND job_id % 5 <> 4) OR (state <> 'cancelled' AND (job_id % 5 = 4 OR job_id % 3 = 0))")
def store_changes(spark, sf):
    """What came, changed and went from the first version to the last."""
    return job_store(spark, sf).changes(0, 2)


@query(
    "job_retry_set",
    f"""WITH {JOBS}, {EFFECTIVE} SELECT root_job_id, job_id, state, state = 'failed' AS retry, CASE WHEN state = 'failed' THEN NULL WHEN state IN ('running', 'dispatching') THEN 'in_progress' WHEN state = 'succeeded' THEN 'already_succeeded' ELSE 'cancelled_excluded' END AS skip_reason FROM effective""",
)
def job_retry_set(spark, sf):
    return jobs.retry_set(E.jobs(spark, sf))


@query(
    "job_release_slots",
    f"""WITH {JOBS}, p AS (SELECT root_job_id, chunk, count(*) AS jobs FROM jobs WHERE state = 'dispatching' AND run_id = '' GROUP BY 1, 2), a AS (SELECT root_job_id, count(DISTINCT chunk) FILTER (run_id <> '' AND state IN ('running', 'dispatching')) AS active FROM jobs GROUP BY 1)
    SELECT root_job_id, chunk, jobs, turn::INT AS turn FROM (SELECT *, row_number() OVER (PARTITION BY root_job_id ORDER BY chunk) AS turn FROM p) JOIN a USING (root_job_id) WHERE turn <= greatest(0, 6 - active)""",
)
def job_release_slots(spark, sf):
    return jobs.release_slots(E.jobs(spark, sf), max_active=6)


@query("job_dispatch_counts", f"WITH {JOBS} SELECT root_job_id, count(*) FILTER (state = 'dispatching') AS dispatching, count(*) FILTER (state = 'dispatching' AND run_id = '') AS pending, count(DISTINCT chunk) FILTER (run_id <> '' AND state IN ('running', 'dispatching')) AS active_chunks, count(DISTINCT chunk) FILTER (state = 'dispatching' AND run_id = '') AS pending_chunks FROM jobs GROUP BY 1")
def job_dispatch_counts(spark, sf):
    return jobs.dispatch_counts(E.jobs(spark, sf))


@query("job_batches", f"WITH {JOBS} SELECT job_id, ((row_number() OVER (PARTITION BY root_job_id ORDER BY shard_index, job_id) - 1) // 4)::INT AS batch FROM jobs")
def job_batches(spark, sf):
    return jobs.chunk_of_batch(E.jobs(spark, sf), 4).select("job_id", "batch")


@query("job_quota", "SELECT o_custkey AS root_job_id, o_custkey % 9 = 0 OR (max(o_orderkey) % 5 <= 3 AND count(*) + max(o_orderkey) % 5 <= 12) AS allowed, CASE WHEN o_custkey % 9 = 0 THEN 0 ELSE greatest(0, 12 - count(*)) END::BIGINT AS remaining FROM orders GROUP BY o_custkey")
def job_quota(spark, sf):
    r = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("root_job_id")).agg(F.count(F.lit(1)).alias("existing"), (F.max("o_orderkey") % 5).alias("k"))
    r = r.withColumn("role", F.when(F.col("root_job_id") % 9 == 0, "admin").otherwise("user")).withColumn("requested", F.when(F.col("k") <= 3, F.col("k")).otherwise(99))
    return jobs.quota(r, 12).select("root_job_id", "allowed", F.col("remaining").cast("long").alias("remaining"))


@query("job_reducer_waits", f"WITH {JOBS} SELECT root_job_id, bool_or(state = 'dispatching' AND run_id = '') AS deferred, coalesce(array_to_string(list_sort(list(run_id) FILTER (run_id <> '')), ','), '') AS dependencies FROM jobs WHERE strategy <> 'aggregator' GROUP BY 1")
def job_reducer_waits(spark, sf):
    return jobs.reducer_waits(E.jobs(spark, sf))


@query("cache_latest_by_key", f"WITH {JOBS} SELECT cache_key, arg_max(job_id, (created_at, job_id)) AS job_id, count(*) AS candidates FROM jobs WHERE cache_key <> '' AND state = 'succeeded' AND has_result GROUP BY 1")
def cache_latest_by_key(spark, sf):
    return jobs.latest_cached(E.jobs(spark, sf))


@query("cache_in_flight", f"WITH {JOBS} SELECT task_type, cache_key, arg_max(job_id, (created_at, job_id)) AS job_id FROM jobs WHERE cache_key <> '' AND state IN ('running', 'dispatching') AND alias_of IS NULL GROUP BY 1, 2")
def cache_in_flight(spark, sf):
    return jobs.in_flight(E.jobs(spark, sf))


@query(
    "cache_lookup",
    f"""WITH {JOBS}, c AS (SELECT cache_key, arg_max(job_id, (created_at, job_id)) AS job_id, arg_max(owner, (created_at, job_id)) AS owner FROM jobs WHERE cache_key <> '' AND state = 'succeeded' AND has_result GROUP BY 1)
    SELECT s_suppkey AS request_id, k AS cache_key, CASE WHEN k = '' THEN 'uncacheable' WHEN c.job_id IS NULL OR c.owner <> 'user' || (s_suppkey % 10) THEN 'miss' ELSE 'hit' END AS status, CASE WHEN c.owner = 'user' || (s_suppkey % 10) THEN c.job_id END AS job_id
    FROM (SELECT *, CASE WHEN s_suppkey % 6 = 0 THEN '' ELSE 'key' || s_suppkey END AS k FROM supplier) LEFT JOIN c ON c.cache_key = k""",
)
def cache_lookup(spark, sf):
    j = E.jobs(spark, sf)
    r = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("request_id"), F.expr("CASE WHEN s_suppkey % 6 = 0 THEN '' ELSE concat('key', s_suppkey) END").alias("cache_key"), F.expr("concat('user', s_suppkey % 10)").alias("owner"), F.lit("user").alias("role"))
    return jobs.cache_lookup(r, jobs.latest_cached(j), j)


@query(
    "cache_alias_chain",
    f"""WITH RECURSIVE {JOBS}, l AS (SELECT job_id, CASE WHEN job_id % 100 <> 0 THEN job_id - 1 END AS src FROM jobs), k AS (SELECT job_id, job_id AS origin FROM l WHERE src IS NULL OR src NOT IN (SELECT job_id FROM l) UNION ALL SELECT l.job_id, k.origin FROM l JOIN k ON l.src = k.job_id)
    SELECT job_id, origin FROM k""",
)
def cache_alias_chain(spark, sf):
    """A job whose key is no multiple of 100 is an alias of the one before it."""
    return jobs.origins(E.jobs(spark, sf).select("job_id", F.expr("CASE WHEN job_id % 100 <> 0 THEN job_id - 1 END").alias("source_id")))


@query("cache_key_hash", "SELECT o_orderkey AS job_id, sha256('{\"classification\":\"' || o_orderstatus || '\",\"params\":\"' || o_orderpriority || '\",\"task\":' || (o_orderkey % 5) || '}') AS cache_key FROM orders")
def cache_key_hash(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("job_id"), incremental.key({"task": F.col("o_orderkey") % 5, "params": F.col("o_orderpriority"), "classification": F.col("o_orderstatus")}).alias("cache_key"))


@query("policy_access", f"WITH {JOBS} SELECT root_job_id, bool_and(owner = 'user3') AS accessible FROM jobs GROUP BY 1")
def policy_access(spark, sf):
    return jobs.forbidden_roots(E.jobs(spark, sf), "user3", "user")


@query(
    "policy_release",
    """SELECT doc_id AS job_id, s AS sensitive, CASE WHEN NOT s THEN '' WHEN o THEN 'broker_redacted_sensitive_fields,broker_removed_artifact_paths' ELSE 'broker_redacted_sensitive_fields,broker_withheld_artifacts' END AS warnings,
    CASE WHEN s AND NOT o THEN 0 ELSE 3 END AS artifacts_released, '{"kind":"' || lang || '","deep":[{"excerpt":"' || CASE WHEN s THEN '[REDACTED]' ELSE source END || '"}]}' AS payload FROM (SELECT *, doc_id % 10 = 0 OR doc_id % 6 IN (2, 3, 4) AS s, doc_id % 4 = 0 AS o FROM documents)""",
)
def policy_release(spark, sf):
    d = docs(spark, sf).select("doc_id", "classification").join(table(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id")
    rows = d.select(F.col("doc_id").alias("job_id"), F.expr("CASE WHEN doc_id % 10 = 0 THEN 'LOCAL_ONLY' ELSE 'none' END").alias("confidentiality"), F.array(F.upper("classification")).alias("classifications"), (F.col("doc_id") % 4 == 0).alias("override"), F.to_json(F.struct(F.col("lang").alias("kind"), F.array(F.struct(F.col("source").alias("excerpt"))).alias("deep"))).alias("payload"), F.lit(3).alias("artifacts"))
    return governance.release(rows).withColumn("warnings", F.array_join("warnings", ","))


@query(
    "classification_max",
    f"""WITH {DOCS} SELECT source, ['public', 'internal', 'restricted', 'phi', 'secret_adjacent'][max(CASE classification WHEN 'internal' THEN 2 WHEN 'restricted' THEN 3 WHEN 'phi' THEN 4 WHEN 'secret_adjacent' THEN 5 WHEN 'public' THEN 1 ELSE 0 END)] AS worker,
    max(CASE classification WHEN 'public' THEN 0 WHEN 'unknown' THEN 1 WHEN 'internal' THEN 2 WHEN 'restricted' THEN 3 WHEN 'phi' THEN 4 ELSE 5 END)::INT AS broker_rank FROM docs GROUP BY source""",
)
def classification_max(spark, sf):
    d = docs(spark, sf)
    w = governance.highest_classification(d, "source").withColumnRenamed("classification", "worker")
    b = governance.highest_classification(d, "source", worker=False).select("source", C.rank_of(F.col("classification"), C.BROKER_RANKS, 3).alias("broker_rank"))
    return w.join(b, "source")


@query(
    "payload_redaction_recursive",
    """SELECT doc_id, '{"outer":{"paths":["[REDACTED]","[REDACTED]"],"deep":{"content":"[REDACTED]","kind":"' || lang || '"}},"path":"[REDACTED]","odd":{"path":"[REDACTED]","related_paths":["[REDACTED]"],"content":["' || lang || '"]}}' AS payload FROM documents""",
)
def payload_redaction_recursive(spark, sf):
    """Paths of every type and texts at several depths are hidden; a list under a text's key is not."""
    outer = F.struct(F.array("source", "lang").alias("paths"), F.struct(F.col("text").alias("content"), F.col("lang").alias("kind")).alias("deep"))
    odd = F.struct(F.struct("source").alias("path"), F.col("source").alias("related_paths"), F.array("lang").alias("content"))
    d = table(spark, sf, "documents").select("doc_id", F.to_json(F.struct(outer.alias("outer"), F.col("source").alias("path"), odd.alias("odd"))).alias("payload"))
    return d.select("doc_id", governance.redact_json(F.col("payload")).alias("payload"))


@query(
    "result_validation",
    """SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 15 > 12 THEN 'evidence_limit' END, CASE WHEN doc_id % 7 = 0 THEN 'evidence_ids_unique' END, CASE WHEN doc_id % 5 = 0 THEN 'unknown_evidence_ref' END,
      CASE WHEN doc_id % 4 = 3 THEN 'result_state' END, CASE WHEN doc_id % 4 = 0 AND doc_id % 3 = 0 THEN 'answer_needs_gpu' END, CASE WHEN doc_id % 11 = 0 THEN 'attempt_order' END], lambda x: x IS NOT NULL), ',') AS errors FROM documents""",
)
def result_validation(spark, sf):
    e = F.expr
    d = table(spark, sf, "documents").select(
        "doc_id",
        e("concat(transform(sequence(1, cast(doc_id % 15 as int) + CASE WHEN doc_id % 15 = 0 THEN 1 ELSE 0 END), i -> CASE WHEN i = 1 THEN 'ev_1' ELSE concat('ev_', i) END), CASE WHEN doc_id % 7 = 0 AND doc_id % 15 <= 12 THEN array('ev_1') WHEN doc_id % 7 = 0 THEN array('ev_1') ELSE cast(array() as array<string>) END)").alias("evidence_ids"),
        e("CASE WHEN doc_id % 5 = 0 THEN array('ev_1', 'ev_99') ELSE array('ev_1') END").alias("refs"),
        e("element_at(array('answer_ready', 'evidence_only', 'failed', 'odd'), cast(doc_id % 4 as int) + 1)").alias("result"),
        F.lit("gpu").alias("retrieval"),
        e("CASE WHEN doc_id % 3 = 0 THEN 'cpu' ELSE 'gpu' END").alias("reranking"),
        F.lit("gpu").alias("synthesis"),
        e("CASE WHEN doc_id % 11 = 0 THEN array('v100-a', 'p40-b') ELSE array('p40-a', 'v100-b', 'a100-c') END").alias("attempts"),
    )
    # a repeated id makes thirteen of twelve: only rows far from the limit carry one
    d = d.withColumn("evidence_ids", e("CASE WHEN doc_id % 15 = 12 AND doc_id % 7 = 0 THEN concat(slice(evidence_ids, 1, 11), array('ev_1')) ELSE evidence_ids END"))
    return d.select("doc_id", F.array_join(governance.inspection_errors(), ",").alias("errors"))


def audit(spark, sf):
    c = table(spark, sf, "conversations")
    e = c.select("conv_id", "turn", F.col("turn").cast("string").alias("at"), F.col("role").alias("actor"), "role", F.col("text").alias("action"), F.lit("ok").alias("outcome"), F.concat(F.lit("j"), "conv_id").alias("job_id"), F.create_map(F.lit("turn"), F.col("turn").cast("string"), F.lit("by"), F.col("role")).alias("fields"))
    return governance.chained(e, "conv_id", "turn")


@query(
    "audit_chain",
    """WITH RECURSIVE j AS (SELECT conv_id, turn, '{"timestamp":"' || turn || '","actor":' || to_json(role) || ',"role":' || to_json(role) || ',"action":' || to_json(text) || ',"outcome":"ok","job_id":"j' || conv_id || '","fields":{"by":' || to_json(role) || ',"turn":"' || turn || '"}' AS b FROM conversations),
    e AS (SELECT conv_id, turn, replace(replace(replace(b, '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026') AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM j),
    h AS (SELECT conv_id, turn, n, '' AS prev_hash, sha256(body || '}') AS event_hash FROM e WHERE n = 1 UNION ALL SELECT e.conv_id, e.turn, e.n, h.event_hash, sha256(e.body || ',"prev_hash":"' || h.event_hash || '"}') FROM h JOIN e ON e.conv_id = h.conv_id AND e.n = h.n + 1)
    SELECT conv_id, turn, prev_hash, event_hash FROM h""",
)
def audit_chain(spark, sf):
    return audit(spark, sf).select("conv_id", "turn", "prev_hash", "event_hash")





@query("audit_chain_stream", SQL["audit_chain"])
def audit_chain_stream(spark, sf):
    """The same chains, appended by a stream that reads the table's files and ends."""
    folder = Scratch(spark, "audit").path
    c = files.stream(spark, f"{sf}/conversations.parquet", "conv_id long, turn long, role string, text string")
    e = c.select(F.col("conv_id").cast("string").alias("chain"), "turn", F.col("turn").cast("string").alias("at"), F.col("role").alias("actor"), "role", F.col("text").alias("action"), F.lit("ok").alias("outcome"), F.concat(F.lit("j"), "conv_id").alias("job_id"), F.create_map(F.lit("turn"), F.col("turn").cast("string"), F.lit("by"), F.col("role")).alias("fields"))
    sinks.audit_chain(e, f"{folder}/out", f"{folder}/checkpoint", "turn").awaitTermination()
    return spark.read.parquet(f"{folder}/out/events").select(F.col("chain").cast("long").alias("conv_id"), "turn", "prev_hash", "event_hash")


@query(
    "audit_chain_verify",
    """WITH c AS (SELECT conv_id, count(*) AS n, count(*) FILTER (turn <= 1) AS head FROM conversations GROUP BY 1)
    SELECT conv_id, n AS events, NOT (conv_id % 3 = 0 AND n > 1) AS valid, CASE WHEN conv_id % 3 = 0 AND n > 1 THEN 2 END AS failure_line, CASE WHEN conv_id % 3 = 0 AND n > 1 THEN 'event_hash mismatch' END AS reason FROM c""",
)
def audit_chain_verify(spark, sf):
    """Every third conversation has its second event changed after the fact."""
    rows = audit(spark, sf).withColumn("_n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    forged = rows.withColumn("action", F.when((F.col("conv_id") % 3 == 0) & (F.col("_n") == 2), F.lit("forged")).otherwise(F.col("action"))).drop("_n")
    return governance.verify(forged, "conv_id", "turn")


@query(
    "placement_score",
    """WITH n AS (SELECT s_nationkey AS p, s_suppkey AS node, CASE WHEN s_suppkey % 3 = 0 THEN 'idle' WHEN s_suppkey % 3 = 1 THEN 'mixed' ELSE 'down' END AS st FROM supplier), h AS (SELECT p, count(*) FILTER (st = 'idle') AS idle, count(*) FILTER (st = 'mixed') AS mix FROM n WHERE st <> 'down' GROUP BY 1),
    q AS (SELECT o_orderkey % 25 AS p, CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderstatus = 'O' THEN 'running' ELSE 'done' END AS st, o_custkey % 100 AS node FROM orders),
    l AS (SELECT q.p, count(*) FILTER (q.st = 'pending') AS pending, count(*) FILTER (q.st = 'running' AND n.node IS NOT NULL) AS running FROM q LEFT JOIN n ON n.p = q.p AND n.node = q.node AND n.st <> 'down' GROUP BY 1)
    SELECT h.p AS partition, idle, mix, coalesce(pending, 0) AS pending, coalesce(running, 0) AS running, idle * 100 + mix * 25 - coalesce(pending, 0) * 10 - coalesce(running, 0) * 5 AS score FROM h LEFT JOIN l ON l.p = h.p""",
)
def placement_score(spark, sf):
    n = table(spark, sf, "supplier").select(F.col("s_nationkey").cast("long").alias("partition"), F.col("s_suppkey").alias("node"), F.expr("CASE WHEN s_suppkey % 3 = 0 THEN 'idle' WHEN s_suppkey % 3 = 1 THEN 'mixed' ELSE 'down' END").alias("state"))
    q = table(spark, sf, "orders").select((F.col("o_orderkey") % 25).alias("partition"), F.expr("CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderstatus = 'O' THEN 'running' ELSE 'done' END").alias("state"), (F.col("o_custkey") % 100).alias("node"))
    return jobs.placement(n, q)


@query(
    "placement_host_lists",
    """WITH n AS (SELECT s_nationkey % 5 AS p, s_suppkey AS node, CASE WHEN s_acctbal > 6000 THEN 'idle' WHEN s_acctbal > 1000 THEN 'mixed' ELSE 'down' END AS st FROM supplier), h AS (SELECT p, count(*) FILTER (st = 'idle') AS idle, count(*) FILTER (st = 'mixed') AS mix FROM n WHERE st <> 'down' GROUP BY 1),
    q AS (SELECT o_orderkey AS job, o_custkey % 5 AS p, o_orderstatus AS st, o_custkey % 90 AS low, o_custkey % 90 + (o_totalprice::BIGINT % 6) AS high, o_custkey % 37 AS other FROM orders),
    l AS (SELECT p, count(*) FILTER (st = 'P') AS pending, count(*) FILTER (st = 'O' AND EXISTS (SELECT 1 FROM n WHERE n.p = q.p AND n.st <> 'down' AND (n.node BETWEEN q.low AND q.high OR n.node = q.other))) AS running FROM q GROUP BY 1)
    SELECT h.p AS partition, idle, mix, coalesce(pending, 0) AS pending, coalesce(running, 0) AS running, idle * 100 + mix * 25 - coalesce(pending, 0) * 10 - coalesce(running, 0) * 5 AS score FROM h LEFT JOIN l ON l.p = h.p""",
)
def placement_host_lists(spark, sf):
    """Placement with the queue's host lists: a range and another host; a job counts once."""
    n = table(spark, sf, "supplier").select((F.col("s_nationkey") % 5).cast("long").alias("partition"), F.format_string("n%04d", "s_suppkey").alias("node"), F.expr("CASE WHEN s_acctbal > 6000 THEN 'idle' WHEN s_acctbal > 1000 THEN 'mixed' ELSE 'down' END").alias("state"))
    hosts = F.expr("format_string('n[%04d-%04d],n%04d', o_custkey % 90, o_custkey % 90 + cast(rint(o_totalprice) AS bigint) % 6, o_custkey % 37)")
    q = table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), (F.col("o_custkey") % 5).alias("partition"), F.expr("CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'O' THEN 'running' ELSE 'done' END").alias("state"), hosts.alias("nodes"))
    return jobs.placement(n, jobs.queue_on_nodes(q, n))


OLD, NEW = "doc_id % 10 <> 3", "doc_id % 10 <> 7"


def snapshots(spark, sf):
    d = table(spark, sf, "documents")
    old = d.where(OLD).select("doc_id", F.col("n_chars").alias("signature"))
    new = d.where(NEW).select("doc_id", F.expr("CASE WHEN doc_id % 4 = 1 THEN n_chars + 1 ELSE n_chars END").alias("signature"))
    return old, new


@query("incremental_diff", "SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'added' WHEN doc_id % 10 = 7 THEN 'removed' WHEN doc_id % 4 = 1 THEN 'changed' ELSE 'same' END AS change FROM documents")
def incremental_diff(spark, sf):
    return incremental.diff(*snapshots(spark, sf), "doc_id", "signature")


@query("incremental_apply", "SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN n_chars + 1 ELSE n_chars END AS signature FROM documents WHERE doc_id % 10 <> 7")
def incremental_apply(spark, sf):
    old, new = snapshots(spark, sf)
    return incremental.apply(old, new, incremental.diff(old, new, "doc_id", "signature"), "doc_id")


@query("corpus_fingerprint", f"WITH {DOCS} SELECT source, count(*) AS entries, sha256(string_agg(sha256(path || chr(31) || length(content)), '' ORDER BY path)) AS fingerprint FROM docs GROUP BY source")
def corpus_fingerprint(spark, sf):
    d = docs(spark, sf).withColumn("size", F.char_length("content"))
    return incremental.fingerprint(d, ["source"], "path", ["path", "size"])


def beats(spark, sf):
    return table(spark, sf, "events").select("event_id", "ts", F.col("user_id").alias("job_id"), F.expr("CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'succeeded' ELSE 'running' END").alias("state"), F.col("value").alias("percent"))


@query(
    "heartbeat_latest",
    "SELECT user_id AS job_id, max(ts) AS last_at, arg_max(CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'succeeded' ELSE 'running' END, (ts, event_id)) AS state, arg_max(value, (ts, event_id)) AS percent, count(*) AS beats FROM events GROUP BY 1",
)
def heartbeat_latest(spark, sf):
    return heartbeats.newest(beats(spark, sf))


@query(
    "heartbeat_timeout",
    "WITH l AS (SELECT user_id AS job_id, max(ts) AS last_at, arg_max(event_type, (ts, event_id)) AS e FROM events GROUP BY 1) SELECT job_id, last_at FROM l WHERE last_at < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 45 SECOND AND e NOT IN ('error', 'purchase')",
)
def heartbeat_timeout(spark, sf):
    return heartbeats.overdue(beats(spark, sf), F.lit("2024-01-30 12:00:00").cast("timestamp")).select("job_id", "last_at")


@query("heartbeat_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'succeeded' ELSE 'running' END AS state, count(*) AS beats FROM events GROUP BY 1, 2")
def heartbeat_windows(spark, sf):
    return heartbeats.per_window(beats(spark, sf))


@query("submission_once", "SELECT 'k' || (user_id % 40) AS cache_key, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def submission_once(spark, sf):
    return heartbeats.once(table(spark, sf, "events").select("event_id", "ts", F.concat(F.lit("k"), F.col("user_id") % 40).alias("cache_key")))


@query("job_transitions", "SELECT user_id AS job_id, arg_max(s, (ts, s)) AS state, min(ts) FILTER (s = 'running') AS started_at, CASE WHEN arg_max(s, (ts, s)) IN ('failed', 'succeeded') THEN min(ts) FILTER (s IN ('failed', 'succeeded')) END AS completed_at FROM (SELECT *, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'succeeded' ELSE 'running' END AS s FROM events) GROUP BY 1")
def job_transitions(spark, sf):
    return jobs.transitions(beats(spark, sf).select("job_id", "state", F.col("ts").alias("at")))


@query("job_states_stream", SQL["job_transitions"])
def job_states_stream(spark, sf):
    """The same from a stream of events that keeps what each batch says of its jobs."""
    folder = Scratch(spark, "states").path
    e = files.stream(spark, f"{sf}/events.parquet", "event_id long, ts timestamp_ntz, user_id long, event_type string")
    e = e.select(F.col("user_id").alias("job_id"), F.expr("CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'succeeded' ELSE 'running' END").alias("state"), F.col("ts").cast("timestamp").alias("at"))
    sinks.job_states(e, f"{folder}/out", f"{folder}/checkpoint", ["running", "failed", "succeeded"]).awaitTermination()
    return sinks.current_states(spark, f"{folder}/out")


@query(
    "tier_retry_profiles",
    """WITH t AS (SELECT s_suppkey AS job_id, ['cpu-rag-indexing', 'p40-rag-compression', 'p40-retrieval', 'p40-synthesis', 'v100-reasoning', 'a100-single', 'a100-multigpu', 'a100-reasoning'][s_suppkey % 8 + 1] AS tier FROM supplier)
    SELECT job_id, tier, CASE tier WHEN 'cpu-rag-indexing' THEN 'p40-rag-compression' WHEN 'p40-rag-compression' THEN 'a100-reasoning' WHEN 'p40-retrieval' THEN 'p40-synthesis' WHEN 'p40-synthesis' THEN 'v100-reasoning' WHEN 'v100-reasoning' THEN 'a100-single' WHEN 'a100-reasoning' THEN 'a100-reasoning' ELSE 'a100-multigpu' END AS retry_tier,
    CASE WHEN tier IN ('p40-synthesis', 'a100-single', 'a100-multigpu') THEN 4 ELSE 1 END AS retry_gpus, regexp_extract(tier, '^(p40|v100|a100)-', 1) AS accelerator, CASE WHEN tier = 'cpu-rag-indexing' THEN 'normal' ELSE 'scavenger' END AS qos FROM t""",
)
def tier_retry_profiles(spark, sf):
    t = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("job_id"), F.expr("element_at(array('cpu-rag-indexing', 'p40-rag-compression', 'p40-retrieval', 'p40-synthesis', 'v100-reasoning', 'a100-single', 'a100-multigpu', 'a100-reasoning'), cast(s_suppkey % 8 as int) + 1)").alias("tier"), F.lit("").alias("backend"), F.lit("").alias("runtime"))
    rows = tiers.with_retry_profile(t)
    return rows.select("job_id", "tier", "retry_tier", "retry_gpus", tiers.accelerator(F.col("tier")).alias("accelerator"), tiers.placement_hint(F.col("tier"), F.lit(""))["qos"].alias("qos"))


@query(
    "result_policy",
    """SELECT doc_id AS job_id, CASE WHEN s AND w <> '' THEN 'failed' ELSE 'succeeded' END AS state, CASE WHEN s AND w <> '' THEN 'broker_policy_retrieval_quality_insufficient' WHEN n THEN 'broker_policy_no_real_retrieval_backend' ELSE '' END AS error,
    CASE WHEN s AND w <> '' THEN w || ',broker_retrieval_quality_gate_failed' ELSE w END AS warnings FROM (SELECT doc_id, doc_id % 4 = 0 AS s, doc_id % 3 = 1 AS n, CASE doc_id % 3 WHEN 0 THEN 'broker_local_retrieval_degraded' WHEN 1 THEN 'broker_no_real_retrieval_backend' ELSE '' END AS w FROM documents)""",
)
def result_policy(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("job_id"), F.lit("succeeded").alias("state"), F.lit("").alias("error"), F.expr("CASE doc_id % 3 WHEN 0 THEN array('LOCAL_RETRIEVAL_DEGRADED') WHEN 1 THEN array('NO_REAL_RETRIEVAL_BACKEND') ELSE array('other') END").alias("warnings"), (F.col("doc_id") % 4 == 0).alias("strict"))
    return tiers.result_policy(d).withColumn("warnings", F.array_join("warnings", ","))


@query(
    "synthesis_ladder",
    """SELECT o_custkey AS root_job_id, CASE WHEN NOT bool_or(o_orderstatus = 'O') THEN 'p40-synthesis' WHEN NOT bool_or(o_orderstatus = 'F') THEN 'v100-reasoning' WHEN bool_or(o_orderstatus = 'P') THEN NULL WHEN o_custkey % 2 = 0 THEN 'a100-multigpu' ELSE 'a100-single' END AS next_tier FROM orders GROUP BY 1""",
)
def synthesis_ladder(spark, sf):
    tier = F.expr("CASE o_orderstatus WHEN 'O' THEN 'p40-synthesis' WHEN 'F' THEN 'v100-reasoning' ELSE 'a100-single' END")
    rows = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("root_job_id")).agg(F.collect_set(tier).alias("attempted"))
    return rows.select("root_job_id", tiers.next_synthesis_tier(F.col("attempted"), F.when(F.col("root_job_id") % 2 == 0, "oom").otherwise("timeout")).alias("next_tier"))


NOW = "2024-01-16 00:00:00"


def services(spark, sf):
    """Suppliers as services of four tiers, in every state of decay."""
    e = F.expr
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("service_id"),
        e("concat('tier', s_suppkey % 4)").alias("tier"),
        e("CASE WHEN s_suppkey % 5 = 0 THEN 'starting' ELSE 'ready' END").alias("state"),
        e("CASE WHEN s_suppkey % 7 = 0 THEN 'failed' ELSE 'running' END").alias("scheduler_state"),
        e(f"timestamp'{NOW}' + make_interval(0, 0, 0, 0, 0, 0, s_suppkey % 9 - 4)").alias("startup_deadline"),
        e(f"timestamp'{NOW}' + make_interval(0, 0, 0, 0, s_suppkey % 6 - 1)").alias("lease_expires_at"),
        e(f"timestamp'{NOW}' + make_interval(0, 0, 0, 1)").alias("absolute_lease_expires_at"),
        e(f"timestamp'{NOW}' - make_interval(0, 0, 0, 0, 0, 0, 10 * (s_suppkey % 8))").alias("heartbeat_at"),
        e("CASE WHEN s_suppkey % 11 = 0 THEN '' ELSE concat('http://n', s_suppkey) END").alias("endpoint"),
        F.lit(None).cast("timestamp").alias("created_at"),
    )


REASON = """CASE WHEN s_suppkey % 4 = 3 THEN 'profile_removed' WHEN s_suppkey % 7 = 0 THEN 'terminal' WHEN s_suppkey % 5 = 0 AND s_suppkey % 9 <= 4 THEN 'startup_timeout' WHEN s_suppkey % 5 = 0 THEN NULL
 WHEN s_suppkey % 6 <= 1 THEN 'lease_expired' WHEN s_suppkey % 8 >= 5 THEN 'heartbeat_lost' WHEN s_suppkey % 11 = 0 THEN 'endpoint_unhealthy' END"""


@query("service_retirement", f"SELECT s_suppkey AS service_id, {REASON} AS reason FROM supplier")
def service_retirement(spark, sf):
    now = F.lit(NOW).cast("timestamp")
    return services(spark, sf).select("service_id", jobs.retirement_reason(now, ["tier0", "tier1", "tier2"]).alias("reason"))


@query("service_routable", "SELECT s_suppkey AS service_id FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey % 11 <> 0 AND s_suppkey % 6 > 1 AND s_suppkey % 8 <= 4")
def service_routable(spark, sf):
    return jobs.routable(services(spark, sf), F.lit(NOW).cast("timestamp")).select("service_id")


@query(
    "demand_binding",
    """WITH s AS (SELECT s_suppkey AS id, 'tier' || (s_suppkey % 4) AS tier, s_suppkey % 5 <> 0 AS ready, s_suppkey % 6 AS lease FROM supplier), b AS (SELECT tier, arg_max(id, (ready, lease, id)) AS service_id, arg_max(ready, (ready, lease, id)) AS ready FROM s GROUP BY 1)
    SELECT c_custkey AS demand_id, 'tier' || (c_custkey % 5) AS tier, service_id, CASE WHEN service_id IS NULL THEN 'launch' WHEN ready THEN 'bind' ELSE 'wait' END AS action FROM customer LEFT JOIN b ON b.tier = 'tier' || (c_custkey % 5)""",
)
def demand_binding(spark, sf):
    d = table(spark, sf, "customer").select(F.col("c_custkey").alias("demand_id"), F.expr("concat('tier', c_custkey % 5)").alias("tier"))
    return jobs.bind(d, services(spark, sf))


@query("tier_roll_up", "SELECT 'tier' || (s_suppkey % 4) AS tier, count(*) FILTER (s_suppkey % 5 <> 0) AS active, count(*) FILTER (s_suppkey % 5 = 0) AS starting, array_to_string(list_sort(list('http://n' || s_suppkey) FILTER (s_suppkey % 11 <> 0)), ',') AS endpoints FROM supplier GROUP BY 1")
def tier_roll_up(spark, sf):
    return jobs.tier_roll_up(services(spark, sf))


@query("host_lists", "SELECT s_suppkey, 'n' || lpad((unnest([s_suppkey % 7 + 1, s_suppkey % 7 + 2, 77]))::VARCHAR, 2, '0') AS host FROM supplier")
def host_lists(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", F.expr("concat('n[0', s_suppkey % 7 + 1, '-0', s_suppkey % 7 + 2, ',77]')").alias("nodes"))
    return jobs.expand_hosts(s, "nodes").select("s_suppkey", "host")


@query("lru_newest", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 8")
def lru_newest(spark, sf):
    return incremental.newest(table(spark, sf, "events").select("user_id", "event_id"), ["user_id"], "event_id", 8)


@query("request_validation", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'mode,' ELSE '' END || CASE WHEN o_orderkey % 3 = 0 THEN 'final_pack_budget,' ELSE '' END || CASE WHEN o_orderkey % 5 = 0 THEN 'reserved_key,' ELSE '' END AS errors FROM orders")
def request_validation(spark, sf):
    r = table(spark, sf, "orders").select("o_orderkey", F.lit("rag_compress").alias("task_type"), F.expr("CASE WHEN o_orderkey % 4 = 0 THEN 'odd' ELSE 'auto' END").alias("mode"), F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 100 ELSE 0 END").alias("final_pack_budget"), F.lit(60).alias("runtime_s"), F.expr("CASE WHEN o_orderkey % 5 = 0 THEN array('_x') ELSE array('x') END").alias("params"))
    return r.select("o_orderkey", F.array_join(F.transform(governance.request_errors(), lambda x: F.concat(x, F.lit(","))), "").alias("errors"))
