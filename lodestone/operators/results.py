"""Results of jobs: their checks, keys, plans and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.classes import chain
from lodestone.operators.governance import errors_of
from lodestone.operators.incremental import key

# How real a backend is, most real first.
MODES = ["real", "fallback", "heuristic", "unavailable"]
# New name, old name and default of each token budget.
BUDGETS = [("retrieval_token_budget", "retrieved_chunk_budget", 32000), ("evidence_token_budget", "final_evidence_pack_budget", 12000), ("final_pack_token_budget", "final_evidence_pack_budget", 8000), ("synthesis_context_token_budget", "remote_model_context_budget", 16000)]
# The steps of a run, in order.
STAGES = ["input_discovery", "chunking", "local_indexing", "retrieval", "reranking", "deduplication", "evidence_preserving_compression", "json_validation"]


def token_budgets(constraints: Column) -> list[Column]:
    """A map's budgets: the new key, else the old one, else the default. No number counts as missing; a number of 0 or less is an error."""
    out = []
    for name, old, default in BUDGETS:
        given = F.coalesce(F.try_element_at(constraints, F.lit(name)), F.try_element_at(constraints, F.lit(old))).try_cast("int")
        bad = F.raise_error(F.lit(f"{name} must be positive")).cast("int")
        out.append(F.when(given <= 0, bad).otherwise(F.coalesce(given, F.lit(default))).alias(name))
    return out


def combined_mode(rows: DataFrame, group: str, mode: str = "mode") -> DataFrame:
    """The most real of a group's backend modes."""
    rank = chain([(F.col(mode) == m, len(MODES) - i) for i, m in enumerate(MODES)], 0)
    return rows.groupBy(group).agg(F.max_by(mode, F.struct(rank, mode)).alias(mode))


def is_degraded(quality: Column, modes: Column, warnings: Column) -> Column:
    """A result that failed, that nothing real stood behind, or that says so."""
    said = F.arrays_overlap(warnings, F.array(F.lit("LOCAL_RETRIEVAL_DEGRADED"), F.lit("NO_REAL_RETRIEVAL_BACKEND")))
    return (quality == "failed") | ~F.array_contains(modes, "real") | F.coalesce(said, F.lit(False))


def retry_recommendation(payload: Column) -> Column:
    """struct<recommended, reason, tier> of a payload's JSON; not recommended where it says nothing."""
    r = F.from_json(F.get_json_object(payload, "$.retry_recommendation"), "recommended boolean, reason string, tier string")
    return F.struct(F.coalesce(r["recommended"], F.lit(False)).alias("recommended"), F.coalesce(r["reason"], F.lit("")).alias("reason"), F.coalesce(r["tier"], F.lit("")).alias("tier"))


def reducer_metrics(payload: Column) -> Column:
    """struct<children_total, children_succeeded, children_failed, coverage_fraction> of a reducer's payload."""
    return F.from_json(payload, "children_total int, children_succeeded int, children_failed int, coverage_fraction double")


def ordered_attempts(attempts: Column) -> Column:
    """Whether retrieval, reranking and synthesis were all tried, each after the one before."""
    at = [F.array_position(attempts, step) for step in ("retrieval", "reranking", "synthesis")]
    return (at[0] > 0) & (at[1] > at[0]) & (at[2] > at[1])


# What each result schema must hold: key, JSON type.
SHAPES = {
    "document_summary": [("summary", "string"), ("key_points", "array")],
    "log_analysis": [("summary", "string"), ("findings", "array")],
    "repo_summary": [("summary", "string"), ("subsystems", "array")],
    "rag_compress": [("summary", "string"), ("evidence", "array")],
    "debug_with_local_context": [("summary", "string"), ("hypotheses", "array")],
    "summarize_logs": [("summary", "string"), ("clusters", "array")],
    "propose_patch": [("summary", "string"), ("patches", "array")],
}


def shape_errors(schema: Column, payload: Column) -> Column:
    """What a payload's JSON lacks of its schema: a message for each key that is missing or of another type; an unknown schema, or a payload that is no object, is one error."""
    value = F.try_parse_json(payload)
    kind = lambda k: F.schema_of_variant(F.try_variant_get(value, f"$.{k}", "variant"))
    fits = lambda k, t: kind(k) == "STRING" if t == "string" else kind(k).startswith("ARRAY")
    known = F.array().cast("array<string>")
    for name, shape in SHAPES.items():
        known = F.when(schema == name, errors_of([(fits(k, t), f"{name}.{k} must be {'a string' if t == 'string' else 'a list'}") for k, t in shape])).otherwise(known)
    whole = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    return F.when(~schema.isin(*SHAPES), F.array(F.lit("unknown schema"))).when(~whole, F.array(F.lit("payload must be an object"))).otherwise(known)


def echo_errors(query: Column, mode: Column, said_query: Column, said_mode: Column) -> Column:
    """An inspection must repeat the question and the mode that were asked."""
    return errors_of([(said_query == query, "query differs from the request"), (said_mode == mode, "mode differs from the request")])


def ingested(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """jobs (job_id, state), results (job_id, schema, payload): a job that ended, or whose result is there, takes it in; any error of its shape makes it failed."""
    rows = jobs.join(results, "job_id", "left")
    took = F.col("payload").isNotNull() | (F.col("state") == "succeeded")
    errors = F.when(F.col("payload").isNull(), F.array(F.lit("result is missing"))).otherwise(shape_errors(F.col("schema"), F.col("payload")))
    rows = rows.withColumn("errors", F.when(took, errors).otherwise(F.array().cast("array<string>")))
    state = F.when(took & (F.size("errors") > 0), "failed").when(took, "succeeded").otherwise(F.col("state"))
    return rows.select("job_id", state.alias("state"), "errors")


def stable_profile(tier: Column, model: Column, runtime: Column, accelerator: Column) -> dict[str, Column]:
    """What of a profile counts in a cache key."""
    text = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return {"tier": text(tier), "model": F.coalesce(model, F.lit("")), "runtime": text(runtime), "accelerator": text(accelerator)}


def stage_key(query: Column, fingerprint: Column, signature: Column, budgets: list[Column]) -> Column:
    """The cache key of a query's stage: the question, the corpus, the settings and the four budgets."""
    return key({"query": query, "fingerprint": fingerprint, "signature": signature} | {f"budget{i}": b for i, b in enumerate(budgets)})


def chunk_key(namespace: Column, path: Column, language: Column, content: Column, config: Column) -> Column:
    """The cache key of a file's chunks."""
    return key({"namespace": namespace, "path": path, "language": language, "content": F.sha2(content, 256), "config": config})


def alias_rows(requests: DataFrame, found: DataFrame) -> DataFrame:
    """requests (request_id, cache_key, owner), found (cache_key, job_id): a new job for each hit, which points at the job whose result it takes."""
    return requests.join(found, "cache_key").select(F.concat(F.lit("alias_"), "request_id").alias("job_id"), "cache_key", "owner", F.lit("succeeded").alias("state"), F.col("job_id").alias("alias_of"))


def patch_plan(evidence: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """One row: where a patch would go, why, the first three records behind it, and how sure. The path is the first allowed one, else that of the first record of code, else of the first record."""
    code = F.min(F.when(F.col("path").rlike(r"\.(go|py|js|ts|rs|java|c|cc|cpp|h|rb|sh)$"), F.struct("n", "path")))
    first = F.min(F.struct("n", "path", "claim", "confidence"))
    refs = F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("n") <= 3, F.struct("n", "evidence_id")))), 1, 3), lambda x: x["evidence_id"])
    row = evidence.agg(code.alias("code"), first.alias("first"), refs.alias("evidence_refs"))
    target = F.lit(allowed[0]) if allowed else F.coalesce("code.path", "first.path")
    return row.select(target.alias("target_path"), F.coalesce("first.claim", F.lit("")).alias("rationale"), "evidence_refs", F.coalesce("first.confidence", F.lit(0.3)).alias("confidence"), F.lit(False).alias("diff_inline"), F.lit(True).alias("release_requires_approval"))


def validation_report(evidence: DataFrame, budget: int, warnings: list[str]) -> DataFrame:
    """One row: how many records, whether each says where it is from, whether they fit the budget, and the warnings."""
    present = F.coalesce(F.bool_and((F.coalesce("path", F.lit("")) != "") & F.col("line_start").isNotNull()), F.lit(True))
    tokens = F.coalesce(F.sum(T.tokens_v1(F.col("claim")) + T.tokens_v1(F.col("excerpt_preview"))), F.lit(0))
    row = evidence.agg(F.count(F.lit(1)).alias("evidence_count"), present.alias("all_evidence_refs_present"), tokens.alias("final_pack_tokens"))
    return row.select(F.array(*map(F.lit, STAGES)).alias("pipeline_stages"), "*", (F.col("final_pack_tokens") <= budget).alias("budget_ok"), F.array(*map(F.lit, warnings)).cast("array<string>").alias("warnings"))
