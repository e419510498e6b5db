"""Execution tiers, the task catalog, result policy and guidance texts as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.classes import chain

# Tasks, the schema of their results, whether an exact repeat may be answered from the cache.
CATALOG = [
    ("document_summary", "document_summary_v1", True), ("log_analysis", "log_analysis_v1", True), ("repo_summary", "repo_summary_v1", True), ("rag_compress", "rag_evidence_pack_v1", True),
    ("debug_with_local_context", "debug_evidence_pack_v1", False), ("summarize_logs", "log_evidence_pack_v1", True), ("inspect_repo", "repo_inspection_v2", True), ("propose_patch", "patch_proposal_pack_v1", False),
]
# The tier that a retry goes to, and its GPUs.
NEXT_TIER = {"cpu-rag-indexing": ("p40-rag-compression", 1), "p40-rag-compression": ("a100-reasoning", 1), "a100-reasoning": ("a100-reasoning", 1), "p40-retrieval": ("p40-synthesis", 1), "p40-synthesis": ("v100-reasoning", 4), "v100-reasoning": ("a100-single", 1), "a100-single": ("a100-multigpu", 4), "a100-multigpu": ("a100-multigpu", 4)}
# Failures of a model's size, after which the largest profile is next.
CAPACITY_FAILURES = ["oom", "context_overflow", "repeated_invalid_output", "model_limit"]
# What a result's warnings are called on release.
WARNING_NAMES = {"LOCAL_RETRIEVAL_DEGRADED": "broker_local_retrieval_degraded", "NO_REAL_RETRIEVAL_BACKEND": "broker_no_real_retrieval_backend", "IGNORED_PATH_RETRIEVAL_CONTAMINATION": "broker_ignored_path_retrieval_contamination"}


def schema_of(task: Column) -> Column:
    return chain([(task == t, s) for t, s, _ in CATALOG], F.lit(None).cast("string"))


def cacheable(task: Column) -> Column:
    return task.isin(*(t for t, _, c in CATALOG if c))


def accelerator(tier: Column) -> Column:
    """The family of GPU a tier runs on, empty for none."""
    return F.regexp_extract(tier, "^(p40|v100|a100)-", 1)


def next_tier(tier: Column) -> Column:
    return chain([(tier == t, n) for t, (n, _) in NEXT_TIER.items()], "p40-rag-compression")


def next_gpus(tier: Column) -> Column:
    return chain([(tier == t, g) for t, (_, g) in NEXT_TIER.items()], 1)


def with_retry_profile(jobs: DataFrame) -> DataFrame:
    """Adds where a retry of tier, backend and runtime would run."""
    blank = lambda c, v: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit(v))
    return jobs.withColumn("retry_tier", next_tier(F.trim("tier"))).withColumn("retry_gpus", next_gpus(F.trim("tier"))).withColumn("retry_backend", blank("backend", "slurm")).withColumn("retry_runtime", blank("runtime", "llama.cpp"))


def placement_hint(tier: Column, qos: Column) -> Column:
    """The queue a tier asks for, and why."""
    kind = accelerator(tier)
    why = chain([(kind == "p40", "Prefer a warm P40 service before starting an on-demand reasoning service."), (kind == "v100", "Use the four-GPU V100 reasoning profile after the warm P40 synthesis attempt failed."), (kind == "a100", "Use A100 only after recorded P40 and four-GPU V100 failures.")], "Use the broker-recommended local tier with non-blocking placement.")
    return F.struct(F.coalesce(F.nullif(qos, F.lit("")), F.when(kind == "", "normal").otherwise("scavenger")).alias("qos"), why.alias("rationale"))


def next_synthesis_tier(attempted: Column, failure: Column) -> Column:
    """From an array of tiers tried: P40, then V100, then one A100 profile by the last failure; null when all were tried."""
    tried = lambda t: F.array_contains(attempted, t)
    last = F.when(failure.isin(*CAPACITY_FAILURES), "a100-multigpu").otherwise("a100-single")
    return chain([(~tried("p40-synthesis"), "p40-synthesis"), (~tried("v100-reasoning"), "v100-reasoning"), (tried("a100-single") | tried("a100-multigpu"), F.lit(None).cast("string"))], last)


def profile_defaults(tier: Column, runtime: Column) -> Column:
    given = F.nullif(F.trim(runtime), F.lit(""))
    return F.coalesce(given, chain([(tier == "cpu-rag-indexing", "deterministic"), (tier.isin("p40-rag-compression", "a100-reasoning"), "llama.cpp")], ""))


def candidate_tiers(tier: Column) -> Column:
    return F.when(tier == "p40-rag-compression", F.array(F.lit("p40-rag-compression"), F.lit("a100-reasoning"))).otherwise(F.array(F.trim(tier)))


def result_policy(results: DataFrame) -> DataFrame:
    """results (job_id, state, error, warnings, strict) -> warnings as released, and the state and error after the quality gate."""
    renamed = F.transform(F.filter("warnings", lambda w: w.isin(*WARNING_NAMES)), lambda w: chain([(w == k, v) for k, v in WARNING_NAMES.items()], ""))
    gate = F.col("strict") & (F.size(renamed) > 0)
    error = F.when(gate, "broker_policy_retrieval_quality_insufficient").when(F.array_contains("warnings", "NO_REAL_RETRIEVAL_BACKEND") & (F.col("error") == ""), "broker_policy_no_real_retrieval_backend").otherwise(F.col("error"))
    return results.select("job_id", F.when(gate, "failed").otherwise(F.col("state")).alias("state"), error.alias("error"), F.array_distinct(F.when(gate, F.array_append(renamed, F.lit("broker_retrieval_quality_gate_failed"))).otherwise(renamed)).alias("warnings"))


def next_action(guidance: Column, task: Column) -> Column:
    """What an agent should do next, by how far the evidence can be trusted, else by task."""
    return chain(
        [
            (guidance == "lead_generation_only", "Retry with a stronger local backend or inspect the referenced files directly before answering."),
            (guidance == "verify_before_claiming", "Verify the cited files directly, then answer using only the confirmed evidence."),
            (task == "inspect_repo", "Start with the most relevant subsystem or symbol and cite the referenced files."),
            (task == "debug_with_local_context", "Lead with the highest-confidence root cause candidate and validate it against the cited code and logs."),
            (task == "summarize_logs", "Summarize the dominant failure cluster first, then use the cited log evidence to guide the next step."),
            (task == "propose_patch", "Keep the patch scoped to the cited files and validate the change against the referenced evidence."),
        ],
        "Use the cited evidence directly in the answer.",
    )
