"""Contracts of results and requests, checked on their JSON text.

Texts are parsed once into variants; each rule is a Column over them, so a table of results is checked in its own scan,
without Python. A value of another type than the contract's counts as missing; text that is no JSON breaks every
rule that needs a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.classes import chain

# What results and requests may say.
SCHEMA_NAME, SCHEMA_VERSION = "repo_inspection_v2", "2.0.0"
QUALITY = {"result": ["answer_ready", "evidence_only", "failed"], "retrieval": ["gpu", "lexical_degraded", "failed"], "reranking": ["gpu", "unavailable", "failed"], "synthesis": ["gpu", "not_requested", "failed"]}
OPERATIONS = ["semantic_retrieval", "rerank", "synthesis"]
STATUSES = ["succeeded", "failed", "degraded"]
TIER_GPUS = {"p40-retrieval": 1, "p40-synthesis": 1, "v100-reasoning": 4, "a100-single": 1, "a100-multigpu": 4}
MODES = ["auto", "evidence", "answer"]
RESERVED_PREFIX = "gpu_service"
RESERVED_KEYS = ["service_endpoints", "endpoint_selections", "runtime_services", "service_selection", "index_cache_dir", "repo_inspection_cache_path"]
BUDGETS = ["retrieval_token_budget", "evidence_token_budget", "final_pack_token_budget", "synthesis_context_token_budget"]
MOST_EVIDENCE, MOST_QUERY_BYTES, MOST_RUNTIME_S, LEAST_PACK, LEAST_ANSWER_PACK = 12, 2048, 86400, 2048, 4096


def kind(v: Column, path: str) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, VOID, a number's type, or null where there is nothing."""
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get(v, path, "variant")), "^[A-Z]+", 0)


def is_kind(v: Column, path: str, name: str) -> Column:
    return F.coalesce(kind(v, path) == name, F.lit(False))


def text_at(v: Column, path: str) -> Column:
    """A trimmed text, empty where there is no text."""
    return F.coalesce(F.when(kind(v, path) == "STRING", F.trim(F.try_variant_get(v, path, "string"))), F.lit(""))


def list_at(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def whole_number(v: Column, path: str) -> Column:
    """A number without a fraction, else null."""
    number = F.when(~kind(v, path).isin("STRING", "BOOLEAN"), F.try_variant_get(v, path, "double"))
    return F.when(number == F.floor(number), number.cast("long"))


def attempts_of(v: Column, path: str = "$.payload.runtime.attempts") -> Column:
    """The attempts of a result as an array of structs, in their order; given is false for one that is no object."""
    fields = ("operation", "tier", "status", "model_profile", "slurm_job_id")
    one = lambda a: F.struct(is_kind(a, "$", "OBJECT").alias("given"), *(text_at(a, f"$.{c}").alias(c) for c in fields), whole_number(a, "$.gpu_count").alias("gpu_count"))
    return F.transform(list_at(v, path), one)


def gpus_of(tier: Column) -> Column:
    return chain([(tier == t, n) for t, n in TIER_GPUS.items()], F.lit(None).cast("int"))


def out_of_turn(attempts: Column, a: Column, place: Column) -> Column:
    """Which rule of turns a synthesis attempt at a 0-based place breaks: V100 needs P40 before it, A100 both; else null."""
    at = lambda tier: F.coalesce(F.array_position(F.transform(attempts, lambda x: (x["operation"] == "synthesis") & (x["tier"] == tier)), True), F.lit(0))
    after = lambda tier: (at(tier) > 0) & (at(tier) <= place)
    v100, a100 = a["tier"] == "v100-reasoning", a["tier"].isin("a100-single", "a100-multigpu")
    return F.when(a["operation"] == "synthesis", chain([(v100 & ~after("p40-synthesis"), "v100_before_p40"), (a100 & ~(after("p40-synthesis") & after("v100-reasoning")), "a100_before_v100")], F.lit(None).cast("string")))


def attempt_errors(attempts: Column) -> Column:
    """For every attempt that breaks a rule, the first one it breaks as code[place], in order: so the first entry is what a checker that stops says."""

    def one(a: Column, i: Column) -> Column:
        search = a["operation"].isin("semantic_retrieval", "rerank")
        rules = [
            (~a["given"], "object"),
            (~a["operation"].isin(*OPERATIONS), "operation"),
            (~a["tier"].isin(*TIER_GPUS), "tier"),
            (~a["status"].isin(*STATUSES), "status"),
            (F.coalesce(a["gpu_count"] < 1, F.lit(True)), "gpu_count"),
            (a["gpu_count"] != gpus_of(a["tier"]), "tier_gpu_count"),
            (search & (a["tier"] != "p40-retrieval"), "retrieval_tier"),
            (~search & (a["tier"] == "p40-retrieval"), "synthesis_tier"),
        ]
        code = F.coalesce(chain(rules, F.lit(None).cast("string")), out_of_turn(attempts, a, i))
        return F.when(code.isNotNull(), F.concat(code, F.lit("["), i.cast("string"), F.lit("]")))

    return F.array_compact(F.transform(attempts, one))


def success_errors(attempts: Column) -> Column:
    """What an answer's attempts lack: its first success of each operation names its GPUs, model and job, all three are there, and in order."""
    won = lambda op: lambda a: (a["operation"] == op) & (a["status"] == "succeeded")
    succeeded = lambda op: F.get(F.filter(attempts, won(op)), F.lit(0))
    at = {op: F.coalesce(F.array_position(F.transform(attempts, won(op)), True), F.lit(0)) for op in OPERATIONS}
    found = []
    for op in OPERATIONS:
        one = succeeded(op)
        right = F.coalesce(one["gpu_count"] == F.coalesce(gpus_of(one["tier"]), F.lit(1)), F.lit(False))
        found += [F.when(one.isNotNull() & ~right, F.lit(f"{op}_gpu_count")), F.when(one["model_profile"] == "", F.lit(f"{op}_model")), F.when(one["slurm_job_id"] == "", F.lit(f"{op}_job"))]
    there = (at["semantic_retrieval"] > 0) & (at["rerank"] > 0) & (at["synthesis"] > 0)
    found += [F.when(~there, F.lit("missing_success")), F.when(there & ~((at["semantic_retrieval"] < at["rerank"]) & (at["rerank"] < at["synthesis"])), F.lit("success_order"))]
    turns = F.transform(attempts, lambda a, i: out_of_turn(attempts, a, i))
    return F.array_compact(F.concat(F.array(*found), turns))


def checked_results(results: DataFrame, result: str = "result", mode: str = "mode", query: str = "query") -> DataFrame:
    """results with a result's JSON, the mode and the query that were asked -> the same rows with errors (distinct codes, sorted), attempt_errors, and citations that are valid, invalid and missing."""
    P = "$.payload"
    v = F.col("_v")
    rows = results.withColumn("_v", F.try_parse_json(F.col(result)))
    evidence = F.transform(list_at(v, f"{P}.evidence"), lambda e: F.struct(F.when(is_kind(e, "$", "OBJECT"), F.nullif(F.trim(F.try_variant_get(e, "$.id", "string")), F.lit(""))).alias("id"), (F.size(list_at(e, "$.source_refs")) > 0).alias("sourced")))
    refs = F.transform(list_at(v, f"{P}.findings"), lambda f: F.filter(F.coalesce(F.try_variant_get(f, "$.evidence_refs", "array<string>"), F.array().cast("array<string>")), lambda r: r != ""))
    quality = F.struct(*(text_at(v, f"{P}.quality.{c}").alias(c) for c in QUALITY), F.when(is_kind(v, f"{P}.quality.answer_ready", "BOOLEAN"), F.try_variant_get(v, f"{P}.quality.answer_ready", "boolean")).alias("ready"))
    rows = rows.withColumns({"_attempts": attempts_of(v), "_evidence": evidence, "_refs": refs, "_q": quality, "_answer": text_at(v, f"{P}.answer"), "_given": kind(v, f"{P}.answer").isNotNull()})
    answered, asked = F.col("_answer") != "", F.col(mode)
    q, ids = F.col("_q"), F.transform("_evidence", lambda e: e["id"])
    named = F.array_compact(ids)
    broken = [
        (text_at(v, "$.schema_name") != SCHEMA_NAME, "schema_name"),
        (text_at(v, "$.schema_version") != SCHEMA_VERSION, "schema_version"),
        (~text_at(v, f"{P}.mode").eqNullSafe(asked), "mode"),
        (~text_at(v, f"{P}.query").eqNullSafe(F.col(query)), "query"),
        *((~q[c].isin(*allowed), f"quality_{c}") for c, allowed in QUALITY.items()),
        (q["ready"].isNull(), "quality_answer_ready"),
        (F.col("_given") & ~answered, "answer_text"),
        *((~is_kind(v, f"{P}.{c}", "ARRAY"), c) for c in ("findings", "evidence", "warnings")),
        *((~is_kind(v, f"{P}.{c}", "OBJECT"), c) for c in ("retrieval", "provenance")),
        (~is_kind(v, f"{P}.runtime.attempts", "ARRAY"), "runtime"),
        (F.size("_evidence") > MOST_EVIDENCE, "evidence_limit"),
        (F.exists(ids, lambda i: i.isNull()), "evidence_id"),
        (F.size(named) > F.size(F.array_distinct(named)), "evidence_repeats"),
        (F.exists("_evidence", lambda e: e["id"].isNotNull() & ~e["sourced"]), "evidence_sources"),
    ]
    ready = [(asked == "evidence", "mode_forbids_answer"), (q["result"] != "answer_ready", "answer_result")]
    ready += [(q[c] != "gpu", f"answer_{c}") for c in ("retrieval", "reranking", "synthesis")]
    ready += [(~F.coalesce(q["ready"], F.lit(False)), "answer_not_ready"), (F.size("_refs") == 0, "no_findings")]
    failed, nothing = q["result"] == "failed", (F.size("_evidence") == 0) & (q["retrieval"] == "failed")
    not_ready = F.coalesce(~q["ready"], F.lit(False))
    without = [
        (F.col("_given"), "answer_not_omitted"),
        (F.size("_refs") > 0, "findings_without_answer"),
        (failed & (asked != "answer"), "failed_needs_answer_mode"),
        (failed & ~not_ready, "failed_but_ready"),
        (failed & (F.size("_attempts") == 0) & ~nothing, "failed_without_attempts"),
        (~failed & ~((q["result"] == "evidence_only") & not_ready), "evidence_only_expected"),
        (~failed & (asked == "answer"), "answer_mode_unanswered"),
    ]
    codes = lambda rules: F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(code)) for bad, code in rules)))
    errors = F.concat(codes(broken), F.when(answered, F.concat(codes(ready), success_errors(F.col("_attempts")))).otherwise(codes(without)))
    cited = F.flatten("_refs")
    valid = F.size(F.filter(cited, lambda r: F.array_contains(named, r)))
    count = lambda c: F.when(answered, c).otherwise(0).cast("long")
    uncited = F.size(F.filter("_refs", lambda r: F.size(r) == 0)) + (F.size("_refs") == 0).cast("int")
    out = {"errors": F.array_sort(F.array_distinct(errors)), "attempt_errors": attempt_errors(F.col("_attempts")), "valid_citations": count(valid), "invalid_citations": count(F.size(cited) - valid), "missing_references": count(uncited)}
    return rows.withColumns(out).drop("_v", "_attempts", "_evidence", "_refs", "_q", "_answer", "_given")


def checked_requests(requests: DataFrame, request: str = "request") -> DataFrame:
    """requests with a request's JSON (task_type, output_schema, task_params, constraints) -> the same rows with errors: all rules that a submission breaks, in their order, and worker_errors, by the worker's stricter reading of budgets, where 0 is a value. Tasks other than the inspection have only their runtime checked."""
    v, P = F.col("_v"), "$.task_params"
    number = lambda name: F.coalesce(whole_number(v, f"$.constraints.{name}"), F.lit(0))
    rows = requests.withColumn("_v", F.try_parse_json(F.col(request)))
    asked = F.lower(text_at(v, f"{P}.mode"))
    keys = F.transform(F.coalesce(F.json_object_keys(F.get_json_object(F.col(request), P)), F.array().cast("array<string>")), lambda k: F.lower(F.trim(k)))
    rows = rows.withColumns({"_mode": F.when(asked == "", "auto").otherwise(asked), "_keys": keys, "_query": F.when(kind(v, f"{P}.query") == "STRING", F.try_variant_get(v, f"{P}.query", "string"))})
    pack, runtime = F.coalesce(F.nullif(number("final_pack_token_budget"), F.lit(0)), number("final_evidence_pack_budget")), number("max_runtime_seconds")
    inspection = text_at(v, "$.task_type") == "inspect_repo"
    least = F.when(F.col("_mode") == "answer", LEAST_ANSWER_PACK).otherwise(LEAST_PACK)
    rules = [
        (text_at(v, "$.output_schema.name") != SCHEMA_NAME, "output_schema"),
        (F.coalesce(F.trim("_query"), F.lit("")) == "", "query_required"),
        (F.octet_length("_query") > MOST_QUERY_BYTES, "query_bytes"),
        (~F.col("_mode").isin(*MODES), "mode"),
        (F.exists("_keys", lambda k: F.startswith(k, F.lit(RESERVED_PREFIX)) | k.isin(*RESERVED_KEYS)), "reserved_key"),
        *((number(b) < 0, b) for b in BUDGETS),
        ((pack > 0) & (pack < least), "final_pack_least"),
    ]
    say = lambda bad, code: F.when(F.coalesce(bad, F.lit(False)), F.lit(code))
    errors = F.array(say((runtime < 0) | (runtime > MOST_RUNTIME_S), "runtime"), *(say(inspection & bad, code) for bad, code in rules))
    given = F.coalesce(whole_number(v, "$.constraints.final_pack_token_budget"), whole_number(v, "$.constraints.final_evidence_pack_budget"))
    worker = F.array(say(given < least, "final_pack_least"), say((runtime < 0) | (runtime > MOST_RUNTIME_S), "runtime"))
    return rows.withColumns({"errors": F.array_compact(errors), "worker_errors": F.array_compact(worker)}).drop("_v", "_mode", "_keys", "_query")
