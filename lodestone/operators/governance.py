"""Classification, release, redaction, validation, and the hash chain of audit events."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.classes import BROKER_RANKS, SENSITIVE, WORKER_RANKS, broker_class, chain, rank_of
from lodestone.operators.folds import in_order

# Keys that a release hides.
REDACTED = "[REDACTED]"
HIDDEN_TEXT, HIDDEN_LISTS = ("excerpt", "raw_excerpt", "content", "source_text"), ("paths", "related_paths")


def highest_classification(items: DataFrame, group: str, worker: bool = True) -> DataFrame:
    """The highest classification of a group, by a worker's ranks (unknown lowest) or the broker's (unknown above public)."""
    value = F.coalesce("classification", F.lit("unknown")) if worker else broker_class(F.col("classification"))
    rank = rank_of(F.col("v"), WORKER_RANKS, -1) if worker else rank_of(F.col("v"), BROKER_RANKS, 3)
    rows = items.withColumn("v", value).where("v IS NOT NULL").withColumn("r", rank)
    best = rows.groupBy(group).agg(F.max_by("v", F.struct("r", "v")).alias("classification"), F.max("r").alias("r"))
    return best.select(group, F.when(F.col("r") < 0, "unknown").otherwise(F.col("classification")).alias("classification"))


def is_sensitive(confidentiality: Column, classifications: Column) -> Column:
    """local_only, or any sensitive class among an array of them."""
    return (F.lower(confidentiality) == "local_only") | F.exists(classifications, lambda c: F.lower(F.trim(c)).isin(*SENSITIVE))


def release(jobs: DataFrame) -> DataFrame:
    """jobs (job_id, confidentiality, classifications of inputs and artifacts, override, payload as JSON, artifacts): what of a result may go out. A sensitive payload keeps its shape, with known keys hidden."""
    hide = is_sensitive(F.col("confidentiality"), F.col("classifications"))
    warnings = F.array_compact(F.array(F.when(hide, F.lit("broker_redacted_sensitive_fields")), F.when(hide & ~F.col("override"), F.lit("broker_withheld_artifacts")), F.when(hide & F.col("override"), F.lit("broker_removed_artifact_paths"))))
    redacted = redact_json(F.when(hide, F.col("payload")))
    return jobs.select("job_id", hide.alias("sensitive"), warnings.alias("warnings"), F.when(hide & ~F.col("override"), 0).otherwise(F.col("artifacts")).alias("artifacts_released"), F.when(hide, redacted).otherwise(F.col("payload")).alias("payload"))


def log_release(jobs: DataFrame) -> DataFrame:
    denied = chain([(F.col("override"), F.lit(None).cast("string")), (F.lower("confidentiality") == "local_only", "local_only"), (F.exists("classifications", lambda c: F.lower(F.trim(c)).isin(*SENSITIVE)), "classification")], F.lit(None).cast("string"))
    return jobs.select("job_id", denied.isNull().alias("allowed"), denied.alias("denied_by"))


def release_text(text: Column, most: int = 16384) -> Column:
    return T.truncate_bytes(T.redact_log(text), most)


def hidden(value, key: str = ""):
    """A parsed JSON value as it may go out, under a key in lower case. What a path holds is hidden whatever it is; path lists keep their length, and anything else in their place counts as a list of one; texts are hidden where they stand under their key. Lists inside lists are gone through as well."""
    if key == "path":
        return REDACTED
    if key in HIDDEN_LISTS:
        return [REDACTED] * (len(value) if isinstance(value, list) else 1)
    if isinstance(value, dict):
        return {k: hidden(v, k.lower()) for k, v in value.items()}
    if isinstance(value, list):
        return [hidden(v) for v in value]
    return REDACTED if key in HIDDEN_TEXT and isinstance(value, str) else value


def redact_json(payload: Column) -> Column:
    """Hides known keys at any depth of a JSON text; text that is no JSON becomes null. Depth is unknown, so this is a batched Python function."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(hidden(json.loads(text)), separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    @F.arrow_udf("string")
    def redacted(texts: pa.Array) -> pa.Array:
        return pa.array([one(t) for t in texts.to_pylist()], pa.string())

    return redacted(payload)


def errors_of(rules: list[tuple[Column, str]]) -> Column:
    """The messages of rules that are broken; a rule that can't be told is broken."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(message)) for ok, message in rules)))


def inspection_errors() -> Column:
    """For rows evidence_ids, refs, result, retrieval, reranking, synthesis, attempts."""
    tiers = F.transform("attempts", lambda a: chain([(a.startswith("p40"), 1), (a.startswith("v100"), 2), (a.startswith("a100"), 3)], 9))
    rules = [
        (F.size("evidence_ids") <= 12, "evidence_limit"),
        (F.size("evidence_ids") == F.size(F.array_distinct("evidence_ids")), "evidence_ids_unique"),
        (F.size(F.array_except("refs", "evidence_ids")) == 0, "unknown_evidence_ref"),
        (F.col("result").isin("answer_ready", "evidence_only", "failed"), "result_state"),
        ((F.col("result") != "answer_ready") | (F.array_min(F.array("retrieval", "reranking", "synthesis")) == "gpu") & (F.array_max(F.array("retrieval", "reranking", "synthesis")) == "gpu"), "answer_needs_gpu"),
        (tiers == F.array_sort(tiers), "attempt_order"),
    ]
    return errors_of(rules)


def request_errors() -> Column:
    """For rows task_type, mode, final_pack_budget, runtime_s, params."""
    tasks = ["rag_compress", "debug_with_local_context", "summarize_logs", "propose_patch", "inspect_repo", "document_summary", "log_analysis", "repo_summary"]
    least = F.when(F.col("mode") == "answer", 4096).otherwise(2048)
    rules = [(F.col("task_type").isin(*tasks), "task_type"), (F.col("mode").isin("auto", "evidence", "answer"), "mode"), ((F.col("final_pack_budget") == 0) | (F.col("final_pack_budget") >= least), "final_pack_budget"), (F.col("runtime_s").between(0, 86400), "runtime"), (~F.exists("params", lambda p: p.startswith("_")), "reserved_key")]
    return errors_of(rules)


def event_json(events: DataFrame) -> Column:
    """An event as compact JSON without its hashes: keys in a fixed order, empty ones left out, the keys of fields (a map, where there is one) sorted, and <, >, & and the two line separators escaped."""
    given = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    parts = [F.col("at").cast("string").alias("timestamp"), given("actor"), given("role"), F.coalesce("action", F.lit("")).alias("action"), F.coalesce("outcome", F.lit("")).alias("outcome")]
    parts += [given(c) for c in ("job_id", "task_type") if c in events.columns]
    if "fields" in events.columns:
        parts.append(F.when(F.size("fields") > 0, F.map_from_entries(F.array_sort(F.map_entries("fields")))).alias("fields"))
    text = F.to_json(F.struct(*parts))
    for letter in "<>&\u2028\u2029":
        text = F.replace(text, F.lit(letter), F.lit(f"\\u{ord(letter):04x}"))
    return text


def chained(events: DataFrame, chain_id: str, order: str, seed: str | Column = "") -> DataFrame:
    """Adds prev_hash and event_hash: the SHA-256 of an event's JSON with the hash before it. Each hash needs the one before, so a chain streams through one task, and only its hash is held. seed: the hash before a chain's first event, for all or by a Column."""

    def step(last: str | None, body: str, begin: str) -> tuple:
        last = begin if last is None else last
        said = body[:-1] + (f',"prev_hash":"{last}"' if last else "") + "}"
        now = hashlib.sha256(said.encode()).hexdigest()
        return now, (last, now)

    rows = events.withColumn("_body", event_json(events)).withColumn("_seed", F.lit(seed) if isinstance(seed, str) else seed)
    return in_order(rows, chain_id, [order], ["_body", "_seed"], {"prev_hash": ("string", pa.string()), "event_hash": ("string", pa.string())}, lambda: None, step).drop("_body", "_seed")


def verify(events: DataFrame, chain_id: str, order: str, seed: str | Column = "") -> DataFrame:
    """By chain: events, whether it holds, and the first line that fails and why. Each line is checked against the line before, so chains split over tasks by their key only."""
    w = Window.partitionBy(chain_id).orderBy(order)
    rows = events.withColumn("line", F.row_number().over(w)).withColumn("_before", F.coalesce(F.lag("event_hash").over(w), F.lit(seed) if isinstance(seed, str) else seed))
    before = F.when(F.col("prev_hash") != "", F.concat(F.lit(',"prev_hash":"'), "prev_hash", F.lit('"'))).otherwise("")
    said = F.concat(F.regexp_replace(event_json(events), "\\}$", ""), before, F.lit("}"))
    reason = chain([(F.col("prev_hash") != F.col("_before"), "prev_hash mismatch"), (F.col("event_hash") != F.sha2(said, 256), "event_hash mismatch")], F.lit(None).cast("string"))
    rows = rows.withColumn("reason", reason)
    first = F.min(F.when(F.col("reason").isNotNull(), F.struct("line", "reason")))
    out = rows.groupBy(chain_id).agg(F.count(F.lit(1)).alias("events"), first.alias("f"))
    return out.select(chain_id, "events", F.col("f").isNull().alias("valid"), F.col("f.line").alias("failure_line"), F.col("f.reason").alias("reason"))


def retained(archives: DataFrame, keep: int, name: str = "name") -> DataFrame:
    """The newest archives by name, which is a date."""
    return archives.orderBy(F.desc(name)).limit(keep)


def allowed_diagnostics(rows: DataFrame, keys: list[str], most: int = 8) -> DataFrame:
    """rows (job_id, key, value, n): known keys only, most attempts a job."""
    return rows.where(F.col("key").isin(*keys)).withColumn("_n", F.row_number().over(Window.partitionBy("job_id", "key").orderBy("n"))).where(F.col("_n") <= most).drop("_n")
