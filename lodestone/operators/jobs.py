"""Job analytics: effective attempts, root status, retries, release slots, quotas, caches, demands and services, placement.

jobs: job_id, root_job_id, task_type, strategy, shard_key, shard_index, shard_count, aggregation_key, state, created_at,
updated_at, run_id, error, cache_key, chunk, owner. Missing columns matter only to the operators that name them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.classes import TERMINAL_STATES, chain, is_retryable, is_terminal, retry_skip_reason
from lodestone.sources.scratch import Scratch

SHARD = ["task_type", "strategy", "shard_key", "shard_index", "shard_count", "aggregation_key"]
REDUCER = ["task_type", "strategy", "aggregation_key"]


def recent_first() -> list[Column]:
    return [F.desc("created_at"), F.desc("updated_at"), F.desc("job_id")]


def attempt_class(state: Column, with_cancelled: bool = False) -> Column:
    """Open before succeeded before retryable or cancelled before the rest."""
    return chain([(~is_terminal(state), 0), (state == "succeeded", 1), (is_retryable(state, with_cancelled) | (state == "cancelled"), 2)], 3)


def effective(jobs: DataFrame, keys: list[str], with_cancelled: bool = False) -> DataFrame:
    """The attempt that stands for each key of a root: by class, then the newest. An aggregate, not a sort, so a key with many attempts is combined before the shuffle."""
    order = F.struct((-attempt_class(F.col("state"), with_cancelled)).alias("c"), "created_at", "updated_at", "job_id")
    best = jobs.groupBy("root_job_id", *keys).agg(F.max_by(F.struct(*(c for c in jobs.columns if c not in ("root_job_id", *keys))), order).alias("j"))
    return best.select("root_job_id", *keys, "j.*")


def split_reducers(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    reducer = F.coalesce(F.col("strategy") == "aggregator", F.lit(False))
    return jobs.where(~reducer), jobs.where(reducer)


def root_state(reducer: Column, running: Column, failed: Column, queued: Column, cancelled: Column, succeeded: Column, total: Column) -> Column:
    return chain([(reducer.isNotNull(), reducer), (running > 0, "running"), (failed > 0, "failed"), (queued > 0, "queued"), (cancelled == total, "cancelled"), (succeeded == total, "succeeded")], "queued")


def root_status(jobs: DataFrame) -> DataFrame:
    """One row a root, from its effective shards and its reducer."""
    shards, reducers = split_reducers(jobs)
    children = effective(shards, SHARD).withColumn("is_reducer", F.lit(False))
    last = effective(reducers, REDUCER).groupBy("root_job_id").agg(F.max_by(F.struct("job_id", "state", "run_id", "error", "aggregation_key"), F.struct("created_at", "job_id")).alias("r"))
    reducer = last.select("root_job_id", F.col("r.job_id").alias("job_id"), F.col("r.state").alias("state"), F.col("r.run_id").alias("run_id"), F.col("r.error").alias("error"), F.col("r.aggregation_key").alias("aggregation_key"), F.lit(True).alias("is_reducer"))
    rows = children.select(*reducer.columns).unionByName(reducer)
    n = lambda *states: F.count_if(F.col("state").isin(*states))
    out = rows.groupBy("root_job_id").agg(
        F.count(F.lit(1)).alias("total_jobs"),
        n("accepted", "queued", "dispatching").alias("queued_jobs"),
        n("running").alias("running_jobs"),
        n("succeeded").alias("succeeded_jobs"),
        n("failed", "preempted", "timed_out").alias("failed_jobs"),
        n("cancelled").alias("cancelled_jobs"),
        F.array_join(F.array_sort(F.collect_list(F.when(~F.col("is_reducer"), F.col("job_id")))), ",").alias("child_job_ids"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("aggregation_key") != "", F.col("aggregation_key")))), ",").alias("aggregation_keys"),
        F.min_by("error", F.when(F.col("error") != "", F.struct("is_reducer", "job_id"))).alias("representative_error"),
        F.max(F.when(F.col("is_reducer"), F.col("job_id"))).alias("reducer_job_id"),
        F.max(F.when(F.col("is_reducer"), F.col("state"))).alias("reducer_state"),
        F.coalesce(F.bool_or(F.col("is_reducer") & (F.col("state") == "dispatching") & (F.col("run_id") == "")), F.lit(False)).alias("reducer_deferred"),
    )
    return out.withColumn("state", root_state(*(F.col(c) for c in ("reducer_state", "running_jobs", "failed_jobs", "queued_jobs", "cancelled_jobs", "succeeded_jobs", "total_jobs"))))


def newest_progress(beats: DataFrame) -> DataFrame:
    """beats (job_id, last_updated, ts, phase, percent) -> the newest of each job, by last_updated or else its time; of equal times the largest percent."""
    at = F.coalesce("last_updated", "ts")
    rows = beats.withColumn("progress_at", at).where(F.col("progress_at").isNotNull())
    best = rows.groupBy("job_id").agg(F.max(F.struct("progress_at", "percent", "phase")).alias("p"))
    return best.select("job_id", "p.progress_at", "p.percent", "p.phase")


def root_progress(jobs: DataFrame, beats: DataFrame) -> DataFrame:
    """By root the newest progress among its effective shards and its reducers, and how many of these have any."""
    shards, reducers = split_reducers(jobs)
    members = effective(shards, SHARD).select("root_job_id", "job_id").unionByName(effective(reducers, REDUCER).select("root_job_id", "job_id"))
    rows = members.join(newest_progress(beats), "job_id", "left")
    best = rows.groupBy("root_job_id").agg(F.max(F.when(F.col("progress_at").isNotNull(), F.struct("progress_at", "percent", "phase", "job_id"))).alias("p"), F.count("progress_at").alias("reporting"), F.count(F.lit(1)).alias("members"))
    return best.select("root_job_id", "members", "reporting", "p.progress_at", "p.percent", "p.phase", F.col("p.job_id").alias("progress_job_id"))


def children_of(jobs: DataFrame) -> DataFrame:
    """(root_job_id, place, job_id): the effective shards of a root as rows, in order, where root_status has them in one text."""
    rows = effective(split_reducers(jobs)[0], SHARD)
    return rows.select("root_job_id", F.row_number().over(Window.partitionBy("root_job_id").orderBy("job_id")).alias("place"), "job_id")


def retry_set(jobs: DataFrame, with_cancelled: bool = False) -> DataFrame:
    """Effective shards: to retry, or why not."""
    rows = effective(split_reducers(jobs)[0], SHARD, with_cancelled)
    retry = is_retryable(F.col("state"), with_cancelled)
    return rows.select("root_job_id", "job_id", "state", retry.alias("retry"), F.when(~retry, retry_skip_reason(F.col("state"), with_cancelled)).alias("skip_reason"))


def dispatch_counts(jobs: DataFrame) -> DataFrame:
    """By root: shards being dispatched, not yet submitted, and their chunks."""
    pending = (F.col("state") == "dispatching") & (F.col("run_id") == "")
    active = (F.col("run_id") != "") & ~is_terminal(F.col("state"))
    return jobs.groupBy("root_job_id").agg(F.count_if(F.col("state") == "dispatching").alias("dispatching"), F.count_if(pending).alias("pending"), F.count_distinct(F.when(active, F.col("chunk"))).alias("active_chunks"), F.count_distinct(F.when(pending, F.col("chunk"))).alias("pending_chunks"))


def release_slots(jobs: DataFrame, max_active: int = 0, extra: int = 0) -> DataFrame:
    """Pending chunks in order that a root may release: max_active less what is active, extra where given, all where unlimited."""
    pending = jobs.where("state = 'dispatching' AND run_id = ''").groupBy("root_job_id", "chunk").agg(F.count(F.lit(1)).alias("jobs"))
    active = dispatch_counts(jobs).select("root_job_id", "active_chunks")
    slots = F.lit(extra) if extra > 0 else F.greatest(F.lit(0), F.lit(max_active) - F.col("active_chunks")) if max_active > 0 else F.lit(1 << 30)
    turn = F.row_number().over(Window.partitionBy("root_job_id").orderBy("chunk"))
    return pending.withColumn("turn", turn).join(active, "root_job_id").where(F.col("turn") <= slots).select("root_job_id", "chunk", "jobs", "turn")


def release_set(jobs: DataFrame, max_active: int = 0, extra: int = 0) -> DataFrame:
    """(root_job_id, job_id, chunk, is_reducer): what a root may submit now. Deferred shards of the chunks in release_slots; deferred reducers only of roots that have no deferred shard left."""
    shards, reducers = split_reducers(jobs)
    deferred = (F.col("state") == "dispatching") & (F.col("run_id") == "")
    waiting = shards.where(deferred)
    chunks = release_slots(shards, max_active, extra).select("root_job_id", "chunk")
    now = waiting.join(chunks, ["root_job_id", "chunk"], "left_semi").select("root_job_id", "job_id", "chunk", F.lit(False).alias("is_reducer"))
    last = reducers.where(deferred).join(waiting.select("root_job_id").distinct(), "root_job_id", "left_anti")
    return now.unionByName(last.select("root_job_id", "job_id", "chunk", F.lit(True).alias("is_reducer")))


def chunk_of_batch(jobs: DataFrame, size: int = 64) -> DataFrame:
    """Adds batch: size jobs of a root at a time, in order."""
    return jobs.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("root_job_id").orderBy("shard_index", "job_id")) - 1) / size).cast("int"))


def quota(requests: DataFrame, limit: int) -> DataFrame:
    """requests (root_job_id, role, existing, requested): admins pass and have no limit, others pass while the sum fits."""
    admin = F.col("role") == "admin"
    fits = admin | ((F.col("requested") <= limit) & (F.col("existing") + F.col("requested") <= limit))
    return requests.withColumn("allowed", fits).withColumn("remaining", F.when(admin, 0).otherwise(F.greatest(F.lit(0), F.lit(limit) - F.col("existing"))))


def reducer_waits(jobs: DataFrame) -> DataFrame:
    shards, _ = split_reducers(jobs)
    return shards.groupBy("root_job_id").agg(F.bool_or((F.col("state") == "dispatching") & (F.col("run_id") == "")).alias("deferred"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("run_id") != "", F.col("run_id")))), ",").alias("dependencies"))


def latest_cached(jobs: DataFrame) -> DataFrame:
    """The newest job with a result for each cache key."""
    rows = jobs.where("cache_key <> '' AND state = 'succeeded' AND has_result")
    return rows.groupBy("cache_key").agg(F.max_by("job_id", F.struct("created_at", "updated_at", "job_id")).alias("job_id"), F.count(F.lit(1)).alias("candidates"))


def in_flight(jobs: DataFrame) -> DataFrame:
    """The newest open job that is no alias itself, for each task and cache key."""
    rows = jobs.where(~is_terminal(F.col("state")) & (F.col("cache_key") != "") & F.col("alias_of").isNull())
    return rows.groupBy("task_type", "cache_key").agg(F.max_by("job_id", F.struct("created_at", "job_id")).alias("job_id"))


def cache_lookup(requests: DataFrame, cached: DataFrame, jobs: DataFrame) -> DataFrame:
    """requests (request_id, cache_key, owner, role) -> uncacheable, miss or hit; a hit that the owner may not see is a miss."""
    found = requests.join(cached.select("cache_key", "job_id"), "cache_key", "left").join(jobs.select("job_id", F.col("owner").alias("job_owner")), "job_id", "left")
    status = chain([(F.coalesce("cache_key", F.lit("")) == "", "uncacheable"), (F.col("job_id").isNull(), "miss"), (~accessible(F.col("role"), F.col("owner"), F.col("job_owner")), "miss")], "hit")
    return found.withColumn("status", status).select("request_id", "cache_key", "status", F.when(F.col("status") == "hit", F.col("job_id")).alias("job_id"))


def accessible(role: Column, user: Column, owner: Column) -> Column:
    """Admins, rows without an owner, and the owner's own."""
    return (role == "admin") | (F.coalesce(F.trim(owner), F.lit("")) == "") | (owner == user)


def authorized(jobs: DataFrame, user: str, role: str) -> DataFrame:
    return jobs.where(accessible(F.lit(role), F.lit(user), F.col("owner")))


def forbidden_roots(jobs: DataFrame, user: str, role: str) -> DataFrame:
    """A root is open only if all its jobs are."""
    return jobs.groupBy("root_job_id").agg(F.bool_and(accessible(F.lit(role), F.lit(user), F.col("owner"))).alias("accessible"))


def origins(links: DataFrame) -> DataFrame:
    """links (job_id, source_id or null) -> the job at the end of each alias chain, by pointer doubling until nothing moves: chains of n links take log2(n) turns. Each turn is written, so no plan grows. A source that is no job of the table ends the chain before it; a cycle has no end, and its jobs get null."""
    scratch = Scratch(links.sparkSession, "origins")
    known = links.select(F.col("job_id").alias("_j")).distinct()
    rows = links.join(known, links["source_id"] == known["_j"], "left").select("job_id", F.coalesce("_j", "job_id").alias("origin"))
    begun = rows = scratch.write(rows, "turn0")
    ends = begun.where("job_id = origin").select(F.col("job_id").alias("_end")).distinct()
    for turn in range(1, links.count().bit_length() + 2):
        to = rows.select(F.col("job_id").alias("_at"), F.col("origin").alias("_to"))
        moved = rows.join(to, rows["origin"] == to["_at"]).select("job_id", F.col("_to").alias("origin"), (F.col("_to") != F.col("origin")).alias("moved"))
        moved = scratch.write(moved, f"turn{turn}")
        rows = moved.select("job_id", "origin")
        if turn > 1:
            scratch.drop(f"turn{turn - 1}")
        if not moved.where("moved").count():
            break
    return rows.join(ends, rows["origin"] == ends["_end"], "left").select("job_id", F.col("_end").alias("origin"))


def execution_quality(task: Column, schema: Column, quality: Column, degraded: Column, retry: Column, real: Column) -> Column:
    own = F.when(quality.isin("answer_ready", "evidence_only"), quality).otherwise("failed")
    return chain([((task == "inspect_repo") & (schema == "repo_inspection_v2"), own), (degraded & retry, "no_real_backend"), (degraded, "degraded_local"), (real, "real_local")], "no_real_backend")


def reusable_result(task: Column, mode: Column, quality: Column, gpu: Column, findings: Column) -> Column:
    """Whether a finished result may answer again."""
    m = F.lower(F.trim(mode))
    return chain([(task != "inspect_repo", True), (m == "evidence", quality == "evidence_only"), (m == "answer", (quality == "answer_ready") & gpu & (findings > 0))], False)


def with_defaults(jobs: DataFrame) -> DataFrame:
    """Root and strategy where they are blank."""
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return jobs.withColumn("root_job_id", F.coalesce(blank("root_job_id"), blank("parent_job_id"), F.col("job_id"))).withColumn("strategy", F.coalesce(blank("strategy"), F.when(blank("parent_job_id").isNotNull(), "fanout_child").otherwise("standalone")))


def transitions(events: DataFrame) -> DataFrame:
    """events (job_id, state, at): the newest state, when it first ran, when it ended."""
    terminal = is_terminal(F.col("state"))
    rows = events.groupBy("job_id").agg(F.max_by("state", F.struct("at", "state")).alias("state"), F.min(F.when(F.col("state") == "running", F.col("at"))).alias("started_at"), F.min(F.when(terminal, F.col("at"))).alias("completed_at"))
    return rows.withColumn("completed_at", F.when(F.col("state").isin(*TERMINAL_STATES), F.col("completed_at")))


# services and demands


def routable(services: DataFrame, now: Column, heartbeat_s: int = 45) -> DataFrame:
    fresh = F.col("heartbeat_at") >= now - F.expr(f"INTERVAL {heartbeat_s} SECONDS")
    return services.where((F.col("state") == "ready") & (F.col("endpoint") != "") & (effective_lease() > now) & fresh)


def effective_lease() -> Column:
    return F.least("lease_expires_at", "absolute_lease_expires_at")


def retirement_reason(now: Column, tiers: list[str], heartbeat_s: int = 45) -> Column:
    """Why a service goes, by the first check that fails; null while it stays."""
    stale = F.col("heartbeat_at").isNull() | (F.col("heartbeat_at") < now - F.expr(f"INTERVAL {heartbeat_s} SECONDS"))
    starting = F.col("state") == "starting"
    rules = [(~F.col("tier").isin(*tiers), "profile_removed"), (is_terminal(F.col("scheduler_state")), "terminal"), (starting & (F.col("startup_deadline") <= now), "startup_timeout"), (starting, F.lit(None).cast("string")), (effective_lease() <= now, "lease_expired"), (stale, "heartbeat_lost"), (F.col("endpoint") == "", "endpoint_unhealthy")]
    return chain(rules, F.lit(None).cast("string"))


def bind(demands: DataFrame, services: DataFrame) -> DataFrame:
    """The service for each demand of its tier: ready before starting, the latest lease first; none means launch."""
    best = services.groupBy("tier").agg(F.max_by(F.struct("service_id", "state"), F.struct((F.col("state") == "ready").alias("r"), "lease_expires_at", "service_id")).alias("s"))
    rows = demands.join(best, "tier", "left")
    return rows.select("demand_id", "tier", F.col("s.service_id").alias("service_id"), chain([(F.col("s").isNull(), "launch"), (F.col("s.state") == "ready", "bind")], "wait").alias("action"))


def live_demands(demands: DataFrame, now: Column) -> DataFrame:
    """One live demand a tier, the oldest; ended and overdue ones are left out."""
    live = demands.where(~F.col("state").isin("failed", "satisfied", "expired") & (F.col("deadline") > now))
    return live.groupBy("tier").agg(F.min_by("demand_id", F.struct("created_at", "demand_id")).alias("demand_id"), F.count(F.lit(1)).alias("coalesced"))


def surplus(services: DataFrame, most: int) -> DataFrame:
    """Services of a tier beyond the oldest most."""
    return services.withColumn("place", F.row_number().over(Window.partitionBy("tier").orderBy("created_at", "service_id"))).where(F.col("place") > most)


def tier_roll_up(services: DataFrame) -> DataFrame:
    return services.groupBy("tier").agg(F.count_if(F.col("state") == "ready").alias("active"), F.count_if(F.col("state") == "starting").alias("starting"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("endpoint") != "", F.col("endpoint")))), ",").alias("endpoints"))


# placement


def available(state: Column) -> Column:
    return F.contains(F.lower(state), F.lit("idle")) | F.contains(F.lower(state), F.lit("mix"))


def expand_hosts(lists: DataFrame, column: str) -> DataFrame:
    """prefix[1-3,7]suffix -> a row for each host; other names stay. Commas outside brackets separate names."""
    named = lists.withColumn("_part", F.explode(F.split(F.col(column), ",(?![^\\[]*\\])")))
    inside = F.regexp_extract("_part", "\\[([^\\]]*)\\]", 1)
    rows = named.withColumn("_range", F.explode(F.split(inside, ",")))
    low, high = F.regexp_extract("_range", "^(\\d+)", 1), F.regexp_extract("_range", "-(\\d+)$", 1)
    rows = rows.withColumn("_low", low).withColumn("_high", F.when(high == "", low).otherwise(high))
    rows = rows.withColumn("_n", F.explode(F.when(F.col("_low") == "", F.array(F.lit(0))).otherwise(F.sequence(F.col("_low").try_cast("int"), F.col("_high").try_cast("int")))))
    number = F.lpad(F.col("_n").cast("string"), F.greatest(F.length("_low"), F.length(F.col("_n").cast("string"))), F.lit("0"))
    host = F.when(inside == "", F.col("_part")).otherwise(F.concat(F.regexp_extract("_part", "^([^\\[]*)\\[", 1), number, F.regexp_extract("_part", "\\]([^\\]]*)$", 1)))
    return rows.withColumn("host", host).drop("_part", "_range", "_low", "_high", "_n")


def queue_on_nodes(queue: DataFrame, nodes: DataFrame) -> DataFrame:
    """queue (job_id, partition, state, nodes as a host list) -> (job_id, partition, state, node): each job once, with one node of its partition that is up and that its list names, or null. Lists of many hosts are expanded where they are and meet the nodes by a join."""
    listed = queue.where(~F.coalesce(F.trim("nodes"), F.lit("")).isin("", "n/a", "(null)"))
    hosts = expand_hosts(listed.select("job_id", "partition", F.trim("nodes").alias("nodes")), "nodes").select("job_id", "partition", F.trim("host").alias("node"))
    up = nodes.where(available(F.col("state"))).select("partition", "node").distinct()
    named = hosts.join(up, ["partition", "node"]).groupBy("job_id").agg(F.min("node").alias("node"))
    return queue.select("job_id", "partition", "state").join(named, "job_id", "left")


def placement(nodes: DataFrame, queue: DataFrame) -> DataFrame:
    """nodes (partition, node, state), queue (partition, state, node): by partition 100 idle + 25 mixed - 10 pending - 5 running on matching nodes."""
    up = nodes.where(available(F.col("state")))
    idle = F.contains(F.lower("state"), F.lit("idle"))
    have = up.groupBy("partition").agg(F.count_if(idle).alias("idle"), F.count_if(~idle).alias("mix"))
    touching = queue.join(up.select(F.col("partition").alias("_p"), F.col("node").alias("_n")).distinct(), (F.col("partition") == F.col("_p")) & (F.col("node") == F.col("_n")), "left")
    load = touching.groupBy("partition").agg(F.count_if(F.contains("state", F.lit("pending"))).alias("pending"), F.count_if(F.contains("state", F.lit("running")) & F.col("_n").isNotNull()).alias("running"))
    rows = have.join(load, "partition", "left").na.fill(0, ["pending", "running"])
    return rows.withColumn("score", F.col("idle") * 100 + F.col("mix") * 25 - F.col("pending") * 10 - F.col("running") * 5)


def of_root(jobs: DataFrame, root: Column) -> DataFrame:
    return jobs.where(F.col("root_job_id") == root)


def listed(jobs: DataFrame) -> DataFrame:
    """Jobs as a list shows them: by when they came, then by id."""
    return jobs.withColumn("place", F.row_number().over(Window.partitionBy("root_job_id").orderBy("created_at", "job_id")))


def constraint_matches(constraint: Column, features: Column) -> Column:
    """Any word of a constraint is part of a node's features; a blank constraint fits all."""
    words = F.filter(F.transform(F.split(F.lower(constraint), "[&|,()]"), lambda w: F.trim(w)), lambda w: w != "")
    return (F.trim(constraint) == "") | F.exists(words, lambda w: F.contains(F.lower(features), w))


def gres_matches(gres: Column, accelerator: Column) -> Column:
    """A node's resources name the accelerator as a GPU type."""
    have, want = F.lower(F.trim(gres)), F.concat(F.lit("gpu:"), F.lower(F.trim(accelerator)))
    named = F.endswith(have, want) | F.contains(have, F.concat(want, F.lit(":"))) | F.contains(have, F.concat(want, F.lit("("))) | F.contains(have, F.concat(want, F.lit(",")))
    return (have != "") & (F.trim(accelerator) != "") & named


def best_tier(candidates: DataFrame, group: str) -> DataFrame:
    """candidates (group, place, tier, score or null) -> the tier of the highest score, the first of equal ones; the first tier where none has a score."""
    best = F.max(F.when(F.col("score").isNotNull(), F.struct("score", (-F.col("place")).alias("first"), "tier")))
    return candidates.groupBy(group).agg(best.alias("b"), F.min_by("tier", "place").alias("own")).select(group, F.coalesce("b.tier", "own").alias("tier"))


def action_usage(actions: DataFrame) -> DataFrame:
    """By root: retries, and the distinct chunks that were forced."""
    return actions.groupBy("root_job_id").agg(F.count_if(F.col("action") == "retry").alias("retries"), F.count_distinct(F.when(F.col("action") == "force", F.col("chunk"))).alias("forced_chunks"))


def allowed_artifacts(artifacts: Column, types: list[str]) -> Column:
    """Of an array of structs those of allowed types."""
    return F.filter(artifacts, lambda a: a["artifact_type"].isin(*types))


def artifact_owner(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """requests (request_id, artifact_id, user, role), jobs (job_id, owner, created_at, artifacts: array<struct<artifact_id, path>>) -> the newest job with the artifact that the user may see, and its path; null where there is none."""
    held = jobs.select("owner", "created_at", "job_id", F.explode("artifacts").alias("a")).select("owner", F.col("a.artifact_id").alias("artifact_id"), F.struct("created_at", "job_id", F.col("a.path").alias("path")).alias("j"))
    # The newest holder of an artifact for each owner, and of these for all, so that a request meets one row of each and never all holders.
    by_owner = held.where("artifact_id IS NOT NULL").groupBy("artifact_id", "owner").agg(F.max("j").alias("own"))
    free = accessible(F.lit(""), F.lit(None).cast("string"), F.col("owner"))
    by_artifact = by_owner.groupBy("artifact_id").agg(F.max("own").alias("any"), F.max(F.when(free, F.col("own"))).alias("free"))
    asked = requests.join(by_artifact, "artifact_id", "left").join(by_owner.withColumnRenamed("owner", "user"), ["artifact_id", "user"], "left")
    newest = F.when(F.col("role") == "admin", F.col("any")).otherwise(F.greatest("free", "own"))
    return asked.withColumn("j", newest).select("request_id", "artifact_id", "j.job_id", "j.path")


def live_records(services: DataFrame, tier: Column) -> DataFrame:
    return services.where((F.col("tier") == tier) & F.col("state").isin("starting", "ready"))


def reducer_requests(roots: DataFrame, children: DataFrame) -> DataFrame:
    """roots (root_job_id, task_type, priority or null), children (root_job_id, job_id, shard_index, task_type, priority): the reducer's request, with what the root doesn't say taken from its first child, and the child ids in order."""
    ids = children.groupBy("root_job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("shard_index", "job_id"))), lambda x: x["job_id"]).alias("child_ids"), F.min_by(F.struct("task_type", "priority"), F.struct("shard_index", "job_id")).alias("first"))
    return roots.join(ids, "root_job_id").select("root_job_id", F.coalesce("task_type", "first.task_type").alias("task_type"), F.coalesce("priority", "first.priority").alias("priority"), "child_ids")
