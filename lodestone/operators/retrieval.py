"""Retrieval strategies, each a pair of Columns (score, reasons), their top rows, merge, rerank and policy signals."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.classes import CODE_KINDS, ERROR_KINDS, chain, hits_directory
from lodestone.operators.chunking import fixed_windows
from lodestone.sources.scratch import Scratch

TOP, MOST_CANDIDATES = 24, 48
DEBUG = r"trace|panic|error|fail"


@dataclass
class Query:
    """What a task asks."""

    text: str
    task: str = "rag_compress"
    suspects: list[str] = field(default_factory=list)
    failing_tests: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)

    @property
    def terms(self) -> list[str]:
        extra = {"debug_with_local_context": self.failing_tests + self.suspects, "inspect_repo": self.paths}.get(self.task, [])
        return T.query_terms(self.text, extra)


Scorer = Callable[[Query], tuple[Column, Column]]
#: name -> (scorer, how real its backend is); foreign scorers register here. Scorers read the columns of chunks, and _lowered.
STRATEGIES: dict[str, tuple[Scorer, str]] = {}


def strategy(name: str, mode: str) -> Callable[[Scorer], Scorer]:
    def add(f: Scorer) -> Scorer:
        STRATEGIES[name] = (f, mode)
        return f

    return add


def total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def reasons(*pairs: tuple[Column, str]) -> Column:
    """The names whose test holds."""
    return F.array_compact(F.array(*(F.when(test, F.lit(name)) for test, name in pairs)))


def _content() -> Column:
    return F.lower("content")


def _lowered() -> Column:
    """The chunk's content in lower case, worked out once for all scorers: see candidates()."""
    return F.col("_lowered")


def alone(words: str) -> str:
    """A pattern for words with no ASCII word character beside them; Java's \\b would take letters beyond ASCII for one, too."""
    return rf"(?<![0-9A-Za-z_])({words})(?![0-9A-Za-z_])"


def log_signal(text: Column) -> Column:
    """2.5 for each known failure text, 2 if a failure word stands alone."""
    return total([F.when(F.contains(text, F.lit(n)), 2.5).otherwise(0.0) for n, _ in ERROR_KINDS]) + F.when(text.rlike(alone("test|fail|panic|exception|traceback")), 2.0).otherwise(0.0)


def code_signal(text: Column) -> Column:
    return total([F.when(F.contains(text, F.lit(n)), 1.5).otherwise(0.0) for n, _ in CODE_KINDS]) + F.when(T.any_contained(text, ["todo", "fixme"]), 0.5).otherwise(0.0)


def overlap(text: Column, terms: list[str]) -> Column:
    return T.times_contained(text, terms) * 0.6


@strategy("bm25", "real")
def substring(q: Query) -> tuple[Column, Column]:
    """2 for each term of the query, repeats again, that the chunk contains; logs add their failure signal."""
    found = T.times_contained(_lowered(), q.terms)
    logs = (F.col("input_type") == "log") if q.task in ("summarize_logs", "debug_with_local_context") else F.lit(False)
    return found * 2.0 + F.when(logs, log_signal(_lowered())).otherwise(0.0), reasons((found > 0, "term_in_text"), (logs, "log_signal"))


# Weights of directories and files near a repository's root.
IMPORTANT_DIRS = {"cmd": 1.8, "app": 1.6, "apps": 1.6, "broker": 2.0, "config": 1.2, "configs": 1.2, "deploy": 1.2, "internal": 1.8, "pkg": 1.8, "scripts": 1.0, "src": 1.6, "tests": 1.0, "worker": 1.6, "workers": 1.6}
IMPORTANT_FILES = {"go.mod": 2.5, "package.json": 2.2, "pyproject.toml": 2.2, "cargo.toml": 2.2, "readme.md": 1.6, "main.go": 2.2, "main.py": 2.2, "app.py": 2.0, "server.go": 2.0, "server.py": 2.0, "index.ts": 1.8, "index.js": 1.8}


@strategy("repo_structure", "real")
def repo_structure(q: Query) -> tuple[Column, Column]:
    path = F.lower("path")
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    dirs, name = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.coalesce(F.try_element_at(parts, F.lit(-1)), path)
    dir_weight = F.aggregate(dirs, F.lit(0.0), lambda a, d: a + chain([(d == k, v) for k, v in IMPORTANT_DIRS.items()], 0.0))
    file_weight = chain([(name == k, v) for k, v in IMPORTANT_FILES.items()], 0.0)
    near, shallow = F.size(parts) <= 2, F.size(parts) == 3
    entry, defines = F.col("line_start") == 1, F.col("content").rlike(alone("func|class|def|type|interface|struct"))
    symbol = T.detect_symbol(T.lines(F.col("content"))) != ""
    in_path = T.times_contained(path, q.terms)
    weight = lambda test, w: F.when(test, w).otherwise(0.0)
    score = 1.0 + weight(near, 2.2) + weight(shallow, 1.4) + dir_weight + file_weight + weight(entry, 0.6) + weight(defines, 0.6) + weight(symbol, 0.8) + in_path * 2.0
    why = reasons((F.lit(True), "repo_structure_scan"), (near, "near_repo_root"), (shallow, "shallow_repo_path"), (dir_weight > 0, "important_dir"), (file_weight > 0, "important_file"), (entry, "file_entry_chunk"), (defines, "definition_chunk"), (symbol, "symbol_detected"), (in_path > 0, "query_path_overlap"))
    fits = F.col("input_type").isin("repo", "file") & F.lit(q.task == "inspect_repo")
    return F.when(fits, score).otherwise(0.0), F.when(fits, why).otherwise(F.array().cast("array<string>"))


def grepped_chunks(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Chunks with hits_here, the line hits of the chunk, and hits_file, those of its document: lines that contain a term, once for each term and case-sensitive. They are counted once a line, in the document's own row, so nothing is shuffled."""
    return fixed_windows(docs, counts={"hits": lambda line: T.times_contained(line, terms)})


@strategy("ripgrep", "real")
def grep(q: Query) -> tuple[Column, Column]:
    """Needs the columns of grepped_chunks. Every hit in a file counts for all its chunks; without any, terms in the path count."""
    log, hits, here = F.col("input_type") == "log", F.col("hits_file"), F.col("hits_here")
    real = hits * 2.5 + here * 1.0 + F.when(log, F.least(hits, F.lit(3)) * 0.5).otherwise(0.0)
    in_path, in_log = T.times_contained(F.lower("path"), q.terms), F.when(log, T.times_contained(_lowered(), q.terms)).otherwise(0)
    why = F.when(hits > 0, reasons((F.lit(True), "rg_match"), (here > 0, "rg_line_in_chunk"), (log, "rg_log_density"))).otherwise(reasons((in_path > 0, "term_in_path"), (in_log > 0, "term_in_log_line")))
    return F.when(hits > 0, real).otherwise(in_path * 3.0 + in_log * 1.5), why


@strategy("tree_sitter", "fallback")
def code_structure(q: Query) -> tuple[Column, Column]:
    """Without tags, the code signal of the chunk."""
    fits = F.col("input_type").isin("repo", "file") & F.lit(q.task in ("inspect_repo", "rag_compress", "propose_patch"))
    score = F.when(fits, code_signal(_lowered())).otherwise(0.0)
    return score, reasons((score > 0, "code_structure_signal"))


def tagged(chunks: DataFrame, tags: DataFrame, terms: list[str]) -> DataFrame:
    """Scores of chunks by the declarations (path, line, name) on their lines: 2 each, 1 more for each term in the name. An equality on path with a range on the lines."""
    here = (chunks["path"] == tags["path"]) & tags["line"].between(chunks["line_start"], chunks["line_end"])
    rows = chunks.join(tags, here).select(chunks["chunk_id"], (2.0 + T.times_contained(F.lower(tags["name"]), terms) * 1.0).alias("score"))
    return rows.groupBy("chunk_id").agg(F.round(F.sum("score"), 3).alias("score"), F.count(F.lit(1)).alias("tags"))


@strategy("stack_trace_path", "heuristic")
def stack_trace(q: Query) -> tuple[Column, Column]:
    on = F.lit(q.task == "debug_with_local_context")
    trace, suspects = _lowered().rlike(DEBUG), T.times_contained(F.lower("path"), [s.lower() for s in q.suspects])
    score = F.when(on, F.when(trace, 1.5).otherwise(0.0) + suspects * 2.0).otherwise(0.0)
    return score, reasons((on & trace, "stack_trace_signal"), (on & (suspects > 0), "suspect_path_match"))


@strategy("git_diff_history", "heuristic")
def change_risk(q: Query) -> tuple[Column, Column]:
    hit = T.any_contained(_lowered(), ["todo", "fixme"]) & F.lit(q.task in ("debug_with_local_context", "propose_patch"))
    return F.when(hit, 0.75).otherwise(0.0), reasons((hit, "change_risk_marker"))


@strategy("embeddings", "heuristic")
def overlap_of_documents(q: Query) -> tuple[Column, Column]:
    score = F.when(F.col("input_type") == "document", overlap(_lowered(), q.terms)).otherwise(0.0)
    return score, reasons((score > 0, "semantic_overlap"))


@strategy("artifact_context", "heuristic")
def artifact(q: Query) -> tuple[Column, Column]:
    is_artifact = F.col("input_type") == "artifact"
    return F.when(is_artifact, 1.0).otherwise(0.0), reasons((is_artifact, "artifact_input"))


# What each task tries first.
DEFAULTS = {"summarize_logs": ["ripgrep", "bm25"], "inspect_repo": ["repo_structure", "tree_sitter", "ripgrep", "bm25"], "debug_with_local_context": ["stack_trace_path", "ripgrep", "git_diff_history"], "propose_patch": ["tree_sitter", "git_diff_history"]}


def default_strategies(task: str) -> list[str]:
    return DEFAULTS.get(task, ["ripgrep", "bm25", "tree_sitter"])


def available_strategies(task: str, types: set[str]) -> list[str]:
    out: list[str] = []
    if "log" in types:
        out += ["ripgrep", "bm25"] + ["stack_trace_path"] * (task == "debug_with_local_context")
    if types & {"repo", "file"}:
        out += ["repo_structure"] * (task == "inspect_repo") + ["ripgrep", "bm25", "tree_sitter"] + ["git_diff_history"] * (task in ("debug_with_local_context", "propose_patch"))
    out += ["embeddings"] * ("document" in types) + ["artifact_context"] * ("artifact" in types)
    return list(dict.fromkeys(out))


def plan(task: str, types: set[str], requested: list[str] | None = None) -> tuple[list[str], list[str]]:
    """(strategies to run, strategies left out)."""
    wanted, there = list(dict.fromkeys(requested or [])) or default_strategies(task), available_strategies(task, types)
    run = [s for s in wanted if s in there] or [s for s in default_strategies(task) if s in there]
    return run, [s for s in wanted if s not in there]


def candidates(chunks: DataFrame, q: Query, names: list[str], order: list[str], top: int = TOP) -> DataFrame:
    """The best chunks of each strategy, ties as the chunks came: (turn, strategy, rank, chunk_id, order, score, reasons). One scan scores for all strategies, and each task keeps top rows of each. Ids and keys only: contents join later."""

    def scored(turn: int, name: str) -> Column:
        score, why = STRATEGIES[name][0](q)
        return F.struct(F.lit(turn).alias("turn"), F.lit(name).alias("strategy"), F.round(score, 3).cast("double").alias("score"), why.alias("reasons"))

    rows = chunks.withColumn("_lowered", _content()).select("chunk_id", *order, F.explode(F.filter(F.array(*(scored(i, n) for i, n in enumerate(names))), lambda s: s["score"] > 0)).alias("_s")).select("chunk_id", *order, "_s.*")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("turn").orderBy(F.desc("score"), *order))).where(F.col("rank") <= top)


def candidates_of(chunks: DataFrame, q: Query, name: str, order: list[str], top: int = TOP) -> DataFrame:
    """The best chunks of one strategy."""
    return candidates(chunks, q, [name], order, top).drop("turn")


def merged(chunks: DataFrame, q: Query, names: list[str], order: list[str]) -> DataFrame:
    """Candidates of all strategies by chunk_id: scores add up, reasons and strategies in the order of strategies."""
    rows = candidates(chunks, q, names, order)
    by_turn = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("turn", "rank", c))), lambda x: x[c])
    return rows.groupBy("chunk_id").agg(
        F.round(F.sum("score"), 3).alias("score"),
        F.array_distinct(F.flatten(by_turn("reasons"))).alias("reasons"),
        F.array_distinct(by_turn("strategy")).alias("matched_strategies"),
        F.min(F.struct("turn", "rank")).alias("came"),
        F.min_by(F.struct(*order), F.struct("turn", "rank")).alias("at"),
    )


def executed(chunks: DataFrame, q: Query, types: set[str], order: list[str], requested: list[str] | None = None, budget: int = 64000) -> DataFrame:
    """The whole plan: the strategies that fit the types of input, their merged candidates within the budget, and the first chunks instead where there are none."""
    names, _ = plan(q.task, types, requested)

    def first() -> DataFrame:
        return fallback(chunks, q, order).select("chunk_id", "score", F.array(F.lit("fallback")).alias("matched_strategies"), F.struct(*order).alias("at"), (F.row_number().over(Window.orderBy(*order)) - 1).alias("idx"))

    if not names:
        return first()
    found = best_candidates(merged(chunks, q, names, order), budget).select("chunk_id", "score", "matched_strategies", "at", "idx")
    found = Scratch(chunks.sparkSession, "plan").write(found, "found")  # MOST_CANDIDATES rows; whether there are any is asked of them, not of the chunks again
    return first() if found.isEmpty() else found


def hit_counts(chunks: DataFrame, q: Query, names: list[str], order: list[str]) -> DataFrame:
    """(strategy, hits): the candidates of each strategy."""
    return candidates(chunks, q, names, order).groupBy("strategy").agg(F.count(F.lit(1)).alias("hits"))


def fallback(chunks: DataFrame, q: Query, order: list[str], top: int = TOP) -> DataFrame:
    """The first chunks, for when no strategy found any."""
    extra = F.lit(0.0)
    if q.task in ("summarize_logs", "debug_with_local_context"):
        extra = F.when(F.col("input_type") == "log", log_signal(_content())).otherwise(0.0)
    elif q.task in ("inspect_repo", "rag_compress", "propose_patch"):
        extra = F.when(F.col("input_type").isin("repo", "file"), code_signal(_content())).otherwise(0.0)
    return chunks.orderBy(*order).limit(top).select("chunk_id", *order, F.round(1.0 + extra, 3).alias("score"))


def candidate_limit(budget: int) -> int:
    return min(max(budget // 512, 8), MOST_CANDIDATES)


def best_candidates(found: DataFrame, budget: int = 64000) -> DataFrame:
    """The best by score, ties by arrival; idx counts from 0."""
    top = found.orderBy(F.desc("score"), "came").limit(candidate_limit(budget))
    return top.withColumn("idx", F.row_number().over(Window.orderBy(F.desc("score"), "came")) - 1)


def runtime_adjustment(q: Query, backend: str) -> Column:
    """What a model-backed runtime adds; nothing for the deterministic one."""
    if backend == "deterministic":
        return F.lit(0.0)
    fits = ["repo", "file"] if q.task in ("inspect_repo", "propose_patch", "rag_compress") else ["log"] if q.task in ("debug_with_local_context", "summarize_logs") else []
    return F.lit(0.15) + F.when(F.col("input_type").isin(*fits), 0.2).otherwise(0.0) + F.when(overlap(_content(), q.terms) > 0, 0.15).otherwise(0.0)


def reranked(candidates: DataFrame, q: Query, backend: str = "deterministic") -> DataFrame:
    """candidates with path, content, input_type, idx -> rerank_score, and place in its order."""
    score = F.col("score") + F.when(F.col("idx") < 3, 0.4).otherwise(0.0) + F.when(T.any_contained(F.lower("path"), q.terms), 0.8).otherwise(0.0)
    if q.task == "debug_with_local_context":
        score = score + F.when(_content().rlike(DEBUG), 0.5).otherwise(0.0)
    out = candidates.withColumn("rerank_score", F.round(score + runtime_adjustment(q, backend), 3))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("rerank_score"), "idx")))


def with_model_order(candidates: DataFrame, ordered: DataFrame) -> DataFrame:
    """ordered: (chunk_id, model_rank from 0) of the few that a model put in order; each gets 1 - rank / 10 more."""
    joined = candidates.join(ordered, "chunk_id", "left")
    return joined.withColumn("rerank_score", F.round(F.col("rerank_score") + F.coalesce(1.0 - F.col("model_rank") * 0.1, F.lit(0.0)), 3)).drop("model_rank")


def policy_signals(modes: list[tuple[str, str]], runtime: str, task: str, selected: DataFrame, excluded: list[str]) -> DataFrame:
    """One row: counts of backend modes, strategies that were not real, warnings, and selected paths from left-out directories."""
    counted: dict[str, int] = {}
    for mode in [m for _, m in modes] + [runtime]:
        counted[mode] = counted.get(mode, 0) + 1
    weak = {"heuristic", "fallback", "unavailable", "configured_local_llm"}
    degraded = [n for n, m in modes if m in weak] + ["runtime_backend"] * (runtime in weak)
    no_real = not counted.get("real") or task == "rag_compress" and runtime == "heuristic"
    bad = F.array_sort(F.collect_list(F.when(hits_directory(F.col("path"), excluded), F.col("path"))))
    row = selected.agg(bad.alias("bad"))
    warnings = reasons((F.lit(bool(weak & set(counted))), "LOCAL_RETRIEVAL_DEGRADED"), (F.lit(no_real), "NO_REAL_RETRIEVAL_BACKEND"), (F.size("bad") > 0, "IGNORED_PATH_RETRIEVAL_CONTAMINATION"))
    return row.select(F.lit(counted.get("real", 0)).alias("real_modes"), T.lit_array(degraded).alias("degraded"), warnings.alias("warnings"), F.slice("bad", 1, 8).alias("contaminated_paths"))
