"""Languages, roles, kinds, classifications, states and other small lookups as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import first_match

# Needles and the kinds they mean, in order.
ERROR_KINDS = [("fatal error", "build_error"), ("undefined reference", "linker_error"), ("exception", "runtime_exception"), ("traceback", "runtime_exception"), ("failed", "test_failure"), ("error", "generic_error")]
CODE_KINDS = [("func ", "function"), ("def ", "function"), ("class ", "class"), ("type ", "type"), ("interface ", "interface")]
# Ranks of classifications, in a worker and in the broker.
WORKER_RANKS = {"unknown": -1, "public": 0, "internal": 1, "restricted": 2, "phi": 3, "secret_adjacent": 4}
BROKER_RANKS = {"public": 0, "unknown": 1, "internal": 2, "restricted": 3, "phi": 4, "secret_adjacent": 5}
SENSITIVE = ["restricted", "phi", "secret_adjacent"]
# Job states.
OPEN_STATES = ["accepted", "queued", "dispatching", "running"]
TERMINAL_STATES = ["succeeded", "failed", "cancelled", "preempted", "timed_out"]
RETRYABLE_STATES = ["failed", "preempted", "timed_out"]
# Directories that a corpus scan leaves out, and file endings that it reads.
EXCLUDED_DIRS = [".git", ".broker", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox", ".venv", "venv", "env", "node_modules", "site-packages", "build", "dist"]
TEXT_ENDINGS = [".c", ".cc", ".cpp", ".cs", ".go", ".h", ".hpp", ".java", ".js", ".json", ".md", ".py", ".rb", ".rs", ".sh", ".sql", ".toml", ".ts", ".tsx", ".txt", ".xml", ".yaml", ".yml"]


def chain(rules: list[tuple[Column, object]], otherwise: object) -> Column:
    """The value of the first rule that holds."""
    out = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    for test, value in reversed(rules):
        out = F.when(test, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def extension(path: Column) -> Column:
    """With its dot, lower case; empty if there is none."""
    return F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r"[^.](\.[^.]+)$", 1))


def summary_language(path: Column) -> Column:
    ext = extension(path)
    return chain(
        [((path == "go.mod") | (ext == ".go"), "go"), (ext == ".py", "python"), (ext.isin(".md", ".rst", ".txt"), "docs"), (ext.isin(".sh", ".bash"), "shell"), (ext.isin(".json", ".yaml", ".yml", ".toml"), "config"), (ext != "", F.ltrim(ext, F.lit(".")))],
        "unknown",
    )


# Languages by file ending.
LANGUAGES = {
    ".c": "c", ".cc": "cpp", ".cpp": "cpp", ".cs": "csharp", ".go": "go", ".h": "c", ".hpp": "cpp", ".java": "java", ".js": "javascript", ".jsx": "javascript", ".json": "json",
    ".md": "markdown", ".py": "python", ".rb": "ruby", ".rs": "rust", ".sh": "shell", ".slurm": "shell", ".sql": "sql", ".toml": "toml", ".ts": "typescript", ".tsx": "typescript",
    ".txt": "text", ".xml": "xml", ".yaml": "yaml", ".yml": "yaml", ".ini": "config", ".conf": "config",
}


def language_of_path(path: Column) -> Column:
    """By ending; empty where it is not known, and such files are not read."""
    name = F.substring_index(path, "/", -1)
    by_ending = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv)), extension(path)), F.lit(""))
    return chain([(name == "go.mod", "go-module"), ((name == ".env") | name.endswith(".env.example"), "config")], by_ending)


def is_skipped(path: Column, names: list[str] | None = None, below: list[str] | None = None) -> Column:
    """In a left-out directory, a scheduler's output file, or under one of these paths."""
    out = hits_directory(path, names or EXCLUDED_DIRS) | F.substring_index(path, "/", -1).rlike("^slurm-.*[.]out$")
    for p in below or []:
        out = out | (path == p) | path.startswith(p.rstrip("/") + "/")
    return out


def role(name: Column) -> Column:
    """What a top directory is for, by its name."""
    return first_match(F.lower(name), [("broker", "control plane"), ("worker", "worker runtime"), ("deploy", "deployment assets"), ("config", "configuration"), ("test", "tests")], F.lit("repository subsystem"))


def is_entrypoint(path: Column) -> Column:
    return path.rlike("/main[.](go|py)$") | path.isin("go.mod", "README.md")


def entrypoint_kind(path: Column) -> Column:
    return chain([(path.rlike("/main[.](go|py)$"), "service_entrypoint"), (path == "go.mod", "module_root")], "project_entrypoint")


def chunk_kind(content: Column, input_type: Column) -> Column:
    return first_match(F.lower(content), ERROR_KINDS + CODE_KINDS, F.when(input_type == "log", "log_context").otherwise("code_context"))


def claim_type(kind: Column) -> Column:
    return chain([(kind.isin("build_error", "linker_error", "runtime_exception", "test_failure", "generic_error"), "observation"), (kind.isin("config_reference", "api_surface", "symbol_definition"), "recommendation")], "hypothesis")


def severity(kind: Column) -> Column:
    return chain([(kind.isin("build_error", "linker_error", "runtime_exception", "test_failure"), "high"), (kind.isin("generic_error", "config_reference"), "medium")], "low")


def confidence_label(score: Column) -> Column:
    return chain([(score >= 0.8, "high"), (score >= 0.65, "medium")], "low")


def usage_guidance(warnings: Column) -> Column:
    degraded = F.arrays_overlap(warnings, F.array(F.lit("LOCAL_RETRIEVAL_DEGRADED"), F.lit("IGNORED_PATH_RETRIEVAL_CONTAMINATION")))
    return chain([(F.array_contains(warnings, "NO_REAL_RETRIEVAL_BACKEND"), "lead_generation_only"), (degraded, "verify_before_claiming")], "broker_evidence_ready")


def rank_of(value: Column, ranks: dict[str, int], otherwise: int) -> Column:
    return chain([(value == k, v) for k, v in ranks.items()], otherwise)


def broker_class(value: Column) -> Column:
    """Trimmed and lower case; unknown words count as restricted."""
    v = F.lower(F.trim(value))
    return F.when(v.isin(*BROKER_RANKS), v).when(v == "", F.lit(None)).otherwise("restricted")


def scheduler_state(text: Column) -> Column:
    return first_match(F.upper(F.trim(text)), [("PENDING", "queued"), ("RUNNING", "running"), ("COMPLETED", "succeeded"), ("CANCELLED", "cancelled"), ("TIMEOUT", "timed_out"), ("PREEMPTED", "preempted"), ("FAILED", "failed"), ("OUT_OF_MEMORY", "failed")], F.lit("queued"))


def is_terminal(state: Column) -> Column:
    return state.isin(*TERMINAL_STATES)


def is_retryable(state: Column, with_cancelled: bool = False) -> Column:
    return state.isin(*RETRYABLE_STATES, *(["cancelled"] if with_cancelled else []))


def retry_skip_reason(state: Column, with_cancelled: bool = False) -> Column:
    rules = [(~is_terminal(state), "in_progress"), (state == "succeeded", "already_succeeded")]
    rules += [] if with_cancelled else [(state == "cancelled", "cancelled_excluded")]
    return chain([*rules, (is_retryable(state, with_cancelled), "not_retried")], "not_retryable")


def source_ref(kind: Column, path: Column) -> Column:
    return F.concat(chain([(kind == "artifact", "artifact:"), (kind == "repo", "repo:")], "file:"), path)


def hits_directory(path: Column, names: list[str]) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*(F.lit(n) for n in names)))


def clock(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)
