"""Summaries of documents, logs and repositories, and the reduction of their shards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.classes import entrypoint_kind, is_entrypoint, role, summary_language

# Codes, needles (case matters), severities and next steps of known log failures.
LOG_PATTERNS = [
    ("MISSING_GENERATED_HEADER", "fatal error:", "high", ["Run the code generation step before compiling.", "Verify generated include paths are available to the compiler."]),
    ("UNDEFINED_REFERENCE", "undefined reference", "high", ["Check linker inputs and library ordering.", "Confirm the missing symbol is built for the current target."]),
    ("MODULE_NOT_FOUND", "ModuleNotFoundError", "medium", ["Install the missing dependency in the runtime environment.", "Verify the correct Python environment is active."]),
    ("TEST_FAILURE", "FAILED", "medium", ["Inspect the first failing test and its setup path.", "Compare the failing environment with a known-good run."]),
]
GENERIC = ("GENERIC_LOG_FAILURE", "", "medium", ["Inspect the first error-like lines in the log.", "Correlate the failure with the surrounding build or test step."])


def document_summary(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Line and word counts, opening sentence, key points, excerpt of 20 filled lines."""
    rows = docs.select(key, F.coalesce("content", F.lit("")).alias("content")).withColumn("ls", T.lines(F.col("content"))).withColumn("word_count", F.size(T.words(F.col("content"))))
    n_words, sentence = F.col("word_count"), T.first_sentence(F.col("content"))
    summary = F.when(n_words == 0, "The document is empty.").otherwise(F.concat(F.lit("The document contains "), n_words, F.lit(" words across "), F.size("ls"), F.lit(" lines. Opening sentence: "), sentence))
    excerpt = F.array_join(F.slice(F.transform(F.filter("ls", lambda x: T.strip(x) != ""), T.rstrip), 1, 20), "\n")
    return rows.select(key, F.size("ls").alias("line_count"), "word_count", summary.alias("summary"), T.key_points(F.col("ls")).alias("key_points"), excerpt.alias("excerpt"))


def _finding(p: tuple[str, str, str, list[str]], confidence: float) -> Column:
    return F.struct(F.lit(p[0]).alias("code"), F.lit(p[2]).alias("severity"), F.lit(confidence).alias("confidence"), T.lit_array(p[3]).alias("next_steps"))


def log_findings(ls: Column) -> Column:
    """Known failures of a log in the order of the table, or one generic finding; none for an empty log."""
    text = F.array_join(ls, "\n")
    known = F.array_compact(F.array(*(F.when(F.contains(text, F.lit(p[1])), _finding(p, 0.9 if p[2] == "high" else 0.75)) for p in LOG_PATTERNS)))
    return F.when(F.size(ls) == 0, F.slice(known, 1, 0)).when(F.size(known) == 0, F.array(_finding(GENERIC, 0.5))).otherwise(F.slice(known, 1, 5))


def log_summary(logs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Findings, summary, a timeline of start and failure, next steps, redacted excerpt."""
    rows = logs.select(key, T.lines(F.coalesce("content", F.lit(""))).alias("ls")).withColumn("findings", log_findings(F.col("ls")))
    hot = F.filter("ls", T.interesting)
    failure = F.coalesce(F.try_element_at(hot, F.lit(-1)), F.try_element_at("ls", F.lit(-1)))
    shown = F.when(F.size(hot) > 0, F.slice(hot, 1, 20)).otherwise(F.slice("ls", 1, 20))
    summary = F.when(F.size("ls") == 0, "The log is empty.").otherwise(F.concat(F.lit("The log contains "), F.size("ls"), F.lit(" lines. Primary classified issue: "), F.col("findings")[0]["code"], F.lit(".")))
    return rows.select(
        key,
        F.size("ls").alias("line_count"),
        summary.alias("summary"),
        F.transform("findings", lambda f: f["code"]).alias("codes"),
        F.substring(F.try_element_at("ls", F.lit(1)), 1, 32).alias("log_start"),
        F.substring(failure, 1, 32).alias("failure"),
        F.slice(F.array_distinct(F.flatten(F.transform("findings", lambda f: f["next_steps"]))), 1, 5).alias("next_steps"),
        F.array_join(F.transform(shown, lambda x: T.redact_line(T.rstrip(x))), "\n").alias("excerpt"),
    )


def first_of_each(items: DataFrame, group: list[str], key: str, order: list[str], limit: int) -> DataFrame:
    """In order, the first item of each key, limit of them in a group."""
    firsts = items.withColumn("_n", F.row_number().over(Window.partitionBy(*group, key).orderBy(*order))).where("_n = 1").drop("_n")
    return firsts.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("place") <= limit)


def child_outcomes(children: DataFrame, results: DataFrame, states: DataFrame) -> DataFrame:
    """children (parent, child), results (child, payload; null where corrupt), states (child, state) -> outcome ready, failed or pending."""
    rows = children.join(results.withColumn("_found", F.lit(True)), "child", "left").join(states, "child", "left")
    outcome = F.when(F.col("_found") & F.col("payload").isNotNull(), "ready").when(F.col("_found"), "pending").when(F.lower("state") == "failed", "failed").otherwise("pending")
    return rows.withColumn("outcome", outcome).drop("_found")


def coverage(outcomes: DataFrame) -> DataFrame:
    """By parent: children by outcome, and the share that is ready. Pending ones count as failed."""
    ready = F.count_if(F.col("outcome") == "ready")
    n = F.count(F.lit(1))
    return outcomes.groupBy("parent").agg(n.alias("children_total"), ready.alias("children_succeeded"), (n - ready).alias("children_failed"), (ready / n).alias("coverage_fraction"))


def reducer_action(outcomes: DataFrame, waited_s: Column, deadline_s: int = 60) -> DataFrame:
    """outcomes as of child_outcomes -> by parent what its reducer does now: reduce once no child is pending, partial when the deadline has passed, else wait."""
    rows = outcomes.withColumn("_waited", waited_s).groupBy("parent").agg(F.count_if(F.col("outcome") == "pending").alias("pending"), F.max("_waited").alias("waited_s"))
    return rows.withColumn("action", F.when(F.col("pending") == 0, "reduce").when(F.col("waited_s") >= deadline_s, "partial").otherwise("wait"))


def first_entries(rows: DataFrame, group: str, order: str, limits: dict[str, int]) -> DataFrame:
    """By group, for each column of arrays in limits: its entries in the order of rows, each once, so many of them. An entry's first place is found by an aggregate that combines before its shuffle, and only entries within the limit are collected, so no group is held as a whole."""
    listed = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x, i: F.struct(F.lit(c).alias("kind"), i.alias("pos"), x.alias("entry")))
    placed = rows.select(F.col(group), F.col(order).alias("_order"), F.explode(F.concat(*map(listed, limits))).alias("_e"))
    firsts = placed.groupBy(group, "_e.kind", "_e.entry").agg(F.min(F.struct("_order", "_e.pos")).alias("came"))
    limit = reduce(lambda out, x: F.when(F.col("kind") == x[0], x[1]).otherwise(out), limits.items(), F.lit(0))
    firsts = firsts.withColumn("_n", F.row_number().over(Window.partitionBy(group, "kind").orderBy("came", "entry"))).where((F.col("_n") <= max(limits.values())) & (F.col("_n") <= limit))
    chosen = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == c, F.struct("_n", "entry")))), lambda x: x["entry"]).alias(c)
    return firsts.groupBy(group).agg(*map(chosen, limits))


def _beside(rows: DataFrame, more: DataFrame, group: str, lists: list[str]) -> DataFrame:
    """rows with the lists of their group, a null one too; empty where the group has none."""
    more = more.withColumnRenamed(group, "_group")
    found = rows.join(more, F.col(group).eqNullSafe(F.col("_group")), "left").drop("_group")
    return found.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in lists})


def reduce_logs(shards: DataFrame, group: str, order: str, findings: int = 8, steps: int = 8, timeline: int = 12) -> DataFrame:
    """Shard summaries (codes, next_steps, log_start, failure) -> one row a group: codes and steps in order of shards, each once, and the times of the first shards."""
    rows = shards.groupBy(group).agg(F.count(F.lit(1)).alias("shards"))
    rows = _beside(rows, first_entries(shards, group, order, {"codes": findings, "next_steps": steps}), group, ["codes", "next_steps"])
    early = shards.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(order, "log_start", "failure"))).where(F.col("_n") <= -(-timeline // 2))
    times = F.transform(F.array_sort(F.collect_list(F.struct("_n", "log_start", "failure"))), lambda x: F.array(x["log_start"], x["failure"]))
    rows = _beside(rows, early.groupBy(group).agg(F.slice(F.flatten(times), 1, timeline).alias("timeline")), group, ["timeline"])
    said = F.when(F.size("codes") > 0, F.concat(F.lit("Aggregated "), F.col("shards"), F.lit(" log shard analyses. Primary classified issue: "), F.try_element_at("codes", F.lit(1)), F.lit("."))).otherwise(F.concat(F.lit("Aggregated "), F.col("shards"), F.lit(" log shard analyses with no merged findings.")))
    return rows.withColumn("summary", said)


def manifest(files: DataFrame) -> DataFrame:
    """files (repo, path, size) -> with language."""
    return files.withColumn("language", summary_language(F.col("path")))


def languages(files: DataFrame, top: int = 3) -> DataFrame:
    """By repo, the languages of most files, ties by first path."""
    counted = files.groupBy("repo", "language").agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("first_path"))
    return counted.withColumn("place", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("files"), "first_path"))).where(F.col("place") <= top)


def subsystems(files: DataFrame, first: int = 500, top: int = 5) -> DataFrame:
    """By repo, the top directories of most files among the first paths, with their roles."""
    heads = files.withColumn("_n", F.row_number().over(Window.partitionBy("repo").orderBy("path"))).where(F.col("_n") <= first)
    name = F.when(F.contains("path", F.lit("/")), F.substring_index("path", "/", 1)).otherwise(".")
    counted = heads.withColumn("name", name).groupBy("repo", "name").agg(F.count(F.lit(1)).alias("file_count"), F.min("path").alias("first_path"))
    ranked = counted.withColumn("place", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("file_count"), "first_path"))).where(F.col("place") <= top)
    return ranked.select("repo", "place", "name", role(F.col("name")).alias("role"), F.when(F.col("name") == ".", ".").otherwise(F.concat("name", F.lit("/"))).alias("path"), F.lit(0.7).alias("confidence"), "file_count")


def entrypoints(files: DataFrame, limit: int = 10) -> DataFrame:
    rows = files.where(is_entrypoint(F.col("path"))).withColumn("place", F.row_number().over(Window.partitionBy("repo").orderBy("path")))
    return rows.where(F.col("place") <= limit).select("repo", "place", "path", entrypoint_kind(F.col("path")).alias("kind"))


def dependencies_and_risks(files: DataFrame) -> DataFrame:
    """By repo: what it depends on and what is missing, by the files there are."""
    top = F.substring_index("path", "/", 1)
    rows = files.groupBy("repo").agg(F.bool_or(F.col("path") == "go.mod").alias("go"), F.bool_or(F.col("path").endswith(".py")).alias("py"), F.bool_or(F.col("path").startswith("deploy/slurm/")).alias("slurm"), F.bool_or((top == "broker") & (F.col("path") != "broker")).alias("broker"), F.bool_or((top == "tests") & (F.col("path") != "tests")).alias("tests"))
    deps = F.array_compact(F.array(F.when(F.col("go"), F.lit("Go toolchain")), F.when(F.col("py"), F.lit("Python 3")), F.when(F.col("slurm"), F.lit("Slurm"))))
    risks = F.array_compact(F.array(F.when(~F.col("broker"), F.lit("Repository does not yet contain a dedicated broker package.")), F.when(~F.col("tests"), F.lit("No tests directory was found."))))
    return rows.select("repo", deps.alias("dependencies"), F.when(F.size(risks) == 0, F.array(F.lit("Repository structure appears consistent with the current summary heuristics."))).otherwise(risks).alias("risks"))


def reduce_repos(shards: DataFrame, group: str, order: str, limits: dict[str, int] | None = None, lead: int = 240) -> DataFrame:
    """Shard summaries (summary, subsystems, entrypoints, dependencies, risks as arrays of strings) -> one row a group: each list in the order of shards, each entry once and a limited number of them; the first summary that says something leads, cut to lead characters."""
    limits = {"subsystems": 5, "entrypoints": 10, "dependencies": 10, "risks": 10} | (limits or {})
    said = F.min_by("summary", F.when(F.trim("summary") != "", F.col(order)))
    rows = shards.groupBy(group).agg(F.count(F.lit(1)).alias("shards"), F.substring(F.coalesce(said, F.lit("")), 1, lead).alias("summary"))
    return _beside(rows, first_entries(shards, group, order, limits), group, list(limits))
