"""Reads every text as a log, classifies its failures, and sums them up by source: the nightly look at many logs.

    spark-submit jobs/log_digest.py --source TABLE --target DIR --run-date YYYY-MM-DD [--config FILE]

The source is a Parquet table (doc_id, text, source). The target has, for each run date:

- reports: a row for each log: findings by known patterns, the worst severity, where it failed, next steps, a redacted
  excerpt. A folder for each worst severity, so the few that matter are read alone;
- digest: a row for each source: logs, lines, how many failed in a known way, findings and next steps in the order they
  came, the first log of each severity, a timeline.

A run overwrites its date's folders and nothing else, so a run that is repeated, or that was stopped half-way and starts
again, leaves the same rows. The digest is made from the reports as they were written.

Rows without a doc_id are counted and left out. A null or empty text is an empty log: it has no findings and the severity
none. Rows that repeat a doc_id are logs of their own. A null source is a source.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, config_of, log, table_at
from lodestone.functions import text as T
from lodestone.operators import summaries

SOURCE = "doc_id long, text string, source string"
#: From the worst on.
SEVERITIES = ["high", "medium", "low", "none"]
REPORTS = "doc_id long, source string, line_count int, known boolean, codes array<string>, next_steps array<string>, log_start string, failure string, excerpt string, run_date date, severity string"
DIGEST = "source string, logs long, lines long, known_failures long, severity string, first_high long, first_medium long, codes array<string>, next_steps array<string>, timeline array<string>, summary string, run_date date"


def worst(severities: Column) -> Column:
    return F.coalesce(*(F.when(F.array_contains(severities, s), F.lit(s)) for s in SEVERITIES[:-1]), F.lit(SEVERITIES[-1]))


def reports_of(logs: DataFrame, config: dict) -> DataFrame:
    """A row for each log; all of it comes from the log's own row, without a shuffle."""
    content = F.coalesce("text", F.lit(""))
    rows = logs.select("doc_id", "source", content.alias("content"), T.lines(content).alias("ls")).withColumn("found", summaries.log_findings(F.col("ls")))
    hot = F.filter("ls", T.interesting)
    shown = F.slice(F.when(F.size(hot) > 0, hot).otherwise(F.col("ls")), 1, config["excerpt_lines"])
    failure = F.coalesce(F.try_element_at(hot, F.lit(-1)), F.try_element_at("ls", F.lit(-1)))
    codes = F.transform("found", lambda f: f["code"])
    return rows.select(
        "doc_id",
        "source",
        F.size("ls").alias("line_count"),
        ((F.size(codes) > 0) & ~F.array_contains(codes, summaries.GENERIC[0])).alias("known"),
        codes.alias("codes"),
        F.array_distinct(F.flatten(F.transform("found", lambda f: f["next_steps"]))).alias("next_steps"),
        F.substring(F.try_element_at("ls", F.lit(1)), 1, 32).alias("log_start"),
        F.substring(T.redact_line(failure), 1, 240).alias("failure"),
        F.array_join(F.transform(shown, lambda x: T.redact_line(T.rstrip(x))), "\n").alias("excerpt"),
        worst(F.transform("found", lambda f: f["severity"])).alias("severity"),
    )


def digest_of(reports: DataFrame, config: dict) -> DataFrame:
    """A row for each source. Counts are combined before the shuffle, and lists are cut by rank before they are collected."""
    first = lambda s: F.min(F.when(F.col("severity") == s, F.col("doc_id"))).alias(f"first_{s}")
    rank = F.min(F.array_position(T.lit_array(SEVERITIES), F.col("severity")))
    counts = reports.groupBy("source").agg(F.sum(F.col("line_count").cast("long")).alias("lines"), F.count_if("known").alias("known_failures"), F.element_at(T.lit_array(SEVERITIES), rank.cast("int")).alias("severity"), first("high"), first("medium"))
    lists = summaries.reduce_logs(reports, "source", "doc_id", config["findings"], config["next_steps"], config["timeline"])
    joined = lists.join(counts.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    return joined.withColumnRenamed("shards", "logs")


def overwrite(rows: DataFrame, path: str, run_date: str, *by: str) -> None:
    """Replaces all of a date's folder, also parts that the new rows do not have, as an overwrite by partitions would not."""
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "static")
    (writer.partitionBy(*by) if by else writer).parquet(f"{path}/run_date={run_date}")


def run(spark: SparkSession, source: str, target: str, run_date: str, config: dict | None = None) -> DataFrame:
    """Writes the reports and the digest of a date and returns the digest as read back."""
    config, run_date = config_of("log_digest", config), date.fromisoformat(run_date).isoformat()
    rows = spark.read.schema(SOURCE).parquet(source)
    logs = rows.where("doc_id IS NOT NULL")
    overwrite(reports_of(logs, config).hint("rebalance", "severity"), f"{target}/reports", run_date, "severity")
    reports = table_at(spark, f"{target}/reports", REPORTS).where(F.col("run_date") == F.lit(run_date).cast("date"))
    overwrite(digest_of(reports, config).select(*(c.split()[0] for c in DIGEST.split(", ")[:-1])), f"{target}/digest", run_date)
    digest = table_at(spark, f"{target}/digest", DIGEST).where(F.col("run_date") == F.lit(run_date).cast("date"))
    log.info("%s: read %d rows, %d of them with a doc_id; wrote %d reports and %d sources to %s", run_date, rows.count(), logs.count(), reports.count(), digest.count(), target)
    return digest


if __name__ == "__main__":
    command_line("log_digest", ["source", "target", "run_date"], run)
