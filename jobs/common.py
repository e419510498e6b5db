"""What the jobs share: configs, logging, tables at explicit paths, and the session that only a command line makes."""

from __future__ import annotations

import argparse
import json
import logging
import os
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("lodestone.jobs")


def config_of(name: str, given: dict | None = None) -> dict:
    """The job's own config file, and what is given instead of some of it. An unknown key is an error."""
    with open(os.path.join(os.path.dirname(os.path.abspath(__file__)), f"{name}.json"), encoding="utf-8") as f:
        config = json.load(f)
    if unknown := set(given or {}) - set(config):
        raise ValueError(f"unknown keys of {name}: {sorted(unknown)}")
    return config | (given or {})


def table_at(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table at a path, empty where nothing was written yet. Partition columns have the schema's types."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def command_line(name: str, paths: list[str], run: Callable[..., DataFrame]) -> None:
    """--config, plain path arguments and one session for run(spark, *paths, config)."""
    parser = argparse.ArgumentParser(description=run.__doc__)
    for path in paths:
        parser.add_argument(f"--{path.replace('_', '-')}", required=True)
    parser.add_argument("--config", help="a JSON file with keys to set instead of the job's own")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    given = {}
    if args.config:
        with open(args.config, encoding="utf-8") as f:
            given = json.load(f)
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, *(getattr(args, p) for p in paths), config_of(name, given))
    finally:
        spark.stop()
