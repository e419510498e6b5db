"""Tables that cut lineage, written to the folder all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only on one machine, as in tests, a folder of our own stands in where it is unset."""
    found = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{KEY} must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set(KEY, found)
    return found.rstrip("/")


class Scratch:
    """A folder for one operator run. Tables stay until drop() or the end of the driver."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
        atexit.register(self._quiet_drop)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def _quiet_drop(self) -> None:
        try:
            self._delete(self.path)
        except Exception:  # the JVM may be gone at exit
            pass

    def write(self, df: DataFrame, name: str, **options) -> DataFrame:
        """Writes df once and returns the table read back: a lost executor costs no recomputation."""
        df.write.mode("overwrite").options(**({"compression": "zstd"} | options)).parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    @staticmethod
    def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
        """A Parquet table at a path, empty where nothing was written yet."""
        try:
            return spark.read.schema(schema).parquet(path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], schema)

    def drop(self, name: str) -> None:
        """Removes a table that nothing reads any more."""
        self._delete(f"{self.path}/{name}")
