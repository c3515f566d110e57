"""Tables written to the shared folder to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Where the setting is absent (tests, a laptop) a temporary folder of this
    machine is chosen once per application.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    name = "corpusgraph.own.scratch"
    if not spark.conf.get(name, None):
        spark.conf.set(name, "file://" + tempfile.mkdtemp(prefix="spark-corpusgraph-"))
    return spark.conf.get(name)


class Scratch:
    """Tables of one use, in a folder of their own that goes when the application ends."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        path = self._path(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}")
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        # With its scheme, so that what reads it without Spark looks in the same store.
        self.root = re.sub("^file:/+", "file:///", store.makeQualified(path).toString())
        store.deleteOnExit(path)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def save(self, df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
        """Writes a table, with options of its writer if need be, and reads it back."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").options(**(options or {})).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def read(self, name: str) -> DataFrame:
        """A table that was saved before."""
        return self.spark.read.parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        """Deletes a table that no later plan reads."""
        path = self._path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
