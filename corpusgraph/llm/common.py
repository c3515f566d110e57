"""Scratch tables and small helpers shared by the operators of this package."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scratch
from ..functions.scratch import shared_dir  # noqa: F401

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Bytes of rows that go to a Python worker at once; the default of 64 MB and its copies on either side crowd small executors.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: A key with more than this part of all rows is hot; there are at most as many such keys.
HOT_PART = 1024
#: Rows of a hot key that one task gets, about.
HOT_ROWS = 64


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_BYTES where they are larger; operators on whole texts call it."""
    value = str(spark.conf.get(_BATCH, "64m")).lower()
    if not (value.rstrip("b").isdigit() and int(value.rstrip("b")) <= BATCH_BYTES):
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")


class Scratch(scratch.Scratch):
    """Tables of one use of an operator on whole texts."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        bound_batches(spark)
        super().__init__(spark, name)


def arrow_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The store and the path of a folder that Spark wrote, for tasks that read it without Spark; s3a and s3n are names of s3."""
    scheme, rest = uri.split("://", 1)
    return fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{rest}")


def spread_join(rows: DataFrame, facts: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``facts`` (one row for each key) where some keys may hold a large share of the rows.

    Hot keys, each with more than a HOT_PART-th of all rows and so at most HOT_PART of
    them, are broadcast with their counts: their rows are dealt into parts, and their
    facts are repeated for each part. All other keys meet as in any join.
    """
    counts = rows.groupBy(*keys).count()
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    parts = F.least(F.lit(4 * HOT_PART), F.ceil(F.col("count") / F.greatest(F.lit(HOT_ROWS), F.lit(total // HOT_PART)))).cast("int")
    hot = F.broadcast(counts.filter(F.col("count") > max(HOT_ROWS, total // HOT_PART)).select(*keys, parts.alias("_parts")))
    n = F.coalesce("_parts", F.lit(1))
    dealt = rows.join(hot, keys, "left").withColumn("_part", F.pmod(F.xxhash64(*[c for c in rows.columns if c not in keys]), n).cast("int")).drop("_parts")
    many = facts.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), n - 1))).drop("_parts")
    return dealt.join(many, [*keys, "_part"], how).drop("_part")


def ascii_lower(col):
    """Lower-cases A-Z only."""
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
