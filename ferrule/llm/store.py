"""Where intermediate tables live, and how code reaches the executors.

Lineage is cut by writing a table to the folder in `spark.checkpoint.dir`,
which all executors share, so a lost executor costs no recomputation beyond
its running tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import session_dir, ship

__all__ = ["Scratch", "ascii_lower", "documents", "shards_for", "ship", "small_batches", "spread_join", "table"]


def _path(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


class Scratch:
    """Tables of one run.  drop() removes one that is no longer read; what a result may still read goes with the application."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{session_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def keep(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        where = f"{self.base}/{name}"
        writer = df.write.mode("overwrite").option("compression", "zstd")
        with small_batches(self.spark):
            (writer.partitionBy(*partition_by) if partition_by else writer).parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self, name: str) -> None:
        path, fs = _path(self.spark, f"{self.base}/{name}")
        fs.delete(path, True)


@contextmanager
def small_batches(spark: SparkSession, size: int = 8 << 20) -> Iterator[None]:
    """Arrow batches of about `size` bytes for the actions within; the session's own limit holds again afterwards.

    Plans that are returned unexecuted run under the session's limit (64 MB a
    batch, unless it sets another).
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    had = spark.conf.get(name, None)
    spark.conf.set(name, f"{size}b")
    try:
        yield
    finally:
        if had is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, had)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column):
    """Lower-case A-Z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shards_for(rows: int, per: int, least: int = 16) -> int:
    """A power of two of buckets of about `per` rows."""
    n = least
    while n * per < rows:
        n *= 2
    return n


def spread_join(left: DataFrame, right: DataFrame, on: list[str], by: list[str], how: str = "inner", share: int = 1000, least: int = 256) -> DataFrame:
    """left joined to right on `on`, where many rows of left may have one key, and right's keys are unique.

    A key of more than 1/share of left's rows (and more than `least`) is dealt
    to several tasks by a hash of the columns `by`; right's row goes to each of
    them.  There are fewer than `share` such keys, so their list is broadcast
    at any size of the tables.  left is read three times: pass a written table.
    Keys that are null match nothing, and are dealt out as well.
    """
    each = max(least, left.count() // share)
    hot = left.groupBy(*on).agg(F.count("*").alias("_rows")).where(F.col("_rows") > each)
    hot = F.broadcast(hot.select(*on, F.ceil(F.col("_rows") / each).cast("int").alias("_parts")))
    known = F.lit(True)
    for c in on:
        known &= F.col(c).isNotNull()
    parts = F.when(known, F.coalesce("_parts", F.lit(1))).otherwise(share)
    dealt = left.join(hot, on, "left").withColumn("_part", F.pmod(F.xxhash64(*by), parts).cast("int")).drop("_parts")
    copies = right.join(hot, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copies, [*on, "_part"], how).drop("_part")
