"""Written intermediate tables, and numbering at any size."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; one of our own only where none is set."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = kept.get() if kept.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="ferrule-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def session_dir(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables, which is removed when the application ends."""
    sc = spark.sparkContext
    where = getattr(sc, "_ferrule_dir", None)
    if where is None:
        where = f"{shared_dir(spark).rstrip('/')}/ferrule-{sc.applicationId}"
        path = sc._jvm.org.apache.hadoop.fs.Path(where)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        sc._ferrule_dir = where
    return where


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python once a session, for operators that parse text or binary formats."""
    sc = spark.sparkContext
    if getattr(sc, "_ferrule_shipped", False):
        return
    package = Path(__file__).resolve().parent
    if package.is_dir():
        name = Path(tempfile.mkdtemp(prefix="ferrule-")) / "ferrule_code.zip"
        with zipfile.ZipFile(name, "w") as z:
            for file in sorted(package.rglob("*.py")):
                z.write(file, os.path.join(package.name, file.relative_to(package)))
        sc.addPyFile(str(name))
    sc._ferrule_shipped = True


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: lineage ends there, and a lost executor costs nothing.

    Tables last as long as the application, as what is returned is read later.
    """
    where = f"{session_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """materialize(), and the number of rows, which are counted as they are written."""
    seen = Observation()
    written = materialize(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return written, seen.get["n"]


#: Rows that one task may sort and number.
FEW_ROWS = 250_000


def numbered(df: DataFrame, order: list[Column], name: str = "number", rows: int | None = None) -> DataFrame:
    """Adds 1..n in a total order.

    Unless `rows` says that there are few, no task has all rows: they are
    dealt in ranges of the order and written; each range is numbered by itself
    and offset by the sizes of those before it, which is a table of one row a
    range.
    """
    if rows is not None and rows <= FEW_ROWS:
        return df.withColumn(name, F.row_number().over(W.orderBy(*[_directed(c, _bare(c)) for c in order])).cast("long"))
    columns = [F.col(f"_o{i}") for i in range(len(order))]
    spark = df.sparkSession
    keyed = df.withColumns({f"_o{i}": _bare(c) for i, c in enumerate(order)})
    way = [_directed(c, columns[i]) for i, c in enumerate(order)]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(keyed.repartitionByRange(parts, *way).withColumn("_range", F.spark_partition_id()), "ranges")
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select(F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    out = dealt.join(F.broadcast(sizes), dealt["_range"] == sizes["_r"])  # a row a partition
    out = out.withColumn(name, (F.col("_base") + F.row_number().over(W.partitionBy("_range").orderBy(*way))).cast("long"))
    return out.drop("_range", "_r", "_base", *[f"_o{i}" for i in range(len(order))])


class Descending:
    """A column that numbered() takes in descending order."""

    def __init__(self, column: Column):
        self.column = column


def _bare(c) -> Column:
    return c.column if isinstance(c, Descending) else c


def _directed(c, column: Column) -> Column:
    return column.desc() if isinstance(c, Descending) else column.asc()
