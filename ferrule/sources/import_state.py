"""What has been imported, kept from one import to the next.

A folder holds a version for each import: a table of the files that it took up,
with their outcome, scan and machine.  A version is written aside and appears
by one rename, which fails if another import has taken its number; so two
imports can't both extend the same state, and a failed one leaves it as it was.
An import reads and writes what it needs of names and keys only, and adds what
is new; compact() puts all versions into one that later readers begin with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialize
from ..versions import Conflict, Versions
from . import container

__all__ = ["Conflict", "ImportState"]

SCHEMA = "file string, outcome string, error string, scan_id string, _m0 string, _m1 string, _m2 string"
ALL = "-all"  # marks a version that holds all before it


class ImportState:
    """The versions in a folder of a store that has atomic renames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.versions = spark, Versions(spark, folder)

    def _names(self) -> list[tuple[int, str]]:
        """The versions that are read: the last that holds all before it, and those after."""
        names = self.versions.names()
        return names[max((i for i, (_, n) in enumerate(names) if n.endswith(ALL)), default=0) :]

    def version(self) -> int:
        return self.versions.latest()

    def table(self) -> DataFrame:
        """All files that imports have taken up, by their last outcome if they were tried again."""
        out = self.spark.createDataFrame([], f"{SCHEMA}, version long")
        for number, name in self._names():
            own = self.spark.read.schema(f"{SCHEMA}, version long").parquet(f"{self.versions.folder}/{name}")
            out = out.unionByName(own.withColumn("version", F.coalesce("version", F.lit(number).cast("long"))))
        last = F.max_by(F.struct(*[F.col(c.split()[0]) for c in SCHEMA.split(", ")]), "version")
        return out.groupBy(F.col("file").alias("_file")).agg(last.alias("x"), F.max("version").alias("version")).select("x.*", "version")

    def take_up(self, rows: DataFrame, machine_limit: int | None = None) -> DataFrame:
        """Imports the scans of read_files' rows (a written table) into the state.

        Returns imported()'s rows.  Files that were accepted or duplicates
        before are alreadyLoaded; those that were damaged or over the limit are
        tried again.  Scans and machines accepted before count for duplicates
        and for the limit.
        """
        number, before = self.version() + 1, materialize(self.table(), "known")
        done = before.where("outcome in ('accepted', 'duplicate')").select("file")
        known = before.where("outcome = 'accepted'").select("scan_id", *container.MACHINE)
        out = materialize(container.imported(rows, machine_limit, done, known), "imported")
        keys = [c.alias(m) for c, m in zip(container._machine(), container.MACHINE, strict=True)]
        new = out.where("outcome <> 'alreadyLoaded'").select("file", "outcome", "error", F.col("scanId").alias("scan_id"), *keys, F.lit(None).cast("long").alias("version"))
        self.versions.publish(new, number)
        return out

    def compact(self) -> None:
        """Writes one version that holds all; versions before it stay for those who read them, until vacuum()."""
        self.versions.publish(self.table(), self.version() + 1, ALL)

    def vacuum(self) -> int:
        """Removes the versions that one of compact() holds; how many there were."""
        read = {n for _, n in self._names()}
        old = [n for _, n in self.versions.names() if n not in read]
        for name in old:
            self.versions.remove(name)
        return len(old)
