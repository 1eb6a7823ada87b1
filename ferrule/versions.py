"""Versions of a table in a folder, each of which appears by one rename."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(Exception):
    """Another application has published the version meanwhile; begin again from the newest."""


class Versions:
    """Folders v<number>[-<mark>] in a store that has atomic renames.

    A version is written aside and renamed, which fails if another has its
    number; so two writers can't both follow the same version, and one that
    fails leaves the folder as it was.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.folder).getFileSystem(self._conf)

    def names(self) -> list[tuple[int, str]]:
        """Number and name of each version, in order."""
        if not self._fs.exists(self._path(self.folder)):
            return []
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        return sorted((self._number(n), n) for n in found if n.startswith("v") and n[1:].partition("-")[0].isdigit())

    @staticmethod
    def _number(name: str) -> int:
        return int(name[1:].partition("-")[0])

    def latest(self) -> int:
        names = self.names()
        return names[-1][0] if names else 0

    def publish(self, rows: DataFrame, number: int, mark: str = "") -> None:
        name = f"v{number:09d}{mark}"
        aside = f"{self.folder}/_aside-{uuid.uuid4().hex}"
        rows.write.parquet(aside)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.folder).toUri(), self._conf)
        plain = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            if any(n == number for n, _ in self.names()):
                raise Conflict(name)
            context.rename(self._path(aside), self._path(f"{self.folder}/{name}"), plain)
        except Exception as e:
            self._fs.delete(self._path(aside), True)
            raise e if isinstance(e, Conflict) or "FileAlreadyExists" not in str(e) else Conflict(name) from e

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.folder}/{name}"), True)
