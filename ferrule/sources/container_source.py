"""Containers as a Spark data source: read by parts that are planned by bytes, written by attempts that a commit publishes.

Reading: the parts are those of a listing (listing.planned()), so the driver
handles their number and never the containers' names.  A part's containers are
opened one after another and handed on as Arrow batches of rows.

Writing: each task attempt writes its containers aside, into a folder of its
own.  The commit links those of the attempts that count to their names, and
never over another file; then it removes the folder of the whole job.  A job
that fails leaves nothing but containers that were published before.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import threading
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import timezone

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..runtime import ship
from . import container, stores
from .spare import Folder, give

FORMAT = "ferrule-containers"


@dataclass
class Part(InputPartition):
    """A file of a listing: path, size, problem."""

    file: str


@dataclass
class Written(WriterCommitMessage):
    """The folder of an attempt that counts; its names stay there, so messages don't grow with them."""

    folder: str


def _listed(file: str) -> Iterator[tuple[str, str | None, bytes | None]]:
    """The containers of a part, opened one after another."""
    table = pq.read_table(pa.BufferReader(stores.read(file, -1)), columns=["path", "problem"])
    for path, problem in zip(table["path"], table["problem"], strict=True):
        path, problem = path.as_py(), problem.as_py()
        content = None
        if not problem:
            try:
                content = stores.read(path, -1)
            except OSError as e:
                problem = type(e).__name__
        yield path, problem, content


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, parts: list[str], media_type: str):
        self.kinds, self.parts, self.media_type = schema, parts, media_type

    def partitions(self) -> list[InputPartition]:
        return [Part(p) for p in self.parts] or [Part("")]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.kinds)
        return container.batches_of(_listed(partition.file), schema, self.media_type) if partition.file else iter(())


def name_of(scan: dict, extension: str) -> str:
    """<host>_<yyyymmdd-hhmmss>Z.<extension>, in UTC."""
    at = container.parse_time(scan["startedAt"]).astimezone(timezone.utc)
    host = re.sub(r"[^A-Za-z0-9._-]", "_", scan["machine"]["hostname"]) or "machine"
    return f"{host}_{at:%Y%m%d-%H%M%S}Z.{extension}"


class Writer(DataSourceArrowWriter):
    """Scans (JSON) to containers in a folder that the executors share."""

    def __init__(self, folder: str, extension: str, spare: str | None = None):
        self.folder, self.extension, self.spare = folder, extension, spare
        self.job = os.path.join(folder, f".job-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        own = os.path.join(self.job, uuid.uuid4().hex)  # another attempt has another
        files = Folder(own, self.spare)
        for batch in iterator:
            for value in batch.column("scan"):
                scan = json.loads(value.as_py())
                name, data = name_of(scan, self.extension), container.to_bytes(scan)
                try:
                    files.write(data, name)
                except FileExistsError as e:
                    with open(os.path.join(own, name), "rb") as f:
                        if f.read() != data:
                            raise e
        files.clear()
        return Written(own)

    def _publish(self, folder: str) -> None:
        """Links an attempt's containers to their names, one after another; one that is there with the same content is no fault."""
        with os.scandir(folder) as made:
            for e in made:
                there = os.path.join(self.folder, e.name)
                try:
                    os.link(e.path, there)
                except FileExistsError:
                    with open(e.path, "rb") as one, open(there, "rb") as other:
                        if one.read() != other.read():
                            raise

    def _withdraw(self, folder: str) -> None:
        """Removes what _publish() has linked: names that are the same file as the attempt's."""
        with os.scandir(folder) as made:
            for e in made:
                there = os.path.join(self.folder, e.name)
                if os.path.exists(there) and os.path.samefile(e.path, there):
                    os.remove(there)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        folders = [m.folder for m in messages if m is not None]
        with ThreadPoolExecutor(16) as pool:
            done = [pool.submit(self._publish, f) for f in folders]
        if failed := next((e for e in (x.exception() for x in done) if e), None):
            for f in folders:
                self._withdraw(f)
            raise failed
        if self.spare:
            for f in folders:
                give(f, self.spare)
        shutil.rmtree(self.job, ignore_errors=True)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(self.job, ignore_errors=True)


class ContainerSource(DataSource):
    """Options: parts (JSON list of a listing's files) and mediaType to read; path, extension and spare to write."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return container.SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(schema, json.loads(self.options.get("parts", "[]")), self.options.get("mediatype", container.MEDIA_TYPE))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if overwrite or schema.names != ["scan"]:
            raise ValueError("containers are appended, from a column `scan` of JSON")
        return Writer(stores.local_path(self.options["path"]), self.options.get("extension", "zip"), self.options.get("spare"))


_registering = threading.Lock()


def _registered(spark: SparkSession) -> None:
    """Once a session, as registering it anew fails those who are about to use it; found by name in the session active in a thread."""
    spark._jvm.org.apache.spark.sql.classic.SparkSession.setActiveSession(spark._jsparkSession)
    with _registering:
        ship(spark)
        if not getattr(spark, "_ferrule_containers", False):
            spark.dataSource.register(ContainerSource)
            spark._ferrule_containers = True


def load(spark: SparkSession, planned: DataFrame, media_type: str = container.MEDIA_TYPE) -> DataFrame:
    """The rows (container.SCHEMA) of the containers in a planned listing."""
    _registered(spark)
    return spark.read.format(FORMAT).option("parts", json.dumps(planned.inputFiles())).option("mediaType", media_type).load()


def save(rows: DataFrame, folder: str, extension: str = "zip", spare: str | None = None) -> None:
    """Writes each row's `scan` (JSON) as a container into an existing folder, all or none.

    Fails, and leaves nothing, if one can't be written, or if two of different
    content have one name, or a file that is there has it.  Who removes
    containers again before writing others names a folder `spare` beside them:
    it gets the files, and those of removed containers are written over.
    """
    _registered(rows.sparkSession)
    to = rows.select("scan").write.format(FORMAT).mode("append").option("path", folder).option("extension", extension)
    (to.option("spare", spare) if spare else to).save()
