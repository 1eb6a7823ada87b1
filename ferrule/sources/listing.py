"""Listing of folder trees on the executors, level by level.

The folders of a level are rows, dealt to tasks that expand them; folders found
are the next level, until there are none.  Each level is a written table, so
names never meet the driver, which learns only how many folders are left, and a
lost executor repeats the folders of its running tasks.  A folder's entries are
handed on in batches while it is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialize, ship
from . import stores

SCHEMA = "root string, path string, kind string, size long, problem string"
_ARROW = pa.schema([("root", pa.string()), ("path", pa.string()), ("kind", pa.string()), ("size", pa.int64()), ("problem", pa.string())])
FLUSH = 10_000  # rows that a task holds before it hands them on
FOLDERS = 64  # of a level, that a task expands
MOST_TASKS = 10_000


def _wanted(extensions: frozenset[str] | None, names: frozenset[str]):
    def check(path: str) -> bool:
        name = path.replace("\\", "/").rpartition("/")[2].lower()
        return extensions is None or name in names or ("." in name and name.rpartition(".")[2] in extensions)

    return check


def _expand(wanted, file_links: bool, given: bool):
    """Rows of folders -> rows of what is in them, and one of kind `expanded` with how many entries that was."""

    def one(root: str, path: str) -> Iterator[tuple]:
        if given:  # a path that the caller named: itself, whatever its name, and through a link
            try:
                own = stores.look(path, follow=True)
            except OSError as e:
                yield root, path, "error", None, type(e).__name__
                return
            if own.kind != "folder":
                yield (root, path, "file", own.size, None) if own.kind == "file" else (root, path, "error", None, "CloudPlaceholder" if own.kind == "demand" else "NotRegular")
                return
        n = 0
        try:
            for e in stores.entries(path):
                n += 1
                if e.kind == "folder":
                    yield root, e.path, "folder", None, None
                elif e.kind == "demand" or (e.kind == "other" and wanted(e.path)):
                    yield root, e.path, "error", e.size, "CloudPlaceholder" if e.kind == "demand" else "NotRegular"
                elif e.kind == "file" and wanted(e.path):
                    yield root, e.path, "file", e.size, None
                elif e.kind == "link" and file_links and wanted(e.path):
                    try:
                        if (own := stores.look(e.path, follow=True)).kind == "file":
                            yield root, e.path, "file", own.size, None
                    except OSError as error:
                        yield root, e.path, "error", None, type(error).__name__
        except OSError as error:
            yield root, path, "error", None, type(error).__name__
        yield root, path, "expanded", n, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for root, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for row in one(root, path):
                    rows.append(row)
                    if len(rows) >= FLUSH:
                        yield _table(rows)
                        rows = []
        yield _table(rows)

    return run


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def tree(spark: SparkSession, roots: list[str] | str, extensions: set[str] | None = None, names: set[str] | frozenset[str] = frozenset(), *, file_links: bool = False) -> DataFrame:
    """What lies at and below the roots: root, path, kind, size, problem.

    Kinds: `file` (of one of the extensions or names, whatever their case;
    without extensions all), `folder`, `expanded` (a folder with its number of
    entries), `error` (problem tells why).  A root that is a file is listed
    whatever its name.  Links aren't followed but from a root; `file_links`
    takes links to files as files.  Folders and files that a cloud service
    fills on demand are errors (CloudPlaceholder) and aren't opened; so are
    devices (NotRegular).  A path below several roots has a row for each.
    """
    ship(spark)
    roots = [roots] if isinstance(roots, str) else list(roots)
    wanted = _wanted(None if extensions is None else frozenset(e.lower() for e in extensions), frozenset(n.lower() for n in names))
    level = spark.createDataFrame([(r, r) for r in dict.fromkeys(roots)], "root string, path string")
    out, folders = None, len(roots)
    while folders:
        dealt = level.repartition(max(1, min(-(-folders // FOLDERS), MOST_TASKS)))
        found = materialize(dealt.mapInArrow(_expand(wanted, file_links, out is None), SCHEMA), "level")
        out = found if out is None else out.union(found)
        level = found.where("kind = 'folder'").select("root", "path")
        folders = level.count()
    return level.select(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("long"), F.lit(None).cast("string")).toDF("root", "path", "kind", "size", "problem") if out is None else out


def files(listed: DataFrame) -> DataFrame:
    """path, size, problem of the files of tree() and of what could not be read; each path once, also below several roots."""
    some = listed.where("kind in ('file', 'error')")
    return some.groupBy("path").agg(F.max("size").alias("size"), F.max("problem").alias("problem"))


def planned(listed: DataFrame, bytes_each: int = 64 << 20, files_each: int = 2_000) -> DataFrame:
    """path, size, problem in a written table with a part for about `bytes_each` bytes or `files_each` files."""
    total = listed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("files")).first()
    parts = max(1, -(-total["bytes"] // bytes_each), -(-total["files"] // files_each), min(total["files"] // 32, listed.sparkSession.sparkContext.defaultParallelism))
    return materialize(listed.repartition(int(min(parts, 10 * MOST_TASKS)), "path"), "planned")
