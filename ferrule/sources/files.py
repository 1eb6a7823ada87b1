"""Files to inspect: listing, reading within bounds, and why some can't be read."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..runtime import ship
from . import listing, stores

MOST_CONTENT = 64 << 20
# Errors of reading, and the reasons that findings give; a missing file is none.
REASONS = {
    "PermissionError": "accessDenied", "IsADirectoryError": "unsupportedFormat", "BlockingIOError": "locked", "TimeoutError": "networkLocation",
    "TooLarge": "tooLarge", "CloudPlaceholder": "cloudPlaceholder", "Encrypted": "encrypted", "NetworkPath": "networkLocation", "OSError": "corrupt",
}
FLUSH = 16 << 20  # bytes of contents that a task holds before it hands them on


def reason(error: str | None) -> str | None:
    if error is None or error == "FileNotFoundError":
        return None
    return REASONS.get(error, "corrupt")


def reason_column(error) -> Column:
    e = F.col(error) if isinstance(error, str) else error
    out = F.when(e.isNull() | (e == "FileNotFoundError"), F.lit(None).cast("string"))
    for name, value in REASONS.items():
        out = out.when(e == name, value)
    return out.otherwise("corrupt")


def listed(spark: SparkSession, roots: list[str] | str, extensions: set[str], names: frozenset[str] = frozenset()) -> tuple[DataFrame, DataFrame]:
    """Files of the extensions or names below the roots (path, size, problem), and how many entries each root has (root, entries).

    Folders are listed in tasks, by listing.tree(); only names decide which
    files are looked at further, and links are never followed.
    """
    found = listing.tree(spark, roots, extensions, names)
    return listing.files(found), found.where("kind = 'expanded'").groupBy("root").agg(F.sum("size").alias("entries"))


def refused(path) -> Column:
    r"""Why a path isn't opened, as an error name; null for one that may be.

    Network paths, device paths and relative paths are refused in the form of
    Windows; of others all that don't begin with a slash or a scheme.
    """
    p = F.col(path) if isinstance(path, str) else path
    windows = p.rlike(r"^(?:[A-Za-z]:|\\)") | (p.contains("\\") & ~p.startswith("/"))
    why = F.when(windows, paths.refusal(p)).when(p.startswith("//"), "networkPath").when(~p.rlike(r"^(?:/|[A-Za-z][A-Za-z0-9+.-]+:/)"), "relativePath")
    return F.when(why == "networkPath", "NetworkPath").when(why.isNotNull(), "NotRead")


def _read(path: str, size: int | None, most: int) -> tuple[bytes | None, str | None]:
    try:
        own = None if (size or 0) > most else stores.look(path)
        if own is None or own.size > most:
            return None, "TooLarge"
        if own.kind != "file":  # it has become a link, which isn't followed, or a device
            return None, "CloudPlaceholder" if own.kind == "demand" else "NotRegular"
        content = stores.read(path, most + 1)
        return (None, "TooLarge") if len(content) > most else (content, None)  # it may have grown
    except OSError as e:
        return None, type(e).__name__


def read_listed(files: DataFrame, most: int = MOST_CONTENT) -> DataFrame:
    """Contents of listed files (load_idx, path, size, and if known a `problem` by its error name) that every executor can open.

    Returns load_idx, path, content, size, problem (a reason).  A file that has
    gone in the meantime has no row.  Paths that refused() names, links and
    devices aren't opened.  Pass a table whose parts are of like sizes, such as
    listing.planned() gives: a part is read by a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for load_idx, path, size, problem in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                content, error = (None, problem) if problem else _read(path, size, most)
                if error != "FileNotFoundError":
                    rows.append((load_idx, path, content, size, reason(error)))
                    held += len(content or b"")
                if held > FLUSH or len(rows) >= 1000:
                    yield table(rows)
                    rows, held = [], 0
        yield table(rows)

    kinds = [("load_idx", pa.int64()), ("path", pa.string()), ("content", pa.binary()), ("size", pa.int64()), ("problem", pa.string())]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], [n for n, _ in kinds])

    ship(files.sparkSession)
    known = F.col("problem") if "problem" in files.columns else F.lit(None).cast("string")
    rows = files.select(F.col("load_idx").cast("long"), "path", F.col("size").cast("long"), F.coalesce(known, refused("path")).alias("problem"))
    return rows.mapInArrow(run, "load_idx long, path string, content binary, size long, problem string")


def read_store(spark: SparkSession, paths: list[str] | str, extensions: set[str], load_idx: int = 0, most: int = MOST_CONTENT) -> DataFrame:
    """The same from any store that Spark reads, by the binary source; contents of larger files aren't read.

    For stores that only Spark's readers reach: that source leaves out files and folders whose names begin with a dot or an
    underscore.  listed() and read_listed() don't, on any store that stores.py opens.
    """
    pattern = "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in sorted(extensions)) + "}"
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(paths)
    small = rows.where(F.col("length") <= most).select(F.lit(load_idx).cast("long").alias("load_idx"), "path", "content", F.col("length").alias("size"), F.lit(None).cast("string").alias("problem"))
    large = rows.where(F.col("length") > most).select(F.lit(load_idx).cast("long"), "path", F.lit(None).cast("binary"), "length", F.lit("tooLarge"))
    return small.union(large)
