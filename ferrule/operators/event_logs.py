"""Records of event logs, grouped into findings.

`events`: load_idx (machine), record_id long, provider, event_id int, time,
data map<string,string>.  The same expressions group a batch and a stream.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import command
from ..runtime import ship

# Providers, event ids, how many records a query takes.
ALERT_PROVIDER, ALERT_EVENT = "VBScriptDeprecationAlert", 4096
SYSMON_PROVIDER, SYSMON_START, SYSMON_LOAD = "Microsoft-Windows-Sysmon", 1, 7
MOST_EVENTS = 50_000
ENGINE = "\\vbscript.dll"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _first(array: Column) -> Column:
    return F.get(array, F.lit(0))


def field(name: str) -> Column:
    """A named value, whatever its case; null where it is missing or blank."""
    values = F.map_values(F.map_filter("data", lambda k, v: ascii_lower(k) == name.lower()))
    return F.nullif(_trim(_first(values)), F.lit(""))


def _by_name() -> Column:
    """Values in the order of their names."""
    return F.transform(F.array_sort(F.map_entries("data")), lambda e: e["value"])


def _labelled(name: str) -> Column:
    lines = F.flatten(F.transform(_by_name(), lambda v: F.split(v, r"\r?\n")))
    found = F.transform(lines, lambda x: F.regexp_extract(_trim(x), rf"^{name}\s*[:=]\s*(\S.*)$", 1))
    return _first(F.filter(found, lambda x: x != ""))


def alert_process(events: DataFrame) -> DataFrame:
    """events with `process` and `tree`: named fields, else labelled lines, else values that look like them."""
    values = F.transform(_by_name(), _trim)
    is_tree = lambda v: v.contains(";") & ascii_lower(v).contains(".exe") & ~v.contains("\n")
    named = events.withColumns({"_p": F.coalesce(field("ProcessName"), _labelled("ProcessName")), "_t": F.coalesce(field("ProcessTree"), _labelled("ProcessTree"))})
    tree = F.coalesce("_t", _first(F.filter(values, is_tree)))
    # a value that serves as the tree isn't taken for the process too
    is_process = lambda v: ascii_lower(v).endswith(".exe") & ~v.rlike(r"\s")
    spare = F.filter(values, lambda v: is_process(v) & (~v.eqNullSafe(F.col("tree")) | F.col("_t").isNotNull() | ~is_tree(v)))
    found = named.withColumn("tree", tree).withColumn("process", F.coalesce("_p", _first(spare), F.substring_index("tree", ";", 1), F.lit("unknown")))
    return found.drop("_p", "_t")


def _grouped(events: DataFrame, keys: dict[str, Column], shown: dict[str, Column]) -> DataFrame:
    """Count, first and last time of each key; other columns from the newest record."""
    newest = F.struct("time", "record_id")
    return events.groupBy("load_idx", *[c.alias(n) for n, c in keys.items()]).agg(
        F.count("*").alias("events"), F.min("time").alias("first_seen"), F.max("time").alias("last_seen"), *[F.max_by(c, newest).alias(n) for n, c in shown.items()]
    )


def alert_rows(events: DataFrame) -> DataFrame:
    """Deprecation alerts with `key` (program and process tree, whatever their case), `program` and `process_tree`."""
    some = events.where((F.col("event_id") == ALERT_EVENT) & (ascii_lower(F.col("provider")) == ALERT_PROVIDER.lower()))
    some = alert_process(some)
    key = F.concat_ws("|", ascii_lower(F.col("process")), ascii_lower(F.coalesce("tree", F.lit(""))))
    return some.select("load_idx", "record_id", "time", key.alias("key"), F.col("process").alias("program"), F.col("tree").alias("process_tree"))


def alerts(events: DataFrame) -> DataFrame:
    """Deprecation alerts by program and process tree."""
    shown = {n: F.col(n) for n in ("program", "process_tree")}
    return _grouped(alert_rows(events), {"key": F.col("key")}, shown).withColumn("rule", F.lit("VBS-501"))


_USE = T.StructType([T.StructField("found", T.BooleanType()), T.StructField("script", T.StringType())])


def _engine_uses(lines: pd.Series) -> pd.DataFrame:
    certain = [next((r for r in command.analyze(line) if r.usage == command.VBSCRIPT), None) for line in lines]
    return pd.DataFrame({"found": [r is not None for r in certain], "script": [r.script if r else None for r in certain]})


def process_starts(events: DataFrame) -> DataFrame:
    """Starts of programs whose command line runs the engine, by program and script."""
    some = events.where((F.col("event_id") == SYSMON_START) & (ascii_lower(F.col("provider")) == SYSMON_PROVIDER.lower()))
    line = F.coalesce(field("CommandLine"), F.lit(""))
    # the analyser needs Python: only lines that can matter reach it
    likely = ascii_lower(line).rlike(r"vbscript|\.vb[se]|script|mshta|powershell|pwsh|cmd|comspec")
    some = some.withColumns({"line": line, "image": F.coalesce(field("Image"), F.lit("")), "parent": field("ParentImage")}).where(likely)
    ship(events.sparkSession)
    engine_use = F.pandas_udf(_engine_uses, _USE)
    some = some.withColumn("use", engine_use("line")).where("use.found")
    key = F.concat_ws("|", ascii_lower(F.col("image")), ascii_lower(F.coalesce("use.script", F.lit(""))))
    return _grouped(some, {"key": key}, {"program": F.col("image"), "script": F.col("use.script"), "parent": F.col("parent"), "sample": F.col("line")}).withColumn("rule", F.lit("VBS-502"))


def engine_loads(events: DataFrame) -> DataFrame:
    """Programs that load the engine's library."""
    some = events.where((F.col("event_id") == SYSMON_LOAD) & (ascii_lower(F.col("provider")) == SYSMON_PROVIDER.lower()))
    library = field("ImageLoaded")
    some = some.withColumns({"library": library, "image": F.coalesce(field("Image"), F.lit(""))})
    some = some.where(F.translate(ascii_lower(F.col("library")), "/", "\\").endswith(ENGINE))
    return _grouped(some, {"key": ascii_lower(F.col("image"))}, {"program": F.col("image"), "sample": F.concat(F.lit("ImageLoaded: "), F.col("library"))}).withColumn("rule", F.lit("VBS-503"))


def newest(events: DataFrame, most: int = MOST_EVENTS) -> DataFrame:
    """The newest records of each machine's log, as a query with a cap reads them."""
    at = F.row_number().over(W.partitionBy("load_idx").orderBy(F.col("time").desc(), F.col("record_id").desc()))
    return events.withColumn("_at", at).where(F.col("_at") <= most).drop("_at")


def covered(channels: DataFrame, records: DataFrame, most: int = MOST_EVENTS) -> DataFrame:
    """The span that all queries saw whole: the log's, from the oldest record read where a query met its cap.

    `channels` has load_idx, oldest, newest; `records` load_idx, query, time.
    """
    capped = records.groupBy("load_idx", "query").agg(F.count("*").alias("n"), F.min("time").alias("oldest_read")).where(F.col("n") >= most)
    from_capped = capped.groupBy("load_idx").agg(F.max("oldest_read").alias("oldest_read"))
    out = channels.where("oldest is not null and newest is not null").join(from_capped, "load_idx", "left")
    start = F.greatest("oldest", F.coalesce("oldest_read", "oldest"))
    return out.select("load_idx", start.alias("time_from"), F.greatest("newest", start).alias("time_to"))
