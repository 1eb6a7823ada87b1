"""What the scans could see.

`machines` has load_idx and coverage_mode; `limitations` load_idx and code;
`sources` load_idx, source, status, reason, entries, inspected, errors,
skipped, time_from, time_to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import catalog


def modes(machines: DataFrame) -> DataFrame:
    full = F.col("coverage_mode").eqNullSafe("full")
    return machines.agg(F.count("*").alias("machines"), F.count_if(full).alias("full"), F.count_if(~full).alias("limited"))


def limitation_codes(limitations: DataFrame) -> DataFrame:
    """Machines that have each code."""
    return limitations.select("load_idx", "code").distinct().groupBy("code").agg(F.count("*").alias("machines")).orderBy("code")


def source_statuses(sources: DataFrame) -> DataFrame:
    """Scans of each source by status; unknown ones as other."""
    known = [F.count_if(F.col("status") == s).alias(s) for s in catalog.SOURCE_STATUSES]
    other = F.count_if(~F.coalesce(F.col("status").isin(*catalog.SOURCE_STATUSES), F.lit(False))).alias("other")
    return sources.groupBy("source").agg(*known, other).orderBy("source")


def file_totals(sources: DataFrame) -> DataFrame:
    """Sums over the sources of files."""
    some = sources.where(F.col("source").startswith("files."))
    return some.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("entries", "inspected", "errors", "skipped")])


def _days():
    return F.greatest(F.unix_timestamp("time_to") - F.unix_timestamp("time_from"), F.lit(0)) / F.lit(86400.0)


def log_windows(sources: DataFrame) -> DataFrame:
    """The span of records of each event log of each machine."""
    return sources.where(F.col("source").startswith("eventLog.")).withColumn("days", _days())


def log_spans(sources: DataFrame) -> DataFrame:
    """Of each event log: machines that report it and that read it, shortest and longest span, first and last record."""
    read = F.col("status").isin("complete", "partial")
    when = lambda c: F.when(read, c)
    return log_windows(sources).groupBy("source").agg(
        F.count("*").alias("reported"), F.count_if(read).alias("read"),
        F.min(when(F.col("days"))).alias("min_days"), F.max(when(F.col("days"))).alias("max_days"),
        F.min(when(F.col("time_from"))).alias("earliest"), F.max(when(F.col("time_to"))).alias("latest"),
    )


def merge_counters(reports: DataFrame, by: list[str], samples: int = 20) -> DataFrame:
    """Sums of counters, and the first samples in order of report (`pos`)."""
    sums = reports.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("entries", "inspected", "errors", "skipped")])
    each = reports.select(*by, "pos", F.posexplode("error_samples").alias("at", "sample"))
    first = each.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy("pos", "at"))).where(F.col("_n") <= samples)
    listed = first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "sample"))), lambda x: x["sample"]).alias("error_samples"))
    return sums.join(listed, by, "left").withColumn("error_samples", F.coalesce("error_samples", F.array().cast("array<string>")))


def mode_of(limitations: list[str]) -> str:
    return "limited" if limitations else "full"
