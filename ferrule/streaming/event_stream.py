"""Event grouping over a stream, with the expressions of the batch.

An extension: batch scans read logs once, a fleet that forwards its logs can
keep the same groups up to date.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import event_logs


def running_groups(events: DataFrame, group: Callable[[DataFrame], DataFrame] = event_logs.alerts) -> DataFrame:
    """A stream of all groups so far (complete or update mode)."""
    return group(events)


def windowed_counts(events: DataFrame, length: str = "1 day", late: str = "2 days") -> DataFrame:
    """Alerts by machine, program and window; state is dropped when records are later than `late`."""
    some = event_logs.alert_process(events.where(F.col("event_id") == event_logs.ALERT_EVENT).withWatermark("time", late))
    return some.groupBy("load_idx", F.window("time", length), event_logs.ascii_lower(F.col("process")).alias("program")).agg(F.count("*").alias("events"))


def to_memory(stream: DataFrame, name: str, mode: str = "complete") -> DataStreamWriter:
    return stream.writeStream.format("memory").queryName(name).outputMode(mode)
