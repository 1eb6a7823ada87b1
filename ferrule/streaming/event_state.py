"""Groups of a machine's newest records, kept over a stream.

Records come in any order and some of them again.  Of each machine the newest
`most` records are kept in state, each once; whatever changes in their groups
is handed on.  A record that was pushed out and comes again is older than all
that are kept, and is pushed out again, so repeats never count.  So the last
state of all groups is that of the batch operators over the newest records,
however the stream is cut.  A machine's state has at most `most` records, and a
micro-batch is merged into it record by record.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.event_logs import MOST_EVENTS, alert_rows
from ..runtime import ship

COLUMNS = ["record_id", "time", "key", "program", "process_tree"]
OUT = "load_idx long, key string, events long, first_seen timestamp, last_seen timestamp, program string, process_tree string, capped boolean"
NAMES = [c.split()[0] for c in OUT.split(", ")]
CHANGE = Row(*NAMES)
#: Records that a merge takes beyond those it keeps, before it drops the oldest.
ROOM = 1024
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def kept_of(kept: Iterable[tuple], more: Iterable[tuple], most: int) -> list[tuple]:
    """The newest `most` of both (tuples of COLUMNS), each record_id once, oldest first; one without a time is older than all."""
    found: dict = {}
    for record in chain(kept, more):
        found.setdefault(record[0], record)
        if len(found) > 2 * most + ROOM:
            found = {r[0]: r for r in _newest(found, most)}
    return _newest(found, most)


def _newest(found: dict, most: int) -> list[tuple]:
    return sorted(found.values(), key=lambda r: (r[1] is not None, r[1] if r[1] is not None else 0, r[0]))[-most:]


def groups_of(kept: list[tuple]) -> dict[str, tuple]:
    """key -> (events, first_seen, last_seen, program, process_tree); what is shown comes from its newest record."""
    found: dict[str, tuple] = {}
    for _, time, key, program, tree in kept:
        events, first, _, _, _ = found.get(key, (0, None, None, None, None))
        found[key] = (events + 1, time if first is None else first, time, program, tree)
    return found


def changes_of(had: list[tuple], kept: list[tuple], most: int) -> list[tuple]:
    """Rows (key, events, first_seen, last_seen, program, process_tree, capped) of groups that differ, and of the machine."""
    before, now = groups_of(had), groups_of(kept)
    out = [(key, *group, False) for key, group in now.items() if before.get(key) != group]
    out += [(key, 0, None, None, None, None, False) for key in before if key not in now]
    return [*out, (None, len(kept), kept[0][1], kept[-1][1], None, None, len(kept) >= most)]


def merged(kept: pd.DataFrame, more: pd.DataFrame, most: int) -> pd.DataFrame:
    """kept_of() of frames."""
    return pd.DataFrame(kept_of(*(x[COLUMNS].itertuples(index=False, name=None) for x in (kept, more)), most), columns=COLUMNS)


class NewestGroups(StatefulProcessor):
    """State: a machine's kept records as one packed value.  Times are microseconds."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("kept", "records binary")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = self.state.get()
        had = [tuple(r) for r in json.loads(zlib.decompress(bytes(state[0])))] if state else []
        kept = kept_of(had, ((r["record_id"], r["at"], r["key"], r["program"], r["process_tree"]) for r in rows), self.most)
        if kept != had:
            self.state.update((zlib.compress(json.dumps(kept, separators=(",", ":")).encode(), 1),))
        for change in changes_of(had, kept, self.most):
            yield CHANGE(key[0], *change)

    def _changed(self, load_idx: int, had: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
        """changes_of() of frames."""
        rows = changes_of(*(list(x[COLUMNS].itertuples(index=False, name=None)) for x in (had, kept)), self.most)
        return pd.DataFrame([(load_idx, *r) for r in rows], columns=NAMES)

    def close(self) -> None:
        pass


def newest_groups(rows: DataFrame, most: int = MOST_EVENTS, late: str = "30 days") -> DataFrame:
    """A stream of rows (load_idx, record_id, time, key, program, process_tree) to changes of groups.

    A row of a key is its group as it is now (events 0: none is left); the row
    without a key tells how many records of the machine are kept, their span,
    and whether there were more (capped).  Records later than `late` are
    dropped by the watermark.  Start queries over it under rocksdb().
    """
    ship(rows.sparkSession)
    keyed = rows.withWatermark("time", late).withColumn("at", F.unix_micros("time")).groupBy("load_idx")
    changes = keyed.transformWithState(NewestGroups(most), OUT.replace("timestamp", "long"), "Update", "EventTime")
    return changes.withColumns({c: F.timestamp_micros(c) for c in ("first_seen", "last_seen")})


def alert_groups(events: DataFrame, most: int = MOST_EVENTS, late: str = "30 days") -> DataFrame:
    """newest_groups() of deprecation alerts."""
    return newest_groups(alert_rows(events), most, late)


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start within keep their state in RocksDB, which state of this kind needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    had = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.unset(name) if had is None else spark.conf.set(name, had)


def kept_in(changes: DataFrame, folder: str, checkpoint: str):
    """A query that keeps the changes of each micro-batch in a table of its own; one that is repeated is written over."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{folder}/b{number:09d}")

    return changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put)


def current(changes: DataFrame) -> DataFrame:
    """The last of all changes that kept_in() has written: groups as they are, and a row without key a machine."""
    last = changes.groupBy("load_idx", F.col("key").alias("_key")).agg(F.max_by(F.struct(*NAMES), "batch").alias("x"))
    return last.select("x.*").where("events > 0")
