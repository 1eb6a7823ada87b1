"""Records of event logs as their service renders them in XML."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..functions import markup
from ..runtime import ship


def parse_event(xml: str) -> tuple[int, str, int, str | None, dict[str, str]]:
    """(record id, provider, event id, time as written, data): fields by name, or by place as #1, #2; user data by tag."""
    tags = markup.tags(xml)
    provider, event_id, record_id, time, data = "", 0, 0, None, {}
    user = False
    unnamed = 0

    def number(value: str) -> int:
        return int(value) if value.isascii() and value.isdigit() else 0

    for i, tag in enumerate(tags):
        following = tags[i + 1] if i + 1 < len(tags) else None
        if tag.named("UserData"):
            user = not tag.closing
        elif tag.closing:
            continue
        elif tag.named("Provider"):
            provider = tag.get("Name") or tag.get("EventSourceName") or ""
        elif tag.named("EventID"):
            event_id = number(markup.text_after(xml, tags, i))
        elif tag.named("EventRecordID"):
            record_id = number(markup.text_after(xml, tags, i))
        elif tag.named("TimeCreated"):
            time = tag.get("SystemTime")
        elif tag.named("Data"):
            if not tag.empty:
                name = tag.get("Name")
                unnamed += name is None
                data[f"#{unnamed}" if name is None else name] = markup.text_after(xml, tags, i)
        elif user and not tag.empty and following is not None and following.closing and following.name == tag.name:
            data[tag.local] = markup.text_after(xml, tags, i)
    return record_id, provider, event_id, time, data


def read_events(rows: DataFrame) -> DataFrame:
    """Events of rows (load_idx, xml), as operators.event_logs takes them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parsed = [parse_event(x or "") for x in batch["xml"]]
            out = pd.DataFrame(parsed, columns=["record_id", "provider", "event_id", "time", "data"])
            out.insert(0, "load_idx", batch["load_idx"].to_numpy())
            yield out

    ship(rows.sparkSession)
    got = rows.select("load_idx", "xml").mapInPandas(run, "load_idx long, record_id long, provider string, event_id int, time string, data map<string,string>")
    return got.withColumn("time", got["time"].try_cast("timestamp"))
