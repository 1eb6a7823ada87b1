"""The filtered, paged list of items, and one item's details."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import catalog
from .search_index import SearchIndex

USUAL, MOST = 100, 500
SHOWN_OCCURRENCES = 200


@dataclass(frozen=True)
class Query:
    """Filters; empty ones match everything.  origin: own (usual), windows or all."""

    risk: str | None = None
    kind: str | None = None
    origin: str | None = None
    search: str | None = None
    offset: int = 0
    limit: int = 0


def matching(items: DataFrame, occurrences: DataFrame, machines: DataFrame, query: Query, index: SearchIndex | None = None) -> DataFrame:
    """Items that pass the filters.  A search matches the rule, or place, target or machine of any occurrence; through the index if there is one."""
    out = items
    if query.origin != "all":
        out = out.where(F.col("origin") == ("windows" if query.origin == "windows" else "own"))
    if query.risk:
        out = out.where(F.col("risk") == query.risk)
    if query.kind:
        out = out.where(F.col("kind") == query.kind)
    if (text := (query.search or "").strip().lower()) and index is not None:
        out = out.join(index.numbers(text), "number", "left_semi")
    elif text:
        hosts = occurrences.join(machines.select("load_idx", "hostname"), "load_idx")
        has = [F.coalesce(F.lower(c).contains(text), F.lit(False)) for c in ("loc_path", "loc_item", "target", "hostname")]
        found = hosts.where(has[0] | has[1] | has[2] | has[3]).select("number").distinct().withColumn("_found", F.lit(True))
        out = out.join(found, "number", "left").where(F.col("_found").isNotNull() | F.lower("rule").contains(text)).drop("_found")
    return out


def page(items: DataFrame, occurrences: DataFrame, machines: DataFrame, query: Query, effort: bool = True, index: SearchIndex | None = None) -> tuple[int, DataFrame]:
    """How many items match, and those of the page in order.  Without effort its columns are null."""
    found = matching(items, occurrences, machines, query, index)
    total = found.count()
    limit = min(query.limit or USUAL, MOST)
    rows = found.orderBy("number").offset(min(query.offset, total)).limit(limit)
    first = rows.join(machines.select(F.col("load_idx").alias("_m"), F.col("hostname").alias("first_machine")), F.col("machine") == F.col("_m"), "left").drop("_m")
    if not effort:
        first = first.withColumns({c: F.lit(None).cast("double") for c in ("min_hours", "max_hours")})
    return total, first.select("number", "risk", "classification", "status", "reason", "rule", "kind", "activation", "origin", "machines", "first_machine", "loc_path", "loc_item", "target", "min_hours", "max_hours").orderBy("number")


def effort_note() -> Column:
    """What an item's effort includes: windows, same_as, size_factor, typical_script, counted_once (on all of its machines)."""
    hours = F.col("effort_kind") == "hours"
    return F.struct(
        (F.col("effort_kind") == "windows").alias("windows"), F.when(F.col("effort_kind") == "sameAs", F.col("same_as")).alias("same_as"), F.when(hours, F.col("size_factor")).otherwise(1).alias("size_factor"),
        (hours & F.col("typical_script")).alias("typical_script"), (hours & (F.col("machines") > 1)).alias("counted_once"),
    )


def detail(items: DataFrame, occurrences: DataFrame, machines: DataFrame, links: DataFrame, number: int) -> dict[str, DataFrame]:
    """The item, its first occurrences and how many there are, what it starts and what starts it, and what is published about its rule."""
    own = occurrences.where(F.col("number") == number).join(machines.select("load_idx", "hostname"), "load_idx")
    at = F.row_number().over(W.partitionBy("number").orderBy("load_idx", "loc_path", F.col("loc_item").asc_nulls_first(), "pos"))
    return {
        "item": items.where(F.col("number") == number).withColumn("effort_note", effort_note()),
        "occurrences": own.withColumn("at", at).where(F.col("at") <= SHOWN_OCCURRENCES).select("at", "hostname", "loc_kind", "loc_path", "loc_item", "target", "activation"),
        "more": own.agg(F.greatest(F.count("*") - SHOWN_OCCURRENCES, F.lit(0)).alias("more")),
        "starts": links.where(F.col("starter") == number).select("script").orderBy("script"),
        "sources": items.where(F.col("number") == number).join(F.broadcast(catalog.rule_sources(items.sparkSession)), "rule").select("place", "publisher", "title", "url", "checked", "published").orderBy("place"),
        "started_by": links.where(F.col("script") == number).select("starter").orderBy("starter"),
    }


@dataclass(frozen=True)
class Edition:
    """What an edition shows, and how many machines it takes (None: any number)."""

    name: str
    machines: int | None
    effort: bool
    hints: bool
    report: bool


FREE = Edition("free", 25, False, False, False)
ORGANIZATION = Edition("organization", None, True, True, True)
PROVIDER = Edition("provider", None, True, True, True)


def masked(items: DataFrame, edition: Edition) -> DataFrame:
    """Items without the columns that the edition doesn't show."""
    hidden = [] if edition.effort else ["min_hours", "max_hours", "size_factor", "typical_script", "effort_kind"]
    return items.drop(*hidden, *([] if edition.hints else ["hint"]))
