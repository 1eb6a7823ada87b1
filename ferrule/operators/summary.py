"""Figures and lists over the items of an assessment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import catalog


def kind_order(kind="kind") -> Column:
    """Kinds in the order of reports; unknown ones after all others."""
    c = F.col(kind) if isinstance(kind, str) else kind
    out = F.lit(len(catalog.KINDS))
    for i, name in enumerate(catalog.KINDS):
        out = F.when(c == name, F.lit(i)).otherwise(out)
    return out


def _count(condition: Column) -> Column:
    return F.count_if(condition)


def _hours(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0.0))


def summary(items: DataFrame, machines: int | None = None) -> DataFrame:
    """One row of figures.  Items that can't be checked count instead of by their class; the system's own apart."""
    own, checked = F.col("origin") == "own", F.col("status") == "detected"
    out = items.agg(
        _count(own).alias("items"),
        _count(own & (F.col("risk") == "high")).alias("high"),
        _count(own & (F.col("risk") == "medium")).alias("medium"),
        _count(own & F.col("risk").isin("low", "info")).alias("low"),
        _count(own & checked & (F.col("classification") == "breaks")).alias("breaks"),
        _count(own & checked & (F.col("classification") != "breaks")).alias("review"),
        _count(own & ~checked).alias("not_checkable"),
        _count(own & (F.col("kind") == "hardcodedCredential")).alias("credentials"),
        _hours("min_hours").alias("effort_min"),
        _hours("max_hours").alias("effort_max"),
        _count(~own).alias("windows_items"),
        F.coalesce(F.sum(F.when(~own, F.col("occurrences"))), F.lit(0)).alias("windows_occurrences"),
    )
    return out if machines is None else out.withColumn("machines", F.lit(machines).cast("long"))


def by_kind(items: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Own items by kind, with the machines that have any; in report order."""
    own = items.where(F.col("origin") == "own")
    tally = own.groupBy("kind").agg(
        F.count("*").alias("items"),
        _count(F.col("risk") == "high").alias("high"),
        _count(F.col("risk") == "medium").alias("medium"),
        _count(F.col("risk").isin("low", "info")).alias("low"),
        _count(F.col("status") != "detected").alias("not_checkable"),
        _count(F.col("min_hours").isNotNull()).alias("counted"),
        _hours("min_hours").alias("effort_min"),
        _hours("max_hours").alias("effort_max"),
    )
    machines = occurrences.select("number", "load_idx").join(own.select("number", F.col("kind").alias("_kind")), "number").select("_kind", "load_idx").distinct().groupBy("_kind").agg(F.count("*").alias("machines"))
    return tally.join(machines, tally["kind"] == machines["_kind"], "left").drop("_kind").withColumn("kind_order", kind_order()).orderBy("kind_order", "kind")


def top_kinds(kinds: DataFrame, n: int = 4) -> DataFrame:
    """The kinds with the most high risks."""
    return kinds.where("high > 0").orderBy(F.col("high").desc(), "kind_order", "kind").limit(n)


def not_checkable_reasons(items: DataFrame) -> DataFrame:
    """Why own items couldn't be checked, the commonest first."""
    some = items.where((F.col("origin") == "own") & (F.col("status") == "notCheckable"))
    return some.groupBy(F.coalesce("reason", F.lit("unknown")).alias("reason")).agg(F.count("*").alias("items")).orderBy(F.col("items").desc(), "reason")


def recommendations(items: DataFrame, shown: int = 12) -> DataFrame:
    """Own items by hint: how many, the most urgent numbers and the kinds; the most urgent hint first."""
    own = items.where((F.col("origin") == "own") & F.col("hint").isNotNull())
    kinds = own.groupBy("hint", "kind").agg(F.min("number").alias("first")).groupBy("hint").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "kind"))), lambda x: x["kind"]).alias("kinds"))
    ranked = own.select("hint", "number").withColumn("_at", F.row_number().over(W.partitionBy("hint").orderBy("number")))
    numbers = ranked.groupBy("hint").agg(F.count("*").alias("items"), F.min("number").alias("most_urgent"), F.array_sort(F.collect_list(F.when(F.col("_at") <= shown, F.col("number")))).alias("numbers"))
    return numbers.join(kinds, "hint").orderBy("most_urgent")


def priorities(items: DataFrame, n: int = 25) -> DataFrame:
    """The first n own items."""
    return items.where(F.col("origin") == "own").orderBy("number").limit(n)


def windows_components(items: DataFrame, n: int = 40) -> DataFrame:
    """The system's own items with the most occurrences."""
    return items.where(F.col("origin") == "windows").orderBy(F.col("occurrences").desc(), "number").limit(n)


def limited_machines(machines: DataFrame, n: int = 20) -> DataFrame:
    return machines.where(F.col("coverage_mode") != "full").orderBy("load_idx").limit(n)


def machine_names(occurrences: DataFrame, machines: DataFrame, shown: int = 50) -> DataFrame:
    """Of each item the distinct machines in order of occurrence: the first `shown` names and how many more."""
    each = occurrences.select("number", "load_idx").distinct().withColumn("_at", F.row_number().over(W.partitionBy("number").orderBy("load_idx")))
    named = each.join(machines.select("load_idx", "hostname"), "load_idx")
    out = named.groupBy("number").agg(F.array_sort(F.collect_list(F.when(F.col("_at") <= shown, F.struct("_at", "hostname")))).alias("first"), F.count("*").alias("machines"))
    return out.select("number", F.transform("first", lambda x: x["hostname"]).alias("names"), F.greatest(F.col("machines") - shown, F.lit(0)).alias("more"))


def locations(occurrences: DataFrame, machines: DataFrame) -> DataFrame:
    """All occurrences, by item number and then by machine and place."""
    named = occurrences.join(machines.select("load_idx", "hostname"), "load_idx")
    return named.select("number", "hostname", "loc_kind", "loc_path", "loc_item", "target", "activation", "file_size", "load_idx", "pos").orderBy("number", "load_idx", "loc_path", F.col("loc_item").asc_nulls_first(), "pos")


def machine_rows(machines: DataFrame) -> DataFrame:
    seconds = F.greatest(F.unix_timestamp("finished_at") - F.unix_timestamp("started_at"), F.lit(0))
    return machines.select("load_idx", "hostname", "domain", "started_at", F.round(seconds / 60, 1).alias("minutes"), "coverage_mode", "detected", "not_checkable")


def finding_numbers(findings: DataFrame) -> DataFrame:
    """findings with f1, f2 .. in each scan: by kind, place, first evidence, rule and target."""
    order = [kind_order().asc(), F.col("kind").asc(), F.col("loc_path").asc(), F.col("loc_item").asc_nulls_first(), F.col("evidence_line").asc_nulls_first(), F.col("rule").asc(), F.col("target").asc_nulls_first(), F.col("pos").asc()]
    return findings.withColumn("finding_id", F.concat(F.lit("f"), F.row_number().over(W.partitionBy("load_idx").orderBy(*order))))


def format_hours(hours) -> Column:
    """Whole from 10, one decimal from 1, else two; no trailing zeros."""
    h = F.col(hours) if isinstance(hours, str) else hours
    # halves go to the even neighbour
    text = F.when(h >= 10, F.format_string("%.0f", F.bround(h, 0))).when(h >= 1, F.format_string("%.1f", F.bround(h, 1))).otherwise(F.format_string("%.2f", F.bround(h, 2)))
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def days(hours) -> Column:
    """Working days of eight hours."""
    return format_hours((F.col(hours) if isinstance(hours, str) else hours) / 8)
