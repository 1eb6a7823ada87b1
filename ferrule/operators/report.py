"""Reports: the list's sheets as tables, the overview as JSON, the management report as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..runtime import numbered
from . import coverage, finding_list, summary
from .assessment import Assessment

#: Rows of a sheet.
MOST_ROWS = 1_048_000


def dealt(rows: DataFrame, number: str, most: int) -> DataFrame:
    """rows with `sheet`, from 1: `most` rows of the total order that `number` (from 1, without gaps) gives are on each."""
    return rows.withColumn("sheet", (F.floor((F.col(number) - 1) / most) + 1).cast("int"))


def sheets(a: Assessment, rules: DataFrame, edition: finding_list.Edition = finding_list.ORGANIZATION, sources: DataFrame | None = None, most_rows: int = MOST_ROWS) -> dict[str, DataFrame]:
    """A table for each sheet; that of scans set aside only if there are any.

    Findings and locations have as many sheets as they need (column `sheet`),
    so no row is left out; cells are cut at 32,000 bytes, between characters.
    """
    names = summary.machine_names(a.occurrences, a.machines)
    findings = finding_list.masked(a.items, edition).join(names, "number", "left").withColumn("names", F.array_join("names", ", "))
    findings = findings.select(*[text.cell_column(c).alias(c) if t == "string" else F.col(c) for c, t in findings.drop("item_key", "first_seen").dtypes])
    # dealt by the whole order of the items, own ones first, so the number of a finding tells its sheet
    places = summary.locations(a.occurrences, a.machines)
    order = [F.col("number"), F.col("load_idx"), F.col("loc_path"), F.coalesce("loc_item", F.lit("")), F.col("pos")]
    places = numbered(places, order, "row")
    places = places.select(*[text.cell_column(c).alias(c) if t == "string" else F.col(c) for c, t in places.dtypes])
    out = {
        "summary": summary.summary(a.items, a.machines.count()),
        "findings": dealt(findings, "number", most_rows).orderBy("number"),
        "locations": dealt(places, "row", most_rows).orderBy("row"),
        "machines": summary.machine_rows(a.machines).orderBy("load_idx"),
        "rules": rules.orderBy("rule"),
    }
    if sources is not None:
        out["coverage"] = coverage.source_statuses(sources)
    if not a.set_aside.isEmpty():
        out["setAside"] = a.set_aside.orderBy("file")
    return out


def write_sheets(tables: dict[str, DataFrame], folder: str) -> None:
    """One folder of CSV a sheet, those of a table with `sheet` below it; nothing that is there is written over."""
    for name, df in tables.items():
        flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map", "variant")) else F.col(c) for c, t in df.dtypes])
        writer = flat.write.mode("errorifexists").option("header", "true")
        (writer.partitionBy("sheet") if "sheet" in flat.columns else writer).csv(f"{folder}/{name}")


def overview(a: Assessment, edition: finding_list.Edition = finding_list.ORGANIZATION) -> DataFrame:
    """Key figures, kinds and scans set aside as one JSON text.  Of bounded size but for the scans set aside."""
    figures = summary.summary(a.items, a.machines.count())
    kinds = summary.by_kind(a.items, a.occurrences).drop("kind_order", "counted")
    if not edition.effort:
        figures, kinds = (x.drop("effort_min", "effort_max") for x in (figures, kinds))
    listed = kinds.agg(F.array_sort(F.collect_list(F.struct(*kinds.columns))).alias("by_kind"))
    reasons = summary.not_checkable_reasons(a.items).agg(F.collect_list(F.struct("reason", "items")).alias("not_checkable_reasons"))
    modes = coverage.modes(a.machines).select(F.struct("full", "limited").alias("coverage"))
    return figures.crossJoin(listed).crossJoin(reasons).crossJoin(modes).select(F.to_json(F.struct("*")).alias("overview"))  # one row each


def management_report(a: Assessment, edition: finding_list.Edition = finding_list.ORGANIZATION) -> str:
    """Risks, priorities, recommendations, effort, system components and coverage, in Markdown.

    Every section is a query that returns a bounded number of rows.
    """
    s = summary.summary(a.items).first()
    kinds = summary.by_kind(a.items, a.occurrences)
    mode = coverage.modes(a.machines).first()
    show = lambda x: f"{x:.1f}".rstrip("0").rstrip(".")
    out = ["# Assessment", "", f"{s['items']} items on {mode.machines} machines: {s.high} high, {s.medium} medium, {s.low} low; {s.not_checkable} not checkable, {s.credentials} with credentials.", ""]
    out += ["## Risks", "", "| Kind | Items | High | Medium | Low | Machines |", "|-|-|-|-|-|-|"]
    out += [f"| {r.kind} | {r['items']} | {r.high} | {r.medium} | {r.low} | {r.machines} |" for r in kinds.collect()]
    out += ["", "Most urgent: " + (", ".join(f"{r.kind} ({r.high})" for r in summary.top_kinds(kinds).collect()) or "none") + "."]
    out += ["", "## Priorities", ""] + [f"{r.number}. {r.risk}, {r.rule}: {r.loc_path}" for r in summary.priorities(a.items).collect()]
    if s["items"] > 25:
        out.append(f"… and {s['items'] - 25} more.")
    if edition.hints:
        out += ["", "## Recommendations", ""] + [f"- {r.hint}: {r['items']} items, first {', '.join(map(str, r.numbers))}" for r in summary.recommendations(a.items).collect()]
    if edition.effort:
        out += ["", "## Effort", "", f"{show(s.effort_min)} to {show(s.effort_max)} hours, {show(s.effort_min / 8)} to {show(s.effort_max / 8)} days."]
    out += ["", "## Components of the system", "", f"{s.windows_items} items in {s.windows_occurrences} places."]
    out += [f"- {r.loc_path} ({r.occurrences})" for r in summary.windows_components(a.items).collect()]
    out += ["", "## Coverage", "", f"{mode.full} machines in full, {mode.limited} with limits."]
    out += [f"- {r.hostname}" for r in summary.limited_machines(a.machines).collect()]
    return "\n".join(out) + "\n"
