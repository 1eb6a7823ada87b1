"""Queries over a fleet derived from the order tables, and the same in plain SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import messages, paths
from ..operators import assessment, coverage, finding_list, report, search_index, summary, upkeep
from ..sources import catalog
from . import fleet
from .oracles import norm, over

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def add(f):
        REGISTRY[f.__name__] = (f, sql)
        return f

    return add


_KEPT: dict[tuple, assessment.Assessment] = {}


def forget() -> None:
    """Assess anew from now on, as for measuring."""
    _KEPT.clear()


def _stamp(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of a table's files."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found))


def assessed(spark: SparkSession, sf_dir: str) -> assessment.Assessment:
    """The fleet's assessment.  Its tables last as long as the application, so queries over the same files share one."""
    key = (spark.sparkContext.applicationId, *(_stamp(spark, f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem")))
    if key not in _KEPT:
        _KEPT[key] = assessment.assess(fleet.scans(spark, sf_dir), fleet.findings(spark, sf_dir))
    return _KEPT[key]


ITEM = "number, risk, rule, kind, classification, status, reason, origin, machines, occurrences, loc_path, loc_item, target, effort_kind, typical_script, min_hours, max_hours"


@query(over(f"select {ITEM}, rr as activation_rank, hint, coalesce(same_as, 0) as same_as from items"))
def assessment_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = assessed(spark, sf_dir).items.withColumn("activation_rank", assessment.rank("activation"))
    return items.select(*ITEM.split(", "), "activation_rank", "hint", F.coalesce("same_as", F.lit(0)).alias("same_as"))


@query(over(f"select {ITEM}, rr as activation_rank, hint, coalesce(same_as, 0) as same_as from items"))
def assessment_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same items after nine tenths of the scans were assessed and the others came in, in two updates."""
    scans, findings = fleet.scans(spark, sf_dir), fleet.findings(spark, sf_dir)
    kept = upkeep.Upkeep()
    for part in ("load_idx % 10 > 1", "load_idx % 10 = 0", "load_idx % 10 = 1"):
        kept = kept.update(scans.where(part), findings.where(part))
    items = kept.assess().items.withColumn("activation_rank", assessment.rank("activation"))
    return items.select(*ITEM.split(", "), "activation_rank", "hint", F.coalesce("same_as", F.lit(0)).alias("same_as"))


@query(over("select load_idx, hostname, domain, started_at from chosen"))
def newest_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessment.newest_scans(fleet.scans(spark, sf_dir))[0].select("load_idx", "hostname", "domain", "started_at")


@query(over("""select file, hostname, started_at, why from (
  select file, hostname, started_at, case when rn > 1 then 'superseded' when row_number() over (partition by rn = 1 order by load_idx) > 100 then 'machineLimit' end as why from ranked
) where why is not null"""))
def set_aside_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessment.newest_scans(fleet.scans(spark, sf_dir), machine_limit=100)[1]


@query(over("select x.number as starter, y.number as script from links l join items x on l.src = x.item_key join items y on l.dst = y.item_key"))
def item_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessed(spark, sf_dir).links


@query(over("select i.number, o.load_idx, o.pos, o.path, o.n_target from o join items i using (item_key)"))
def item_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessed(spark, sf_dir).occurrences.select("number", "load_idx", "pos", "path", "n_target")


@query(over("""select count(*) filter (origin = 'own') as items, count(*) filter (origin = 'own' and risk = 'high') as high, count(*) filter (origin = 'own' and risk = 'medium') as medium,
  count(*) filter (origin = 'own' and risk in ('low', 'info')) as low, count(*) filter (origin = 'own' and status = 'detected' and classification = 'breaks') as breaks,
  count(*) filter (origin = 'own' and status = 'detected' and classification <> 'breaks') as review, count(*) filter (origin = 'own' and status <> 'detected') as not_checkable,
  count(*) filter (origin = 'own' and kind = 'hardcodedCredential') as credentials, round(sum(min_hours), 3) as effort_min, round(sum(max_hours), 3) as effort_max,
  count(*) filter (origin <> 'own') as windows_items, cast(sum(occurrences) filter (origin <> 'own') as bigint) as windows_occurrences from items"""))
def assessment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.summary(assessed(spark, sf_dir).items).withColumns({c: F.round(c, 3) for c in ("effort_min", "effort_max")})


@query(over("""select kind, count(*) as items, count(*) filter (risk = 'high') as high, count(*) filter (risk = 'medium') as medium, count(*) filter (risk in ('low', 'info')) as low,
  count(*) filter (status <> 'detected') as not_checkable, count(min_hours) as counted, round(coalesce(sum(min_hours), 0), 3) as effort_min, round(coalesce(sum(max_hours), 0), 3) as effort_max,
  any_value(m.machines) as machines
  from items i join (select x.kind as k, count(distinct o.load_idx) as machines from o join items x using (item_key) where x.origin = 'own' group by 1) m on i.kind = m.k where origin = 'own' group by kind"""))
def assessment_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = assessed(spark, sf_dir)
    return summary.by_kind(a.items, a.occurrences).drop("kind_order").withColumns({c: F.round(c, 3) for c in ("effort_min", "effort_max")})


@query(over("select coalesce(reason, 'unknown') as reason, count(*) as items from items where origin = 'own' and status = 'notCheckable' group by 1"))
def not_checkable_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.not_checkable_reasons(assessed(spark, sf_dir).items)


@query(over("""select hint, count(*) as items, min(number) as most_urgent, array_to_string(list_sort(list(number))[1:12], ',') as numbers
  from items where origin = 'own' and hint is not null group by hint"""))
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summary.recommendations(assessed(spark, sf_dir).items)
    return out.select("hint", "items", "most_urgent", F.array_join(F.transform("numbers", lambda x: x.cast("string")), ",").alias("numbers"))


@query(over("select number, risk, rule, loc_path from items where origin = 'own' order by number limit 25"))
def top_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.priorities(assessed(spark, sf_dir).items).select("number", "risk", "rule", "loc_path")


@query(over("select number, loc_path, occurrences, machines from items where origin = 'windows' order by occurrences desc, number limit 40"))
def windows_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.windows_components(assessed(spark, sf_dir).items).select("number", "loc_path", "occurrences", "machines")


@query(over("""select kind, high from (select kind, count(*) filter (risk = 'high') as high from items where origin = 'own' group by kind) where high > 0
  order by high desc, list_position(['scriptFile', 'scriptInvocation', 'shortcut', 'scheduledTask', 'autostart', 'service'], kind) limit 4"""))
def top_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = assessed(spark, sf_dir)
    return summary.top_kinds(summary.by_kind(a.items, a.occurrences)).select("kind", "high")


@query(over("""select number, array_to_string(list(hostname order by load_idx)[1:50], ',') as names, greatest(count(*) - 50, 0) as more
  from (select distinct number, o.load_idx, hostname from o join items using (item_key) join chosen c on o.load_idx = c.load_idx) group by number"""))
def machine_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = assessed(spark, sf_dir)
    return summary.machine_names(a.occurrences, a.machines).select("number", F.array_join("names", ",").alias("names"), F.col("more").cast("long").alias("more"))


@query(over("select number, c.hostname, o.loc_kind, o.loc_path, o.loc_item, o.target, o.activation, o.load_idx, o.pos from o join items using (item_key) join chosen c on o.load_idx = c.load_idx"))
def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = assessed(spark, sf_dir)
    return summary.locations(a.occurrences, a.machines).select("number", "hostname", "loc_kind", "loc_path", "loc_item", "target", "activation", "load_idx", "pos")


@query(over("""select load_idx, hostname, round(greatest(epoch(finished_at) - epoch(started_at), 0) / 60, 1) as minutes, coverage_mode,
  (select count(*) from all_findings x where x.load_idx = c.load_idx and status <> 'notCheckable') as detected, (select count(*) from all_findings x where x.load_idx = c.load_idx and status = 'notCheckable') as not_checkable from chosen c"""))
def machine_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.machine_rows(assessed(spark, sf_dir).machines).select("load_idx", "hostname", "minutes", "coverage_mode", "detected", "not_checkable")


_FOUND = """select number from items where origin = 'own' and risk = 'high' and (contains(lower(rule), 'job1') or item_key in (
  select item_key from o join chosen c on o.load_idx = c.load_idx where contains(lower(o.loc_path), 'job1') or contains(lower(o.loc_item), 'job1') or contains(lower(o.target), 'job1') or contains(lower(c.hostname), 'job1')))"""


@query(over(f"select number, risk, rule, kind, origin, machines, hostname as first_machine, i.loc_path, i.min_hours from items i join chosen c on i.machine = c.load_idx where number in ({_FOUND} order by number limit 50 offset 10)"))
def finding_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = assessed(spark, sf_dir)
    _, rows = finding_list.page(a.items, a.occurrences, a.machines, finding_list.Query(risk="high", search="JOB1", offset=10, limit=50), index=search_index.build(a))
    return rows.select("number", "risk", "rule", "kind", "origin", "machines", "first_machine", "loc_path", "min_hours")


_TERMS = ("host-12", "c", "netlogon", "vbs-3", "\\\\fs01", " Nightly ", "absent")
_MATCH = " or ".join(f"contains(lower(coalesce({c}, '')), trim(lower(s)))" for c in ("x.loc_path", "x.loc_item", "x.target", "c.hostname", "x.rule"))


@query(over(f"""select s as search, number from (values {', '.join(f"('{t}')" for t in _TERMS)}) terms(s), items i where item_key in (
  select x.item_key from o x join chosen c on x.load_idx = c.load_idx where {_MATCH})"""))
def finding_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items that each of some searches finds, through the index."""
    a = assessed(spark, sf_dir)
    index = search_index.build(a)
    found = [index.numbers(t).select(F.lit(t).alias("search"), "number") for t in _TERMS]
    return functools.reduce(DataFrame.union, found)


@query(over("select number, risk, machines, loc_path from items where origin = 'windows' and kind = 'scriptFile'"))
def finding_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = assessed(spark, sf_dir)
    return finding_list.matching(a.items, a.occurrences, a.machines, finding_list.Query(origin="windows", kind="scriptFile")).select("number", "risk", "machines", "loc_path")


@query(over("""select c.hostname, o.loc_path, o.activation, row_number() over (order by o.load_idx, o.loc_path, o.loc_item nulls first, pos) as "at"
  from o join items using (item_key) join chosen c on o.load_idx = c.load_idx where number = 1 order by 4 limit 200"""))
def finding_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = assessed(spark, sf_dir)
    out = finding_list.detail(a.items, a.occurrences, a.machines, a.links, 1)["occurrences"]
    return out.select("hostname", "loc_path", "activation", F.col("at").cast("long").alias("at"))


def _values(rows: list[tuple]) -> str:
    quote = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join(f"({', '.join(map(quote, r))})" for r in rows)


_OF_RULES = _values([(rule, place, name) for rule, names in catalog.RULE_SOURCES.items() for place, name in enumerate(names)])


@query(over(f"""select number, cast(place as bigint) as place, s.title, s.url from items i join (values {_OF_RULES}) r(rule, place, id) on i.rule = r.rule
  join (values {_values(catalog.SOURCES)}) s(id, publisher, title, url, checked) on r.id = s.id where origin = 'own'"""))
def finding_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = assessed(spark, sf_dir).own.select("number", "rule")
    return items.join(F.broadcast(catalog.rule_sources(spark)), "rule").select("number", "place", "title", "url")  # rows of the catalog


@query(fleet.plain(f"select count(*) as machines, count(*) filter (coverage_mode = 'full') as \"full\", count(*) filter (coverage_mode <> 'full') as limited from ({fleet.SCANS})"))
def coverage_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.modes(fleet.scans(spark, sf_dir))


@query(fleet.plain(f"select code, count(distinct load_idx) as machines from ({fleet.LIMITATIONS}) group by code"))
def limitation_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.limitation_codes(fleet.limitations(spark, sf_dir))


_STATUSES = ", ".join(f"count(*) filter (status = '{s}') as {s}" for s in ("complete", "partial", "skipped", "unavailable", "failed"))


@query(fleet.plain(f"select source, {_STATUSES}, count(*) filter (status not in ('complete', 'partial', 'skipped', 'unavailable', 'failed')) as other from ({fleet.SOURCES}) group by source"))
def source_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.source_statuses(fleet.sources(spark, sf_dir))


@query(fleet.plain(f"select cast(sum(entries) as bigint) as entries, cast(sum(inspected) as bigint) as inspected, cast(sum(errors) as bigint) as errors, cast(sum(skipped) as bigint) as skipped from ({fleet.SOURCES}) where source like 'files.%'"))
def file_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.file_totals(fleet.sources(spark, sf_dir))


_DAYS = "greatest(epoch(time_to) - epoch(time_from), 0) / 86400.0"


@query(fleet.plain(f"""select source, count(*) as reported, count(*) filter (ok) as read, min(case when ok then {_DAYS} end) as min_days, max(case when ok then {_DAYS} end) as max_days,
  min(case when ok then time_from end) as earliest, max(case when ok then time_to end) as latest
  from (select *, status in ('complete', 'partial') as ok from ({fleet.SOURCES})) where source like 'eventLog.%' group by source"""))
def log_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.log_spans(fleet.sources(spark, sf_dir))


@query(fleet.plain(f"""select load_idx, pos, concat('f', row_number() over (partition by load_idx order by
  coalesce(list_position(['scriptFile', 'scriptInvocation', 'shortcut', 'scheduledTask', 'autostart', 'service', 'wmiSubscription', 'logonScript', 'msiCustomAction', 'eventLogUsage', 'officeMacro', 'hardcodedCredential'], kind), 99),
  kind, loc_path, loc_item nulls first, rule, target nulls first, pos)) as finding_id from ({fleet.FINDINGS})"""))
def finding_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.finding_numbers(fleet.findings(spark, sf_dir).withColumn("evidence_line", F.lit(None).cast("int"))).select("load_idx", "pos", "finding_id")


@query(fleet.plain(f"""select load_idx, pos, path, starts_with(path, repeat(chr(92), 2)) as network, split_part(path, chr(92), -1) as name,
  case when contains(split_part(path, chr(92), -1), '.') then split_part(path, '.', -1) end as ext, contains(path, concat(chr(92), 'windows', chr(92), 'winsxs', chr(92))) as store
  from (select load_idx, pos, {norm('loc_path')} as path from ({fleet.FINDINGS}))"""))
def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fleet.findings(spark, sf_dir).select("load_idx", "pos", paths.normalize("loc_path").alias("path"))
    return p.select("load_idx", "pos", "path", paths.is_network("path").alias("network"), paths.file_name("path").alias("name"), paths.extension("path").alias("ext"), paths.is_windows_location("path").alias("store"))


@query("""select l_orderkey, l_linenumber, l_quantity, regexp_replace(case when t like '%.%' then regexp_replace(t, '0+$', '') else t end, '\\.$', '') as hours from (
  select l_orderkey, l_linenumber, l_quantity, case when h >= 10 then printf('%.0f', h) when h >= 1 then printf('%.1f', h) else printf('%.2f', h) end as t
  from (select *, l_quantity * 0.375 as h from lineitem))""")
def hours_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select("l_orderkey", "l_linenumber", "l_quantity", summary.format_hours(F.col("l_quantity") * 0.375).alias("hours"))


_SHEET = "cast((n - 1) // 1000 + 1 as integer) as sheet"


@query(over(f"select number, host as hostname, loc_path, n as row, {_SHEET} from (select number, c.hostname as host, o.loc_path, row_number() over (order by number, o.load_idx, o.loc_path, coalesce(o.loc_item, ''), o.pos) as n from o join items using (item_key) join chosen c on o.load_idx = c.load_idx)"))
def location_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every location on its sheet, a thousand rows each."""
    a = assessed(spark, sf_dir)
    return report.sheets(a, catalog.rules(spark), most_rows=1000)["locations"].select("number", "hostname", "loc_path", "row", "sheet")


_LOCALES = ("en_US.UTF-8", "de-AT", "fr_CA@euro", "pl", "PL_pl", "pt-PT", "ja-JP", "", "DE")
_LANG = "case l when 0 then 'en' when 1 then 'de' when 2 then 'fr' when 3 then 'pl' when 4 then 'pl' when 5 then 'pt-BR' when 8 then 'de' else 'en' end"


@query(f"""select o_orderkey, lang, case lang when 'de' then concat(n, ' Rechner') when 'fr' then concat(n, case when n <= 1 then ' machine' else ' machines' end)
    when 'pl' then concat(n, case when n = 1 then ' maszyna' when n % 10 between 2 and 4 and n % 100 not between 12 and 14 then ' maszyny' else ' maszyn' end)
    else concat(n, case when n = 1 then ' machine' else ' machines' end) end as machines,
  concat(n, case when lang = 'de' then case when n = 1 then ' Fund auf ' else ' Funde auf ' end else case when n = 1 then ' finding on ' else ' findings on ' end end, host) as findings
  from (select o_orderkey, o_custkey % 131 as n, {_LANG} as lang, concat(chr(123), 'n', chr(125), ' H', o_custkey) as host from (select *, o_orderkey % 9 as l from orders))""")
def messages_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in the languages of locales; values that look like placeholders stay as they are."""
    locales = F.array(*[F.lit(x) for x in _LOCALES])
    n = F.col("o_custkey") % 131
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", n.alias("n"), messages.negotiate(F.get(locales, (F.col("o_orderkey") % 9).cast("int"))).alias("lang"), F.concat(F.lit("{n} H"), F.col("o_custkey").cast("string")).alias("host"))
    return rows.select("o_orderkey", "lang", messages.REPORT.counted("lang", F.lit("machines"), "n").alias("machines"), messages.REPORT.counted("lang", F.lit("findings"), "n", host=F.col("host")).alias("findings"))
