"""What scans could see, and facts of machines, over rows derived from the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import coverage, detect, event_logs, finding_list, summary, system
from ..sources import catalog
from . import fleet
from .oracles import over
from .queries import assessed, query

_B = "chr(92)"


def _orders(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))


@query(fleet.plain(f"""with s as ({fleet.SOURCES}), each as (select source, load_idx, unnest(range(load_idx % 4)) as k from s)
select a.source, a.entries, a.inspected, a.errors, a.skipped, coalesce(b.samples, '') as samples
from (select source, cast(sum(entries) as bigint) as entries, cast(sum(inspected) as bigint) as inspected, cast(sum(errors) as bigint) as errors, cast(sum(skipped) as bigint) as skipped from s group by 1) a
left join (select source, string_agg(concat('e', load_idx, '-', k), ',' order by load_idx, k) as samples from (select *, row_number() over (partition by source order by load_idx, k) as n from each) where n <= 20 group by 1) b using (source)"""))
def counters_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of all scans by source, with the first twenty samples of errors."""
    sample = lambda k: F.concat(F.lit("e"), F.col("load_idx").cast("string"), F.lit("-"), k.cast("string"))
    rows = fleet.sources(spark, sf_dir).withColumns({"pos": F.col("load_idx"), "error_samples": F.transform(F.slice(F.array(*[F.lit(k) for k in range(3)]), F.lit(1), (F.col("load_idx") % 4).cast("int")), sample)})
    return coverage.merge_counters(rows, ["source"]).withColumn("samples", F.array_join("error_samples", ",")).drop("error_samples")


@query(fleet.plain(f"select load_idx, hostname from ({fleet.SCANS}) where coverage_mode <> 'full' order by load_idx limit 20"))
def limited_machines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.limited_machines(fleet.scans(spark, sf_dir)).select("load_idx", "hostname")


_REPORTS = """
select o_orderkey as load_idx, o_orderkey % 17 = 0 as panicked, case o_orderkey % 7 when 1 then 'unavailable' when 2 then 'skipped' end as declared, o_orderkey % 3 as errors, o_custkey % 2 = 0 as needs_admin, o_orderkey % 5 <> 0 as elevated from {orders}
"""


@query(f"""select load_idx, case when panicked then 'failed' when declared is not null then declared when errors > 0 or (needs_admin and not elevated) then 'partial' else 'complete' end as status from ({fleet.plain(_REPORTS)})""")
def source_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, _REPORTS).select("load_idx", detect.source_status().alias("status"))


@query("""select o_orderkey as load_idx, array_to_string(list_filter([case when o_orderkey % 11 = 0 then 'unsupportedPlatform' when o_orderkey % 5 = 0 then 'notElevated' end, case when o_orderkey % 7 = 0 then 'systemSourcesSkipped' end,
  case when o_custkey % 3 = 0 then 'fileScopeRestricted' end, case when o_orderkey % 4 = 0 or o_custkey % 5 = 1 then 'sourceIncomplete' end], lambda x: x is not null), ',') as codes from orders""")
def limitation_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of each scan from its rights, its scope and the states of its sources."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    states = F.create_map(
        F.lit("files.localDrives"), F.when(k % 2 == 0, "partial").otherwise("complete"), F.lit("tasks.scheduled"), F.when(k % 4 == 0, "partial").otherwise("complete"), F.lit("files.networkPaths"), F.when(c % 5 == 1, "failed").otherwise("skipped")
    )
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        k.alias("load_idx"), (k % 11 != 0).alias("supported"), (k % 5 != 0).alias("elevated"), (k % 7 != 0).alias("system_sources"), (c % 3 == 0).alias("restricted"), states.alias("statuses")
    )
    return rows.select("load_idx", F.array_join(detect.limitations(), ",").alias("codes"))


@query("select o_orderkey as load_idx, concat('S-1-5-', o_custkey) as sid from orders where o_orderkey % 3 <> 0")
def profiles_unloaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles whose hive isn't among the loaded ones, which spell their ids in lower case."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    profiles = orders.select(F.col("o_orderkey").alias("load_idx"), F.concat(F.lit("S-1-5-"), F.col("o_custkey").cast("string")).alias("sid"), F.lit("C:\\Users\\x").alias("folder"))
    loaded = profiles.where("load_idx % 3 = 0").select("load_idx", F.lower("sid").alias("sid"))
    return system.unloaded_profiles(profiles, loaded.union(loaded)).select("load_idx", "sid")


@query("""with e as (select user_id as load_idx, event_type as q, ts from events), c as (select load_idx, min(ts) as o, max(ts) as n from e group by 1),
capped as (select load_idx, max(oldest) as oldest from (select load_idx, q, min(ts) as oldest, count(*) as n from e group by all) where n >= 4 group by 1)
select c.load_idx, greatest(o, coalesce(oldest, o)) as time_from, n as time_to from c left join capped using (load_idx)""")
def event_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all queries of a machine's log saw whole, if each reads four records at most."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("load_idx"), F.col("event_type").alias("query"), F.col("ts").cast("timestamp").alias("time"))
    channels = e.groupBy("load_idx").agg(F.min("time").alias("oldest"), F.max("time").alias("newest"))
    return event_logs.covered(channels, e, most=4)


_PLACES = f"""
select o_orderkey, case o_orderkey % 9 when 0 then concat('C:', {_B}, 'Windows', {_B}, 'servicing', {_B}, 'x.vbs') when 1 then concat('c:/WINDOWS/SoftwareDistribution/d', cast(o_custkey as string), '.vbs')
  when 2 then concat('C:', {_B}, 'Windows', {_B}, 'System32', {_B}, 'LogFiles', {_B}, 'SUM', {_B}, 'Current.mdb') when 3 then concat('C:', {_B}, 'Windows', {_B}, 'System32', {_B}, 'LogFiles', {_B}, 'SUM', {_B}, 'a.vbs')
  when 4 then concat('C:', {_B}, 'ProgramData', {_B}, 'docker', {_B}, 'windowsfilter', {_B}, 'a1', {_B}, 'Files', {_B}, 'Windows', {_B}, 'x.vbs') when 5 then concat('C:', {_B}, 'docker', {_B}, 'windowsfilter', {_B}, 'a1', {_B}, 'UtilityVM', {_B}, 'Files', {_B}, 'Windows', {_B}, 'x.vbs')
  when 6 then concat('C:', {_B}, 'docker', {_B}, 'windowsfilter', {_B}, 'a1', {_B}, 'Files', {_B}, 'App', {_B}, 'x.vbs') when 7 then concat('C:', {_B}, 'Windows', {_B}, 'WinSxS', {_B}, 'a', {_B}, 'x.vbs') else concat('C:', {_B}, 'Windows', {_B}, 'System32', {_B}, 'x.vbs') end as path
from {{orders}}
"""


@query("select o_orderkey, o_orderkey % 9 in (0, 1, 2, 4, 5, 7) as windows, o_orderkey % 9 = 7 as store from orders")
def system_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _orders(spark, sf_dir, _PLACES).select("o_orderkey", paths.normalize("path").alias("p"))
    return p.select("o_orderkey", paths.is_windows_location("p").alias("windows"), paths.in_component_store("p").alias("store"))


@query("""select o_orderkey, sha256(concat('fleet:', lower(concat('AB', o_orderkey, '-Cd')))) as machine_id,
  case when o_custkey % 3 = 0 and o_orderkey % 2 = 0 then 'Windows 11 Pro' else 'Windows 10 Pro' end as name from orders""")
def machine_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids from GUIDs whatever their case and blanks, and names of systems that still call themselves by the one before."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    guid = F.concat(F.lit(" AB"), k.cast("string"), F.lit("-Cd "))
    build, kind = F.when(c % 3 == 0, 22631).otherwise(19045), F.when(k % 2 == 0, "workstation").otherwise("server")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return rows.select("o_orderkey", system.machine_id(guid, "fleet:").alias("machine_id"), system.os_name(F.lit("Windows 10 Pro"), build, kind).alias("name"))


@query("select o_orderkey, o_orderkey % 6 in (0, 1, 2) as servicing from orders")
def servicing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed and delta files of the update store, told by their first bytes."""
    heads = [b"DCM\x01abc", b"PA30abcd\x03efg", b"xxxxPA31\x08bcd", b"DCM\x02abc", b"PA30abcdefghi", b"PA32\x01"]
    head = F.get(F.array(*[F.lit(h) for h in heads]), (F.col("o_orderkey") % 6).cast("int"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", text.is_servicing_column(head).alias("servicing"))


@query(over("""select number, effort_kind = 'windows' as windows, case when effort_kind = 'sameAs' then coalesce(same_as, 0) else 0 end as same_as, case when effort_kind = 'hours' then factor else 1 end as size_factor,
  effort_kind = 'hours' and typical_script as typical_script, effort_kind = 'hours' and machines > 1 as counted_once from items"""))
def effort_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each item's effort includes, as its detail view tells."""
    notes = assessed(spark, sf_dir).items.select("number", finding_list.effort_note().alias("x")).select("number", "x.*")
    return notes.withColumn("same_as", F.coalesce("same_as", F.lit(0)))


_MODULES = ", ".join(f"('{name}', '{rule}', {str(admin).lower()})" for name, _, own, fallback, admin in catalog.MODULES for rule in (*own, fallback))


@query(fleet.plain(f"select module, count(*) as findings, count(distinct load_idx) as scans, bool_or(needs_admin) as needs_admin from ({fleet.FINDINGS}) f join (values {_MODULES}) m(module, rule, needs_admin) on f.rule = m.rule group by module"))
def findings_by_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the rules that each module reports."""
    rules = catalog.module_rules(spark).join(catalog.modules(spark).select("module", "needs_admin"), "module")
    found = fleet.findings(spark, sf_dir).select("load_idx", "rule").join(F.broadcast(rules), "rule")  # rows of the catalog
    return found.groupBy("module").agg(F.count("*").alias("findings"), F.count_distinct("load_idx").alias("scans"), F.bool_or("needs_admin").alias("needs_admin"))


_PUBLISHED = ", ".join(f"('{rule}', '{catalog.PUBLISHED.get(name, '')}')" for rule, names in catalog.RULE_SOURCES.items() for name in names)


@query(over(f"select number, count(*) as sources, max(published) as newest from items i join (values {_PUBLISHED}) p(rule, published) on i.rule = p.rule group by number"))
def finding_source_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sources speak of each item's rule, and when the newest dated one was published."""
    sources = catalog.rule_sources(spark)
    found = assessed(spark, sf_dir).items.select("number", "rule").join(F.broadcast(sources), "rule")  # rows of the catalog
    return found.groupBy("number").agg(F.count("*").alias("sources"), F.coalesce(F.max("published"), F.lit("")).alias("newest"))
