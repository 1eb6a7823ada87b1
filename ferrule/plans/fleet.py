"""A fleet of machines derived from the order tables, for queries that need scans.

Customers are machines, orders their scans, line items the findings.  The SQL
runs in Spark and in DuckDB; `{orders}` and `{lineitem}` stand for the tables.
Backslashes are written chr(92), as the two dialects read them differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCANS = """
select o_orderkey as load_idx,
  concat('scan-', lpad(cast(o_orderkey as string), 9, '0'), '.zip') as file,
  concat('id-', cast(o_orderkey as string)) as scan_id,
  concat('HOST-', cast(o_custkey as string)) as hostname,
  case when o_custkey % 5 = 0 then null else concat('Corp', cast(o_custkey % 3 as string), '.example') end as domain,
  case when o_custkey % 7 = 0 then null else concat('id-', cast(o_custkey as string)) end as machine_id,
  cast(o_orderdate as timestamp) as started_at,
  cast(o_orderdate as timestamp) + interval '10' minute + o_orderkey % 50 * interval '7' second as finished_at,
  case when o_orderpriority = '1-URGENT' then 'limited' when o_orderpriority = '2-HIGH' then 'later' else 'full' end as coverage_mode
from {orders}
"""

_B = "chr(92)"
_SCRIPT = f"concat('C:', {_B}, 'Scripts', {_B}, 'Job', cast(s % 3 as string), '.vbs')"
_SHARED = f"concat({_B}, {_B}, 'FS0', cast(s % 4 as string), {_B}, 'netlogon', {_B}, 'Logon', cast(k % 20 as string), '.vbs')"

FINDINGS = f"""
select load_idx, pos, concat('f', cast(pos as string)) as finding_id,
  case b when 0 then 'VBS-101' when 1 then 'VBS-101' when 2 then 'VBS-301' when 3 then 'VBS-201' when 4 then 'VBS-311' when 5 then 'VBS-104'
    when 6 then 'VBS-104' when 7 then 'VBS-600' when 8 then 'VBS-601' when 9 then 'VBS-901' when 10 then 'VBS-321' else 'VBS-999' end as rule,
  case b when 0 then 'scriptFile' when 1 then 'scriptFile' when 2 then 'scheduledTask' when 3 then 'scriptInvocation' when 4 then 'autostart' when 5 then 'scriptFile'
    when 6 then 'scriptFile' when 7 then 'officeMacro' when 8 then 'officeMacro' when 9 then 'hardcodedCredential' when 10 then 'service' else 'laterKind' end as kind,
  case when b in (7, 9) then 'review' when b = 11 then 'later' else 'breaks' end as classification,
  case when b = 7 then 'notCheckable' else 'detected' end as status,
  case when b = 7 then case k % 3 when 0 then 'passwordProtected' when 1 then 'locked' else 'corrupt' end end as reason,
  case b when 2 then case when k % 4 = 0 then 'dormant' else 'automatic' end when 3 then 'manual' when 4 then 'automatic' when 8 then 'macro'
    when 10 then case k % 3 when 0 then 'automatic' when 1 then 'manual' else 'dormant' end when 11 then 'later' else 'dormant' end as activation,
  case b when 2 then 'scheduledTask' when 4 then 'registry' when 10 then 'service' else 'file' end as loc_kind,
  case b
    when 0 then {_SCRIPT}
    when 1 then {_SHARED}
    when 2 then concat({_B}, 'Nightly', {_B}, 'Task ', cast(k % 60 as string))
    when 3 then concat('"C:/Batch/Run', cast(s % 5 as string), '.bat"')
    when 4 then concat('HKLM', {_B}, 'Software', {_B}, 'Run', {_B}, {_B})
    when 5 then concat('C:', {_B}, 'Windows', {_B}, 'WinSxS', {_B}, 'amd64_', cast(s % 9 as string), {_B}, 'Comp', cast(k % 40 as string), '.wsc')
    when 6 then concat({_B}, {_B}, '?', {_B}, 'D:', {_B}, 'App', cast(s % 6 as string), {_B}, 'Comp', cast(k % 80 as string), '.wsc')
    when 7 then concat('D:', {_B}, 'Books', {_B}, 'Plan', cast(k % 90 as string), '.xlsm')
    when 8 then concat({_B}, {_B}, '?', {_B}, 'UNC', {_B}, 'FS01', {_B}, 'books', {_B}, 'Plan', cast(k % 50 as string), '.xlsm')
    when 9 then {_SCRIPT}
    when 10 then concat('Svc', cast(k % 30 as string))
    else concat('E:', {_B}, 'New', cast(k % 10 as string), {_B}) end as loc_path,
  case when b = 4 then concat('Entry', cast(k % 8 as string)) when b = 8 then concat('Module', cast(s % 3 as string)) end as loc_item,
  case when b = 2 then case k % 3 when 0 then {_SCRIPT} when 1 then {_SHARED} else concat('%ScriptDir%', {_B}, 'job', cast(s % 3 as string), '.VBS') end
    when b = 3 then concat('job', cast(s % 3 as string), '.vbs')
    when b = 4 then {_SHARED}
    when b = 10 and k % 2 = 0 then concat('C:', {_B}, 'Services', {_B}, 'Svc', cast(k % 30 as string), '.vbs') end as target,
  case when b in (0, 1, 5, 6, 8) then (k * 7919) % 200000 end as file_size,
  case when b in (0, 1) then md5(concat('s', cast(k % 150 as string))) when b in (5, 6) then md5(concat('c', cast(k % 80 as string))) when b = 8 then md5(concat('m', cast(k % 25 as string))) end as sha256
from (
  select o_orderkey as load_idx, l_partkey as k, l_suppkey as s, l_partkey % 12 as b,
    cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as bigint) as pos
  from {{lineitem}} join {{orders}} on l_orderkey = o_orderkey
) as line
"""

SOURCES = """
select load_idx, source, case status when 0 then 'partial' when 1 then 'skipped' when 2 then 'failed' when 3 then 'unavailable' when 4 then 'later' else 'complete' end as status,
  n * 13 % 1000 as entries, n * 7 % 100 as inspected, n % 5 as errors, n % 11 as skipped,
  case when source like 'eventLog.%' then cast(o_orderdate as timestamp) - n % 40 * interval '1' day end as time_from,
  case when source like 'eventLog.%' then cast(o_orderdate as timestamp) - n % 3 * interval '1' day end as time_to
from (
  select o_orderkey as load_idx, o_orderdate, source, o_orderkey + place as n, (o_orderkey + place) % 12 as status
  from {orders} cross join (
    select 'files.localDrives' as source, 1 as place union all select 'files.networkPaths', 2 union all select 'tasks', 3
    union all select 'eventLog.sysmon', 4 union all select 'eventLog.deprecation', 5
  ) as kinds
) as each
"""

LIMITATIONS = """
select o_orderkey as load_idx, case o_orderkey % 4 when 0 then 'notElevated' when 1 then 'sourceIncomplete' else 'fileScopeRestricted' end as code from {orders} where o_orderpriority in ('1-URGENT', '2-HIGH')
union all select o_orderkey, 'notElevated' from {orders} where o_orderkey % 8 = 0
"""


#: Lines of a task.  What is shuffled of a line is a small part of what it takes in a sort, so sizes don't tell.
LINES = 250_000


def _dealt(lines: DataFrame) -> DataFrame:
    """Line items by order, in as many parts as LINES asks for; AQE's parts of like bytes do where there are few."""
    spark = lines.sparkSession
    parts = -(-lines.count() // LINES)
    if parts <= spark.sparkContext.defaultParallelism:
        return lines
    return lines.repartition(max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))), "l_orderkey")


def _run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    tables = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("orders", "lineitem") if f"{{{name}}}" in sql}
    if "lineitem" in tables:
        tables["lineitem"] = _dealt(tables["lineitem"])
    return spark.sql(sql, **tables)


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, SCANS)


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, FINDINGS)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, SOURCES)


def limitations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, LIMITATIONS)


def plain(sql: str) -> str:
    """For an engine in which the tables are views of their names."""
    return sql.replace("{orders}", "orders").replace("{lineitem}", "lineitem")
