"""Detectors of system entries over tasks, registry values and consumers derived from the order tables, and what they have to find in plain SQL.

The tables' SQL runs in Spark and in DuckDB, as in fleet.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import detect, system
from .queries import query

_B = "chr(92)"


_J = f"concat('C:', {_B}, 'Jobs', {_B}, 'J', cast(o_custkey % 50 as string), '.vbs')"
_RUN = f"concat('C:', {_B}, 'Jobs', {_B}, 'run', cast(o_custkey % 3 as string), '.cmd')"
_LOCKED = f"concat('C:', {_B}, 'Jobs', {_B}, 'locked.cmd')"
_INNER = f"concat('C:', {_B}, 'Jobs', {_B}, 'inner.vbs')"
_SHOW = ["load_idx", "loc_path", "loc_item", "rule", "status", "reason", "activation", "target"]
_FOUND = "load_idx, loc_path, loc_item, rule, case when reason = '' then 'detected' else 'notCheckable' end as status, reason, activation, target"


def _run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))


def _shown(found: DataFrame) -> DataFrame:
    """Null as an empty text, which both engines compare alike."""
    text = {c: F.coalesce(c, F.lit("")) for c in ("loc_item", "reason", "target")}
    return found.withColumns(text).select(*_SHOW)


TASKS = f"""
select o_orderkey as load_idx, concat({_B}, 'Sets', {_B}, 'T', cast(o_orderkey as string)) as path,
  case when o_custkey % 7 = 3 then 'no definition at all' else concat('<?xml version="1.0"?><Task><Triggers><LogonTrigger><Enabled>false</Enabled></LogonTrigger></Triggers><Settings><Enabled>',
    case when o_orderkey % 5 = 0 then 'false' else 'true' end, '</Enabled></Settings><Actions><Exec><Command>',
    case o_custkey % 7 when 0 then 'wscript.exe' when 1 then {_RUN} when 2 then 'notepad.exe' when 4 then {_LOCKED} when 5 then 'wscript' else {_RUN} end, '</Command><Arguments>',
    case o_custkey % 7 when 0 then concat('//B ', {_J}) when 5 then concat('C:', {_B}, 'Jobs', {_B}, 'all.wsf') else '' end, '</Arguments></Exec></Actions></Task>') end as content,
  case when o_custkey % 11 = 0 then 'accessDenied' end as problem
from {{orders}}
"""
CALLED = f"""
select o_orderkey as load_idx, {_RUN} as path, concat('@echo off', chr(10), 'rem wscript no.vbs', chr(10), 'cscript //nologo ', {_INNER}, chr(10)) as content, cast(null as string) as problem from {{orders}} where o_custkey % 7 = 1
union all select o_orderkey, {_LOCKED}, cast(null as string), 'locked' from {{orders}}
"""


def called_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, CALLED).withColumn("content", F.encode("content", "utf-8"))


@query(f"""select {_FOUND} from (
  select o_orderkey as load_idx, concat({_B}, 'Sets', {_B}, 'T', cast(o_orderkey as varchar)) as loc_path, '' as loc_item, o_custkey % 7 as kind, o_custkey % 11 = 0 as denied,
    case when denied or kind in (3, 4) then 'VBS-300' when kind = 5 then 'VBS-302' else 'VBS-301' end as rule,
    case when denied then 'accessDenied' when kind = 3 then 'corrupt' when kind = 4 then 'locked' else '' end as reason,
    case when denied or kind = 3 or o_orderkey % 5 = 0 then 'dormant' else 'automatic' end as activation,
    case when denied or kind = 3 then '' when kind = 0 then {_J} when kind = 1 then {_RUN} when kind = 4 then {_LOCKED} else concat('C:', {_B}, 'Jobs', {_B}, 'all.wsf') end as target
  from orders) where denied or kind in (0, 1, 3, 4, 5)""")
def task_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = _run(spark, sf_dir, TASKS).withColumn("content", F.encode("content", "utf-8"))
    tasks = tasks.repartition(4 * spark.sparkContext.defaultParallelism)  # definitions take far longer to read than orders
    return _shown(detect.detect_tasks(tasks, called_files(spark, sf_dir)))


_CURRENT = f"'Microsoft', {_B}, 'Windows', {_B}, 'CurrentVersion', {_B}"
_NT = f"'Microsoft', {_B}, 'Windows NT', {_B}, 'CurrentVersion', {_B}"
REGISTRY = f"""
select o_orderkey as load_idx, case when o_custkey % 6 = 2 then 'HKU' else 'HKLM' end as hive, case when o_custkey % 6 = 1 then 'wow32' else 'native' end as view,
  case o_custkey % 6 when 1 then concat('SOFTWARE', {_B}, {_CURRENT}, 'RunOnce') when 2 then concat('S-1-5-7', {_B}, 'Software', {_B}, {_NT}, 'Windows')
    when 3 then concat('SOFTWARE', {_B}, {_NT}, 'Winlogon') else concat('SOFTWARE', {_B}, {_CURRENT}, 'Run') end as key,
  case o_custkey % 6 when 2 then 'Load' when 3 then 'Userinit' else concat('Agent', cast(o_custkey % 4 as string)) end as name,
  case o_custkey % 6 when 3 then concat('C:', {_B}, 'Windows', {_B}, 'userinit.exe,cscript ', {_J}) when 4 then 'notepad.exe' when 5 then {_RUN} else concat('wscript //B ', {_J}) end as value, false as offline
from {{orders}}
"""


@query(f"""select {_FOUND} from (
  select o_orderkey as load_idx, o_custkey % 6 as kind,
    case kind when 1 then concat('HKLM', {_B}, 'SOFTWARE', {_B}, 'WOW6432Node', {_B}, {_CURRENT}, 'RunOnce') when 2 then concat('HKU', {_B}, 'S-1-5-7', {_B}, 'Software', {_B}, {_NT}, 'Windows')
      when 3 then concat('HKLM', {_B}, 'SOFTWARE', {_B}, {_NT}, 'Winlogon') else concat('HKLM', {_B}, 'SOFTWARE', {_B}, {_CURRENT}, 'Run') end as loc_path,
    case kind when 2 then 'Load' when 3 then 'Userinit' else concat('Agent', cast(o_custkey % 4 as varchar)) end as loc_item,
    'VBS-311' as rule, '' as reason, 'automatic' as activation, case when kind = 5 then {_RUN} else {_J} end as target
  from orders) x where kind < 4 or kind = 5 and load_idx in (select o_orderkey from orders where o_custkey % 7 = 1)""")
def autostart_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = _run(spark, sf_dir, REGISTRY)
    return _shown(detect.detect_commands(system.autostart(registry), "VBS-311", "VBS-312", "autostart", called_files(spark, sf_dir)))


_SERVICE = f"concat('SYSTEM', {_B}, 'CurrentControlSet', {_B}, 'Services', {_B}, 'Svc', cast(o_custkey as string)"
_VALUES = [
    ("", "Type", "case when o_custkey % 7 = 0 then '1' else '16' end"), ("", "Start", "cast(o_custkey % 5 as string)"),
    ("", "ImagePath", f"case when o_custkey % 3 = 0 then concat('cscript.exe //B ', {_J}) else concat({_B}, 'SystemRoot', {_B}, 'System32', {_B}, 'host.exe') end"),
    ("", "FailureCommand", f"case when o_custkey % 4 = 0 then concat('wscript ', {_J}) else '' end"),
    ("Parameters", "Application", "case when o_custkey % 9 = 1 then 'cscript.exe' else '' end"), ("Parameters", "AppParameters", _J),
]
SERVICES = " union all ".join(
    f"select o_orderkey as load_idx, 'HKLM' as hive, 'native' as view, {_SERVICE}{f', {_B}, {key!r}' if key else ''}) as key, '{name}' as name, {value} as value, false as offline from {{orders}}" for key, name, value in _VALUES
)


@query(f"""select {_FOUND} from (
  select o_orderkey as load_idx, concat('Svc', cast(o_custkey as varchar)) as loc_path, item as loc_item, 'VBS-321' as rule, '' as reason,
    case when o_custkey % 5 < 3 then 'automatic' when o_custkey % 5 = 4 then 'dormant' else 'manual' end as activation, {_J} as target
  from orders cross join (values ('ImagePath'), ('FailureCommand'), ('Parameters{chr(92)}Application')) t(item)
  where o_custkey % 7 <> 0 and (item = 'ImagePath' and o_custkey % 3 = 0 or item = 'FailureCommand' and o_custkey % 4 = 0 or starts_with(item, 'Parameters') and o_custkey % 9 = 1))""")
def service_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = system.services(_run(spark, sf_dir, SERVICES))
    return _shown(detect.detect_commands(found, "VBS-321", "VBS-322", "services"))


_POLICY = f"{_CURRENT}, 'Group Policy', {_B}, 'Scripts', {_B}, 'Startup', {_B}, '0'"
_SYS = f"concat({_B}, {_B}, 'dc', {_B}, 'SysVol', {_B}, 'P', cast(o_custkey % 4 as string), {_B}, 'Machine')"
LOGON = f"""
select o_orderkey as load_idx, 'HKLM' as hive, 'native' as view, concat('SOFTWARE', {_B}, {_POLICY}) as key, 'FileSysPath' as name, {_SYS} as value, false as offline from {{orders}} where o_custkey % 3 = 0
union all select o_orderkey, 'HKLM', 'native', concat('SOFTWARE', {_B}, {_POLICY}, {_B}, '0'), 'Script', case when o_custkey % 2 = 0 then 'map.vbs' else {_J} end, false from {{orders}} where o_custkey % 3 = 0
union all select o_orderkey, 'HKLM', 'native', concat('SOFTWARE', {_B}, {_POLICY}, {_B}, '0'), 'Parameters', '/all', false from {{orders}} where o_custkey % 3 = 0
union all select o_orderkey, 'HKU', 'native', concat('S-1-5-8', {_B}, 'Environment'), 'UserInitMprLogonScript', concat('wscript ', {_J}), false from {{orders}} where o_custkey % 3 = 1
"""


@query(f"""select {_FOUND} from (
  select o_orderkey as load_idx, case when o_custkey % 3 = 0 then concat('HKLM', {_B}, 'SOFTWARE', {_B}, {_POLICY}, {_B}, '0') else concat('HKU', {_B}, 'S-1-5-8', {_B}, 'Environment') end as loc_path,
    case when o_custkey % 3 = 0 then '' else 'UserInitMprLogonScript' end as loc_item, 'VBS-341' as rule, '' as reason, 'automatic' as activation,
    case when o_custkey % 6 = 0 then concat({_SYS}, {_B}, 'Scripts', {_B}, 'Startup', {_B}, 'map.vbs') else {_J} end as target
  from orders where o_custkey % 3 < 2)""")
def logon_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = system.logon_scripts(_run(spark, sf_dir, LOGON))
    return _shown(detect.detect_commands(found, "VBS-341", "VBS-342", "logonScripts"))


WMI = f"""
select o_orderkey as load_idx, concat('ROOT', {_B}, 'subscription') as namespace, 'CommandLineEventConsumer' as class, 'CommandLineEventConsumer.Name="C1"' as path,
  map('CommandLineTemplate', concat('cscript //B ', {_J})) as properties from {{orders}} where o_custkey % 3 < 2
union all select o_orderkey, concat('ROOT', {_B}, 'subscription'), 'ActiveScriptEventConsumer', 'ActiveScriptEventConsumer.Name="A1"',
  map('ScriptingEngine', case when o_custkey % 2 = 0 then 'VBScript' else 'JScript' end, 'ScriptFileName', {_J}) from {{orders}}
union all select o_orderkey, concat('ROOT', {_B}, 'subscription'), '__FilterToConsumerBinding', '__FilterToConsumerBinding.Consumer=1',
  map('Consumer', concat({_B}, {_B}, '.', {_B}, 'root', {_B}, 'subscription:CommandLineEventConsumer.Name="C1"'), 'Filter', '__EventFilter.Name="F"') from {{orders}} where o_custkey % 3 = 1
"""


@query(f"""select {_FOUND} from (
  select o_orderkey as load_idx, concat('ROOT', {_B}, 'subscription:CommandLineEventConsumer.Name="C1"') as loc_path, '' as loc_item, 'VBS-331' as rule, '' as reason, case when o_custkey % 3 = 1 then 'automatic' else 'dormant' end as activation, {_J} as target from orders where o_custkey % 3 < 2
  union all select o_orderkey, concat('ROOT', {_B}, 'subscription:ActiveScriptEventConsumer.Name="A1"'), '', 'VBS-331', '', 'dormant', {_J} from orders where o_custkey % 2 = 0)""")
def wmi_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = spark.createDataFrame([], "load_idx long, hive string, view string, key string, name string, value string, offline boolean")
    return _shown(system.detect_all(none, _run(spark, sf_dir, WMI)))


_STARTUP = f"concat('C:', {_B}, 'Users', {_B}, 'u', {_B}, 'Start Menu', {_B}, 'Programs', {_B}, 'Startup', {_B}, 's', cast(o_orderkey as string), case o_custkey % 6 when 0 then '.vbs' when 1 then '.cmd' when 2 then '.wsf' when 3 then '.lnk' when 4 then '.ps1' else '.txt' end)"
STARTUP = f"""
select o_orderkey as load_idx, {_STARTUP} as path,
  case o_custkey % 6 when 1 then concat('echo', chr(10), 'wscript ', {_J}, chr(10)) when 2 then concat('<job><script language="', case when o_custkey % 4 = 0 then 'VBScript' else 'JScript' end, '">x = 1</script></job>') else 'x = 1' end as content,
  case when o_custkey % 7 = 0 then 'locked' end as problem
from {{orders}}
"""


@query(f"""select {_FOUND} from (
  select o_orderkey as load_idx, {_STARTUP} as loc_path, '' as loc_item, o_custkey % 6 as kind, o_custkey % 7 = 0 as closed,
    case when kind = 3 or kind <> 0 and closed then 'VBS-300' else 'VBS-311' end as rule, case when kind = 3 and not closed then 'corrupt' when kind <> 0 and closed then 'locked' else '' end as reason,
    'automatic' as activation, case when kind in (0, 1) or kind = 2 and not closed or kind = 4 then loc_path else '' end as target
  from orders where kind = 0 or kind = 1 or kind = 2 and (closed or o_custkey % 4 = 0) or kind = 3 or kind = 4 and closed)""")
def startup_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _run(spark, sf_dir, STARTUP).withColumns({"content": F.encode("content", "utf-8"), "size": F.octet_length("content").cast("long")})
    return _shown(detect.detect_startup(files))


_NAMED = f"""select l_orderkey, l_linenumber, l_partkey, l_suppkey, case l_partkey % 9 when 0 then concat('C:', {_B}, 'x.vbs') when 1 then concat({_B}, {_B}, '?', {_B}, 'D:', {_B}, 'x.vbs') when 2 then '//server/share/x.vbs'
  when 3 then concat({_B}, {_B}, '?', {_B}, 'UNC', {_B}, 'server', {_B}, 'share', {_B}, 'x.vbs') when 4 then concat({_B}, {_B}, '.', {_B}, 'pipe', {_B}, 'x') when 5 then concat({_B}, {_B}, '?', {_B}, 'Volume1', {_B}, 'x.vbs')
  when 6 then 'x.vbs' when 7 then 'C:x.vbs' else concat({_B}, 'x.vbs') end as path from {{lineitem}}"""


@query(f"""select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_partkey % 9 in (2, 3) then 'networkPath' when l_partkey % 9 in (4, 5) then 'devicePath' when l_partkey % 9 > 5 then 'relativePath' else 'local' end as refused from lineitem""")
def path_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_NAMED, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.coalesce(paths.refusal("path"), F.lit("local")).alias("refused"))
