"""A synthetic organization of any size, as tables or as containers in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import container

#: Findings by role: number, rule, kind, place, target, activation.  {m} is the machine, {s} one of its servers.
BASE = """
select m as load_idx, k as pos, concat('f', cast(k + 1 as string)) as finding_id, rule, kind, classification, status, reason, activation, loc_kind, loc_path, loc_item, target, file_size, sha256
from (
  select m, 0 as k, 'VBS-101' as rule, 'scriptFile' as kind, 'breaks' as classification, 'detected' as status, cast(null as string) as reason, 'dormant' as activation, 'file' as loc_kind,
    r'\\\\dc01\\netlogon\\logon.vbs' as loc_path, cast(null as string) as loc_item, cast(null as string) as target, 4000L as file_size, 'logon' as sha256 from {machines}
  union all select m, 1, 'VBS-341', 'logonScript', 'breaks', 'detected', null, 'automatic', 'registry', r'HKLM\\Software\\Policies\\Scripts\\Logon', '0', r'\\\\DC01\\NETLOGON\\Logon.vbs', null, null from {machines}
  union all select m, 2, 'VBS-104', 'scriptFile', 'breaks', 'detected', null, 'dormant', 'file', r'C:\\Windows\\WinSxS\\amd64_tools\\winrm.wsc', null, null, 204000L, 'winrm' from {machines}
  union all select m, 3, 'VBS-104', 'scriptFile', 'breaks', 'detected', null, 'dormant', 'file', r'C:\\Windows\\System32\\winrm.wsc', null, null, 204000L, 'winrm' from {machines}
  union all select m, 4, 'VBS-311', 'autostart', 'breaks', 'detected', null, 'automatic', 'registry', r'HKCU\\Software\\Run', concat('Agent', cast(m % 5 as string)), r'%ProgramData%\\agent.vbs', null, null from {machines} where m % 3 = 0
  union all select m, 5, 'VBS-600', 'officeMacro', 'review', 'notCheckable', 'passwordProtected', 'dormant', 'file', concat(r'D:\\Books\\Plan', cast(m as string), '.xlsm'), null, null, 90000L, concat('x', cast(m as string)) from {machines} where m % 4 = 0
  union all select m, 6, 'VBS-601', 'officeMacro', 'breaks', 'detected', null, 'macro', 'file', r'\\\\fs01\\books\\Offer.xlsm', 'Module1', null, 120000L, 'offer' from {machines} where m % 2 = 0
  union all select m, 7, 'VBS-301', 'scheduledTask', 'breaks', 'detected', null, 'automatic', 'scheduledTask', r'\\Backup', null, r'C:\\Scripts\\backup.vbs', null, null from {machines} where m % 10 = 0
  union all select m, 8, 'VBS-101', 'scriptFile', 'breaks', 'detected', null, 'dormant', 'file', r'C:\\Scripts\\backup.vbs', null, null, 30000L, concat('backup', cast(m % 3 as string)) from {machines} where m % 10 = 0
  union all select m, 9, 'VBS-901', 'hardcodedCredential', 'review', 'detected', null, 'dormant', 'file', r'C:\\Scripts\\backup.vbs', null, null, null, null from {machines} where m % 10 = 0
  union all select m, 10, 'VBS-321', 'service', 'breaks', 'detected', null, 'manual', 'service', 'Inventory', null, r'C:\\Tools\\inventory.vbs', null, null from {machines} where m % 10 = 0
)
"""

EXTRA = """
select m as load_idx, 100 + e as pos, concat('x', cast(e as string)) as finding_id, 'VBS-101' as rule, 'scriptFile' as kind, 'breaks' as classification, 'detected' as status, cast(null as string) as reason,
  'dormant' as activation, 'file' as loc_kind,
  case when e % 4 = 0 then concat(r'C:\\Windows\\WinSxS\\part', cast(e % 60 as string), r'\\tool.vbs') when e % 4 = 1 then concat(r'C:\\Deploy\\job', cast(e % 80 as string), '.vbs')
    else concat(r'C:\\Users\\u', cast(m as string), r'\\s', cast(e as string), '.vbs') end as loc_path,
  cast(null as string) as loc_item, cast(null as string) as target, 1000L * (e % 200) as file_size,
  case when e % 4 = 0 then concat('w', cast(e % 60 as string)) when e % 4 = 1 then concat('d', cast(e % 80 as string)) else concat('u', cast(m as string), '-', cast(e as string)) end as sha256
from (select m, explode(sequence(0L, {extra}L - 1)) as e from {machines})
"""


def organization(spark: SparkSession, machines: int, extra: int = 0) -> tuple[DataFrame, DataFrame]:
    """Scans and findings of `machines` machines; `extra` more scripts on each."""
    m = spark.range(machines).withColumnRenamed("id", "m")
    scans = m.select(
        F.col("m").alias("load_idx"),
        F.format_string("scan-%06d.zip", "m").alias("file"),
        F.concat(F.lit("id-"), F.col("m").cast("string")).alias("scan_id"),
        F.concat(F.when(F.col("m") % 10 == 0, "SRV-").otherwise("PC-"), F.col("m").cast("string")).alias("hostname"),
        F.lit("corp.example").alias("domain"),
        F.concat(F.lit("id-"), F.col("m").cast("string")).alias("machine_id"),
        F.lit("2026-01-01 08:00:00").cast("timestamp").alias("started_at"),
        F.lit("2026-01-01 08:09:00").cast("timestamp").alias("finished_at"),
        F.when(F.col("m") % 13 == 12, "limited").otherwise("full").alias("coverage_mode"),
    )
    findings = spark.sql(BASE, machines=m)
    if extra:
        findings = findings.unionByName(spark.sql(EXTRA.replace("{extra}", str(extra)), machines=m))
    return scans, findings


def write_containers(spark: SparkSession, folder: str, machines: int, extra: int = 0) -> int:
    """Writes the organization's scans into a folder that the executors share; how many there are."""
    scans, findings = organization(spark, machines, extra)
    file = F.when(F.col("file_size").isNotNull(), F.struct(F.col("file_size").alias("size"), "sha256"))
    place = F.struct(F.col("loc_kind").alias("type"), F.col("loc_path").alias("path"), F.col("loc_item").alias("item"))
    shown = F.struct("pos", F.col("finding_id").alias("id"), "rule", "kind", "classification", "status", "reason", "activation", place.alias("location"), "target", file.alias("file"))
    lists = findings.groupBy("load_idx").agg(F.sort_array(F.collect_list(shown)).alias("found"))
    lists = lists.select("load_idx", F.transform("found", lambda x: x.dropFields("pos")).alias("findings"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    lit = lambda **x: F.struct(*[F.lit(v).alias(k) for k, v in x.items()])
    machine = F.struct("hostname", "domain", F.col("machine_id").alias("machineId"), lit(family="windows").alias("os"))
    scan = F.struct(
        F.lit(container.WRITTEN_TYPE).alias("format"), F.lit(container.SCHEMA_VERSION).alias("schemaVersion"), F.format_string("00000000-0000-4000-8000-%012d", "load_idx").alias("scanId"),
        text("started_at").alias("startedAt"), text("finished_at").alias("finishedAt"), lit(product="sample", component="sample", version="1", rulesAsOf="2026-01-01", platform="windows").alias("generator"),
        machine.alias("machine"), lit(localDrives=True, systemSources=True).alias("scope"), F.struct(F.col("coverage_mode").alias("mode"), F.lit(True).alias("elevated")).alias("coverage"), "findings",
    )
    rows = scans.join(lists, "load_idx").select(F.to_json(scan).alias("scan"))
    problems = container.written(rows, folder).where("error is not null").collect()
    if problems:
        raise RuntimeError(f"{len(problems)} scans could not be written, the first: {problems[0]}")
    return machines
