"""Containers written from the order tables and read back, and what the import has to make of them in plain SQL.

Every order is a file: a scan of its customer's machine, some of them damaged,
repeated or of a newer schema.
"""

from __future__ import annotations

import io
import json
import os
import queue
import shutil
import uuid
import zipfile
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import details
from ..runtime import materialize, session_dir, ship
from ..sources import container, container_source, files, listing, stores
from ..sources.import_state import ImportState
from ..sources.spare import Folder
from .queries import query

_KIND = "case when o_orderkey % 13 = 5 then 'cut' when o_orderkey % 17 = 6 then 'newer' when o_orderkey % 19 = 7 then 'many' when o_orderkey % 23 = 8 then 'bare' else 'good' end"
FILES = f"""
select o_orderkey, concat('f', lpad(cast(o_orderkey as string), 9, '0'), '.zip') as file, concat('Host-', cast(o_custkey as string)) as host, cast(o_orderdate as string) as day, o_custkey % 4 as n_findings,
  concat('00000000-0000-4000-8000-', lpad(cast(case when o_orderkey % 10 = 9 then o_custkey else 1000000 + o_orderkey end as string), 12, '0')) as scan_id, o_custkey % 5 = 0 as odd, {_KIND} as kind
from {{orders}}
"""


@contextmanager
def shared_folder(spark: SparkSession) -> Iterator[str]:
    """A new folder that the executors share, gone afterwards: what is read of it has to be written by then."""
    where = f"{session_dir(spark)}/files-{uuid.uuid4().hex[:12]}"
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    try:
        yield stores.local_path(where)
    finally:
        fs.delete(path, True)


def put(rows: DataFrame, folder: str, alike: int = 0) -> int:
    """Writes files (file, content) below a shared folder, in tasks; how many.

    A small file takes a block.  Of contents that a task met before, `alike` of
    them at most, files are further names of the one that is there.  If there
    is a folder <folder>.spare, files are written over those in there, and are
    names of them in <folder>.taken.
    """
    spare = f"{folder}.spare"

    def run(batches):
        folders, made = set(), {}
        kept = Folder(f"{folder}.taken/{uuid.uuid4().hex}", spare) if os.path.isdir(spare) else None
        for batch in batches:
            for name, content in zip(batch["file"], batch["content"], strict=True):
                path = os.path.join(folder, name)
                if (above := os.path.dirname(path)) not in folders:
                    os.makedirs(above, exist_ok=True)
                    folders.add(above)
                if kept:
                    there = kept.write(content)
                    try:
                        os.link(there, path)
                    except FileExistsError:  # of this task as it ran before
                        os.remove(path)
                        os.link(there, path)
                    continue
                if content in made:
                    try:
                        os.link(made[content], path)
                        continue
                    except OSError:  # it has as many names as the file system gives it
                        pass
                with open(path, "wb") as f:
                    f.write(content)
                if content in made or len(made) < alike:
                    made[content] = path
            yield pd.DataFrame({"n": [len(batch)]})

    return rows.select("file", "content").mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders, dealt to all cores: what follows takes far longer a row than reading it."""
    return _dealt(spark.read.parquet(f"{sf_dir}/orders.parquet"))


def _dealt(orders: DataFrame) -> DataFrame:
    return orders.repartition(4 * orders.sparkSession.sparkContext.defaultParallelism)


#: Orders whose containers are written and read together, and how many such portions are under way at once.
PORTION, AT_ONCE = 50_000, 3


def _in_portions(spark: SparkSession, sf_dir: str, kinds: str, rows_of: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The rows that `rows_of` reads from containers that it writes of some orders into a folder, for all orders.

    A container takes a block of the disk, so they lie there a portion at a
    time.  Some portions are under way together, as what one does in few tasks
    (listing, publishing, removing) leaves the cores to the others; the next
    one writes over the files of one that is done.
    """
    where = f"{session_dir(spark)}/portions-{uuid.uuid4().hex[:12]}"
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    n = max(1, -(-orders.count() // PORTION))
    if n > 1:
        orders.withColumn("portion", F.pmod(F.xxhash64("o_orderkey"), F.lit(n))).write.partitionBy("portion").parquet(f"{where}/orders")
    ship(spark)
    free = queue.SimpleQueue()

    def run(i: int) -> str:
        some = orders if n == 1 else spark.read.schema(orders.schema).parquet(f"{where}/orders/portion={i}")
        folder = free.get()
        try:
            os.makedirs(folder)
            rows_of(_dealt(some), folder).write.parquet(f"{where}/rows/{i}")
            shutil.rmtree(folder)
            if os.path.isdir(taken := f"{folder}.taken"):
                for name in os.listdir(taken):
                    os.rename(f"{taken}/{name}", f"{folder}.spare/{name}")
        finally:
            free.put(folder)
        return f"{where}/rows/{i}"

    with shared_folder(spark) as shared, ThreadPoolExecutor(AT_ONCE) as pool:
        for i in range(AT_ONCE):
            os.makedirs(f"{shared}/{i}.spare")
            free.put(f"{shared}/{i}")
        try:
            parts = [p.result() for p in [pool.submit(run, i) for i in range(n)]]
        finally:
            pool.shutdown(cancel_futures=True)
    return spark.read.schema(kinds).parquet(*parts)


def containers(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """(file, content), of all orders or some."""

    def scan(r) -> dict:
        finding = {"rule": "VBS-101", "kind": "scriptFile", "classification": "later" if r.odd else "breaks", "status": "detected", "activation": "dormant"}
        findings = [{"id": f"f{0 if r.kind == 'many' else i}", **finding, "location": {"type": "file", "path": f"C:\\s{i}.vbs"}} for i in range(max(r.n_findings, 2 * (r.kind == "many")))]
        return {
            "format": container.WRITTEN_TYPE, "schemaVersion": 99 if r.kind == "newer" else 1, "scanId": r.scan_id, "startedAt": f"{r.day[:10]}T08:00:00Z", "finishedAt": f"{r.day[:10]}T08:05:00Z",
            "generator": {"product": "p", "component": "c", "version": "1", "rulesAsOf": "2026-01-01", "platform": "windows"}, "machine": {"hostname": r.host, "os": {"family": "windows"}},
            "scope": {"localDrives": True, "systemSources": True}, "coverage": {"mode": "full", "elevated": True}, "findings": findings,
        }

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                made = container.pack((container.MIMETYPE, "text/plain" if r.kind == "bare" else container.WRITTEN_TYPE, zipfile.ZIP_STORED), (container.RESULT, json.dumps(scan(r)), zipfile.ZIP_STORED))
                rows.append((r.file, made[: 40 if r.kind == "cut" else None]))
            yield pd.DataFrame(rows, columns=["file", "content"])

    ship(spark)
    return spark.sql(FILES, orders=_orders(spark, sf_dir) if orders is None else orders).mapInPandas(run, "file string, content binary")


_SQL = f"""
with x as ({FILES.replace("{orders}", "orders")}),
good as (select *, min(file) over (partition by scan_id) as first from x where kind = 'good'),
done as (select x.*, case when x.kind <> 'good' then 'error' when x.file <> g.first then 'duplicate' else 'accepted' end as outcome from x left join good g using (o_orderkey))
"""


@query(f"""{_SQL} select file, outcome, case kind when 'cut' then 'notAResultFile' when 'newer' then 'newerSchema' when 'many' then 'invalid' when 'bare' then 'wrongFormat' else '' end as error,
  case when kind = 'good' then host else '' end as host, case when kind = 'good' then n_findings else 0 end as n_findings, case when kind = 'good' and odd then n_findings else 0 end as n_unknown from done""")
def container_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(container.imported(parsed(spark, sf_dir)))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The containers' rows; each is built and opened once."""
    return materialize(container.read_contents(containers(spark, sf_dir)), "scans")


def _outcomes(rows: DataFrame) -> DataFrame:
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return rows.select(
        "file", "outcome", F.coalesce("error", F.lit("")).alias("error"), F.coalesce("machine.hostname", F.lit("")).alias("host"),
        n("n_findings").alias("n_findings"), n("unknown_values").alias("n_unknown"),
    )


@query(f"{_SQL} select file, host, row_number() over (order by lower(host), file) - 1 as load_idx from done where outcome = 'accepted'")
def container_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = container.load_order(container.imported(parsed(spark, sf_dir)))
    return rows.select("file", F.col("machine.hostname").alias("host"), F.col("load_idx").cast("long").alias("load_idx"))


@query(f"""{_SQL}, o as (select *, row_number() over (order by lower(host), file) - 1 as load_idx from done where outcome = 'accepted')
select load_idx, pos, concat('f', pos) as finding_id, concat('C:', chr(92), 's', pos, '.vbs') as loc_path from (select load_idx, unnest(range(n_findings)) as pos from o)""")
def container_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parsed(spark, sf_dir)
    return container.tables(container.load_order(container.imported(rows)), rows)["findings"].select(F.col("load_idx").cast("long").alias("load_idx"), "pos", "finding_id", "loc_path")


_NAMED = "concat(case o_orderkey % 3 when 0 then '' when 1 then '_' else '.' end, x.file)"
_FILES = FILES.replace("{orders}", "orders")
_FOUND = f"""
with x as (select x.* exclude (file), concat('d', o_orderkey % 7, '/', {_NAMED}) as file from ({_FILES}) x),
good as (select *, min(file) over (partition by scan_id) as first from x where kind = 'good'),
done as (select x.*, case when x.kind <> 'good' then 'error' when x.file <> g.first then 'duplicate' else 'accepted' end as outcome from x left join good g using (o_orderkey))
"""


@query(f"""{_FOUND} select file, outcome, case kind when 'cut' then 'notAResultFile' when 'newer' then 'newerSchema' when 'many' then 'invalid' when 'bare' then 'wrongFormat' else '' end as error,
  case when kind = 'good' then host else '' end as host, case when kind = 'good' then n_findings else 0 end as n_findings, case when kind = 'good' and odd then n_findings else 0 end as n_unknown from done""")
def container_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same containers as files in seven folders, a third with names that begin with an underscore and a third with a dot."""
    number = F.regexp_extract("file", r"f0*(\d+)\.", 1).cast("long")
    name = F.concat(F.lit("d"), (number % 7).cast("string"), F.lit("/"), F.when(number % 3 == 0, "").when(number % 3 == 1, "_").otherwise("."), F.col("file"))

    def rows_of(orders: DataFrame, folder: str) -> DataFrame:
        put(containers(spark, sf_dir, orders).withColumn("file", name), folder)
        rows = container.read_files(spark, folder, "zip").where("part = 'scan'")
        return rows.select(F.expr(f"substring(file, {len(folder) + 2})").alias("file"), "error", "scanId", F.struct("machine.hostname", "machine.domain", "machine.machineId").alias("machine"), "unknown_values", "n_findings")

    kinds = "file string, error string, scanId string, machine struct<hostname string, domain string, machineId string>, unknown_values int, n_findings long"
    return _outcomes(container.imported(_in_portions(spark, sf_dir, kinds, rows_of)))


@query("""select concat('Host_', o_orderkey, '_', strftime(cast(o_orderdate as timestamp), '%Y%m%d'), '-080000Z.zip') as file, cast(pos as bigint) as pos, concat('f', pos) as finding_id, concat('C:', chr(92), 'é', pos, '.vbs') as loc_path, pos * o_custkey as file_size
  from (select *, unnest(range(1 + o_custkey % 3)) as pos from orders)""")
def container_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans written as containers by jobs that publish all or none, and read back."""
    lit = lambda **x: F.struct(*[F.lit(v).alias(k) for k, v in x.items()])
    finding = lambda i: F.struct(
        F.concat(F.lit("f"), i.cast("string")).alias("id"), *[F.lit(v).alias(k) for k, v in (("rule", "VBS-101"), ("kind", "scriptFile"), ("classification", "breaks"), ("status", "detected"), ("activation", "dormant"))],
        F.struct(F.lit("file").alias("type"), F.concat(F.lit("C:\\é"), i.cast("string"), F.lit(".vbs")).alias("path")).alias("location"), F.struct((i * F.col("o_custkey")).alias("size")).alias("file"),
    )
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    scan = F.struct(
        F.lit(container.WRITTEN_TYPE).alias("format"), F.lit(1).alias("schemaVersion"), F.format_string("00000000-0000-4000-8000-%012d", "o_orderkey").alias("scanId"),
        F.concat(day, F.lit("T08:00:00Z")).alias("startedAt"), F.concat(day, F.lit("T08:05:00Z")).alias("finishedAt"), lit(product="p", component="c", version="1", rulesAsOf="2026-01-01", platform="windows").alias("generator"),
        F.struct(F.concat(F.lit("Host "), F.col("o_orderkey").cast("string")).alias("hostname"), lit(family="windows").alias("os")).alias("machine"), lit(localDrives=True, systemSources=True).alias("scope"),
        lit(mode="full", elevated=True).alias("coverage"), F.transform(F.sequence(F.lit(0), (F.col("o_custkey") % 3).cast("int")), finding).alias("findings"),
    )

    def rows_of(orders: DataFrame, folder: str) -> DataFrame:
        container_source.save(orders.select(F.to_json(scan).alias("scan")), folder, spare=f"{folder}.spare")
        found = container.read_files(spark, folder, "zip").where("part = 'finding'")
        return found.select(F.substring_index("file", "/", -1).alias("file"), "pos", F.col("finding.id").alias("finding_id"), F.col("finding.location.path").alias("loc_path"), F.col("finding.file.size").alias("file_size"))

    return _in_portions(spark, sf_dir, "file string, pos long, finding_id string, loc_path string, file_size long", rows_of)


_TWO = f"""
with x as ({_FILES}),
good1 as (select *, min(file) over (partition by scan_id) as first from x where kind = 'good' and o_orderkey % 2 = 0),
inside1 as (select host from good1 group by host order by min(first) limit 40),
done1 as (
  select x.file, x.scan_id, x.host, case when x.kind <> 'good' then 'error' when i.host is null then 'overLimit' when x.file <> g.first then 'duplicate' else 'accepted' end as outcome
  from x left join good1 g on x.file = g.file left join inside1 i on x.host = i.host where x.o_orderkey % 2 = 0
),
took as (select * from done1 where outcome = 'accepted'),
rest as (select * from x where file not in (select file from done1 where outcome in ('accepted', 'duplicate'))),
good2 as (select *, min(file) over (partition by scan_id) as first from rest where kind = 'good' and scan_id not in (select scan_id from took)),
inside2 as (
  (select host from good2 where host not in (select host from took) group by host order by min(first) limit greatest(60 - (select count(distinct host) from took), 0)) union select host from took
),
done2 as (
  select x.file, case when r.file is null then 'alreadyLoaded' when x.kind <> 'good' then 'error' when g.file is null then 'duplicate' when i.host is null then 'overLimit' when x.file <> g.first then 'duplicate' else 'accepted' end as outcome
  from x left join rest r on x.file = r.file left join good2 g on x.file = g.file left join inside2 i on x.host = i.host
)
select 1 as import, file, outcome from done1 union all select 2, file, outcome from done2
"""


@query(_TWO)
def container_two_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the files with room for 40 machines, then all files with room for 60, into one state."""
    rows = parsed(spark, sf_dir)
    half = rows.where(F.regexp_extract("file", r"f0*(\d+)\.", 1).cast("long") % 2 == 0)
    with shared_folder(spark) as folder:
        state = ImportState(spark, f"file://{folder}" if folder.startswith("/") else folder)
        both = [state.take_up(half, 40), state.take_up(rows, 60)]
    return both[0].select(F.lit(1).alias("import"), "file", "outcome").union(both[1].select(F.lit(2), "file", "outcome"))


_TREE = """
select concat('c', o_custkey % 7, '/_d', o_custkey % 3, '/.h', o_orderkey % 5) as folder, concat(case o_orderkey % 3 when 0 then 'f' when 1 then '_f' else '.f' end, o_orderkey, case o_orderkey % 4 when 0 then '.vbs' when 1 then '.VBE' when 2 then '.txt' else '' end) as name,
  o_orderkey % 50 as size from orders
"""


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, content): a file of o_orderkey % 50 bytes for each order, in folders of three levels."""
    spelled = _TREE.replace("from orders", "from {orders}")
    rows = spark.sql(spelled, orders=_orders(spark, sf_dir))
    return rows.select(F.concat("folder", F.lit("/"), "name").alias("file"), F.expr("repeat('x', cast(size as int))").cast("binary").alias("content"))


@query(f"""with t as ({_TREE}), f as (select distinct folder from t), up as (select folder as path from f union select regexp_extract(folder, '^(.*)/[^/]*$', 1) from f union select regexp_extract(folder, '^([^/]*)/', 1) from f union select ''),
child as (select folder as parent, name from t union select regexp_extract(path, '^(?:(.*)/)?[^/]*$', 1), path from up where path <> '')
select 'file' as kind, concat(folder, '/', name) as path, size from t where regexp_matches(lower(name), '[.](vbs|vbe)$')
union all select 'expanded', parent, count(*) from child group by parent""")
def listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of two extensions in a tree, and the number of entries of each folder."""
    with shared_folder(spark) as folder:
        put(tree(spark, sf_dir), folder, alike=1_000)
        found = listing.tree(spark, folder, {"vbs", "vbe"})
    return found.where("kind in ('file', 'expanded')").select("kind", F.expr(f"substring(path, {len(folder) + 2})").alias("path"), "size")


@query(f"select concat(folder, '/', name) as path, size, case when size <= 30 then sha256(repeat('x', cast(size as int))) else '' end as sha256, case when size > 30 then 'tooLarge' else '' end as problem from ({_TREE}) where regexp_matches(lower(name), '[.](vbs|vbe)$')")
def listed_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of those files within a limit of 30 bytes."""
    with shared_folder(spark) as folder:
        put(tree(spark, sf_dir), folder, alike=1_000)
        found, _ = files.listed(spark, folder, {"vbs", "vbe"})
        rows = materialize(files.read_listed(listing.planned(found).withColumn("load_idx", F.lit(0)), most=30), "contents")
    return rows.select(F.expr(f"substring(path, {len(folder) + 2})").alias("path"), "size", F.coalesce(F.sha2("content", 256), F.lit("")).alias("sha256"), F.coalesce("problem", F.lit("")).alias("problem"))


@query("""select concat('f', lpad(cast(o_orderkey as varchar), 9, '0'), '.zip') as file, cast(o_custkey as bigint) as calls, case when o_orderkey % 3 = 0 then concat('via "', o_custkey % 5, '" é') end as via,
  case when o_orderkey % 4 < 2 then o_orderkey % 4 = 1 end as encoded, case o_orderkey % 3 when 0 then 'text' when 1 then 'number' end as via_kind, case when o_orderkey % 3 < 2 then 'calls,' else 'calls' end as x, from orders""".replace("case when o_orderkey % 3 < 2 then 'calls,' else 'calls' end as x, from", "array_to_string(list_filter(['calls', case when o_orderkey % 4 < 3 then 'encoded' end, case when o_orderkey % 3 < 2 then 'via' end], lambda n: n is not null), ',') as names from"))
def container_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details of one finding a file: a number that the file has twice (the last counts), a text or number, a truth value or null."""
    raw = """select concat('f', lpad(cast(o_orderkey as string), 9, '0'), '.zip') as file, concat(chr(123), '"calls": ', o_orderkey, case when o_orderkey % 3 = 0 then concat(', "via": "via \\\\"', o_custkey % 5, '\\\\" é"') when o_orderkey % 3 = 1 then ', "via": 7' else '' end,
      case o_orderkey % 4 when 0 then ', "encoded": false' when 1 then ', "encoded": true' when 2 then ', "encoded": 1' else '' end, ', "calls": ', o_custkey, chr(125)) as details, o_orderkey, cast(o_orderdate as string) as day from {orders}"""

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                finding = {"id": "f1", "rule": "VBS-101", "kind": "scriptFile", "classification": "breaks", "status": "detected", "activation": "dormant", "location": {"type": "file", "path": "C:\\a.vbs"}, "details": "DETAILS"}
                scan = {
                    "format": container.WRITTEN_TYPE, "schemaVersion": 1, "scanId": f"00000000-0000-4000-8000-{r.o_orderkey:012}", "startedAt": f"{r.day[:10]}T08:00:00Z", "finishedAt": f"{r.day[:10]}T08:05:00Z",
                    "generator": {"product": "p", "component": "c", "version": "1", "rulesAsOf": "2026-01-01", "platform": "windows"}, "machine": {"hostname": "h", "os": {"family": "windows"}},
                    "scope": {"localDrives": True, "systemSources": True}, "coverage": {"mode": "full", "elevated": True}, "findings": [finding],
                }
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as z:
                    z.writestr(container.MIMETYPE, container.WRITTEN_TYPE)
                    z.writestr(container.RESULT, json.dumps(scan).replace('"DETAILS"', r.details))
                rows.append((r.file, out.getvalue()))
            yield pd.DataFrame(rows, columns=["file", "content"])

    ship(spark)
    made = spark.sql(raw, orders=_orders(spark, sf_dir)).mapInPandas(run, "file string, content binary")
    rows = materialize(container.read_contents(made), "scans")
    loaded = container.load_order(container.imported(rows))
    found = container.tables(loaded, rows)["findings"].join(container.many(loaded.select("load_idx", "file")), "load_idx")
    return found.select(
        "file", details.number("details", "calls").alias("calls"), details.text("details", "via").alias("via"), details.flag("details", "encoded").alias("encoded"), details.kind("details", "via").alias("via_kind"),
        F.array_join(details.names("details"), ",").alias("names"),
    )
