"""Event grouping over records derived from the events table, and the same in plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import event_logs
from ..runtime import materialize
from ..streaming import event_state
from .import_queries import shared_folder
from .queries import query

_B = "chr(92)"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users are machines; the kind of event decides which log a record comes from."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("n", F.col("event_id"))
    kind, n, u = F.col("event_type"), F.col("n"), F.col("user_id")
    app = F.concat(F.when(n % 2 == 0, F.lit("C:\\Apps\\Run")).otherwise(F.lit("c:\\apps\\RUN")), (n % 7).cast("string"), F.lit(".exe"))
    alert = F.when(n % 3 == 0, F.create_map(F.lit("ProcessName"), app, F.lit("ProcessTree"), F.concat(app, F.lit(";cmd.exe")))).when(
        n % 3 == 1, F.create_map(F.lit("#1"), F.concat(F.lit("seen\nProcessName : "), app, F.lit("\nProcessTree = "), app, F.lit(";cmd.exe")))
    ).otherwise(F.create_map(F.lit("#1"), app, F.lit("#2"), F.concat(app, F.lit(";cmd.exe"))))
    line = F.when(n % 3 == 0, F.lit("notepad.exe x.txt")).otherwise(F.concat(F.lit('cscript //nologo "C:\\Jobs\\Job'), (n % 5).cast("string"), F.lit('.vbs" /x')))
    start = F.create_map(F.lit("image"), F.concat(F.lit("C:\\Windows\\App"), (n % 3).cast("string"), F.lit(".exe")), F.lit("CommandLine"), line)
    load = F.create_map(F.lit("Image"), app, F.lit("ImageLoaded"), F.when(n % 4 == 0, F.lit("C:\\x\\other.dll")).otherwise(F.lit("C:/Windows/System32/VBScript.dll")))
    return e.select(
        u.alias("load_idx"), n.alias("record_id"), F.col("ts").cast("timestamp").alias("time"),
        F.when(kind.isin("error", "click"), "VBScriptDeprecationAlert").otherwise("Microsoft-Windows-Sysmon").alias("provider"),
        F.when(kind.isin("error", "click"), 4096).when(kind == "view", 1).when(kind == "purchase", 7).otherwise(5).alias("event_id"),
        F.when(kind.isin("error", "click"), alert).when(kind == "view", start).when(kind == "purchase", load).otherwise(F.create_map(F.lit("x"), F.lit("y"))).alias("data"),
    )


_APP = f"concat(case when event_id % 2 = 0 then concat('C:', {_B}, 'Apps', {_B}, 'Run') else concat('c:', {_B}, 'apps', {_B}, 'RUN') end, event_id % 7, '.exe')"


@query(f"""select load_idx, key, count(*) as events, min(time) as first_seen, max(time) as last_seen, arg_max(app, (time, record_id)) as program from (
  select user_id as load_idx, event_id as record_id, ts as time, {_APP} as app, lower(concat({_APP}, '|', {_APP}, ';cmd.exe')) as key from events where event_type in ('error', 'click')
) group by load_idx, key""")
def event_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_logs.alerts(records(spark, sf_dir)).select("load_idx", "key", "events", "first_seen", "last_seen", "program")


@query(f"""select user_id as load_idx, lower(concat('C:', {_B}, 'Windows', {_B}, 'App', event_id % 3, '.exe|C:', {_B}, 'Jobs', {_B}, 'Job', event_id % 5, '.vbs')) as key, count(*) as events, min(ts) as first_seen, max(ts) as last_seen,
  concat('C:', {_B}, 'Jobs', {_B}, 'Job', event_id % 5, '.vbs') as script
  from events where event_type = 'view' and event_id % 3 <> 0 group by all""")
def event_process_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_logs.process_starts(records(spark, sf_dir)).select("load_idx", "key", "events", "first_seen", "last_seen", "script")


@query(f"select user_id as load_idx, lower({_APP}) as key, count(*) as events, min(ts) as first_seen, max(ts) as last_seen from events where event_type = 'purchase' and event_id % 4 <> 0 group by all")
def event_engine_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_logs.engine_loads(records(spark, sf_dir)).select("load_idx", "key", "events", "first_seen", "last_seen")


@query("select load_idx, record_id from (select user_id as load_idx, event_id as record_id, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n <= 20")
def event_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_logs.newest(records(spark, sf_dir), most=20).select("load_idx", "record_id")


_NEWEST = f"""select user_id as load_idx, event_id as record_id, ts as time, lower(concat({_APP}, '|', {_APP}, ';cmd.exe')) as key, {_APP} as program
  from events where event_type in ('error', 'click') qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 5"""


@query(f"""select load_idx, key, count(*) as events, min(time) as first_seen, max(time) as last_seen, arg_max(program, (time, record_id)) as program, false as capped from ({_NEWEST}) group by load_idx, key
  union all select load_idx, '', count(*), min(time), max(time), '', count(*) >= 5 from ({_NEWEST}) group by load_idx""")
def event_alerts_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest five alerts of each machine, from a replay in three micro-batches, in no order and a third of it twice."""
    rows = event_logs.alert_rows(records(spark, sf_dir))
    n = F.pmod(F.xxhash64("record_id"), F.lit(3))
    with shared_folder(spark) as folder:
        place = f"file://{folder}" if folder.startswith("/") else folder
        files = spark.sparkContext.defaultParallelism
        for part in range(3):  # some files a micro-batch, as many as there are cores; the first third comes again with each
            rows.where((n == part) | (n == 0)).repartition(files).write.mode("append").parquet(f"{place}/in")
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{place}/in")
        with event_state.rocksdb(spark):
            query = event_state.kept_in(event_state.newest_groups(stream, most=5, late="10000 days"), f"{place}/out", f"{place}/state").trigger(availableNow=True).start()
            query.awaitTermination()
        changes = spark.read.schema(f"{event_state.OUT}, batch long").parquet(f"{place}/out/*")
        out = materialize(event_state.current(changes), "groups")
    return out.select("load_idx", F.coalesce("key", F.lit("")).alias("key"), "events", "first_seen", "last_seen", F.coalesce("program", F.lit("")).alias("program"), "capped")
