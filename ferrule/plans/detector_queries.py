"""Detectors over files and command lines derived from the order tables, and what they have to find in plain SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import command, masking, script_lines, text
from ..operators import detect
from ..runtime import ship
from .queries import query

_B = "chr(92)"
_JOB = f"concat('C:', {_B}, 'Jobs', {_B}, 'J', cast(l_partkey % 50 as string), '.vbs')"
LINES = f"""
select l_orderkey, l_linenumber, l_partkey, l_suppkey, case l_partkey % 8
  when 0 then concat('wscript.exe //B "', {_JOB}, '" /x')
  when 1 then concat('cmd /c "cscript //nologo ', {_JOB}, ' & exit"')
  when 2 then concat('start "" /wait ', {_JOB})
  when 3 then concat('wscript C:', {_B}, 'Jobs', {_B}, 'all.wsf')
  when 4 then 'mshta vbscript:Close(1)'
  when 5 then concat('copy ', {_JOB}, ' D:')
  when 6 then concat('set DBPASSWORD=p', cast(l_suppkey as string))
  else concat('cscript //E:JScript ', {_JOB}) end as line
from {{lineitem}}
"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LINES, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


_SQL = LINES.replace("{lineitem}", "lineitem")


@query(f"""select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_partkey % 8 in (0, 1, 2, 4) then 'vbscript' else 'unknown' end as usage,
  case l_partkey % 8 when 0 then 'wscript' when 1 then 'cscript' when 2 then 'direct' when 3 then 'wscript' else 'mshta' end as via,
  case when l_partkey % 8 = 3 then concat('C:', {_B}, 'Jobs', {_B}, 'all.wsf') when l_partkey % 8 < 3 then {_JOB} else '' end as script from lineitem where l_partkey % 8 < 5""")
def command_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            # equal lines are analysed once a batch
            known = {line: command.analyze(line) for line in batch["line"].unique()}
            rows = [(*key, r.usage, r.via, r.script or "") for *key, line in batch.itertuples(index=False) for r in known[line]]
            yield pd.DataFrame(rows, columns=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "usage", "via", "script"])

    ship(spark)
    return _lines(spark, sf_dir).mapInPandas(run, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, usage string, via string, script string")


@query(f"select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_partkey % 8 = 6 then 'set DBPASSWORD=********' else line end as line from ({_SQL})")
def masked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).withColumn("line", masking.mask_column("line"))


@query("select doc_id, case when text is null then 0 else len(regexp_split_to_array(text, '\\r\\n|\\n|\\r')) - case when regexp_matches(text, '[\\r\\n]$') and length(text) > 0 then 1 else 0 end end as n_lines from documents")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.size(text.lines_column("text"))).cast("long").alias("n_lines"))


_FILES = f"""
select o_orderkey as load_idx, concat(case when o_custkey % 5 = 0 then concat({_B}, {_B}, 'dc', {_B}, 'netlogon', {_B}) else concat('C:', {_B}) end, 'f', cast(o_orderkey as string), case o_orderkey % 4 when 0 then '.vbs' when 1 then '.cmd' when 2 then '.ps1' else '.txt' end) as path,
  concat('rem start', chr(10), 'cscript //nologo j', cast(o_custkey % 9 as string), '.vbs', chr(10), case when o_custkey % 7 = 0 then 'set MYPASSWORD=x1' else 'x = 1' end, chr(10)) as content,
  case when o_custkey % 11 = 0 then 'locked' end as problem
from {{orders}}
"""


@query(f"""with f as ({_FILES.replace("{orders}", "orders")}),
hit as (
  select load_idx, path, content, problem, case load_idx % 4 when 0 then 'VBS-101' else 'VBS-201' end as rule from f where load_idx % 4 < 3 and problem is null
  union all select load_idx, path, content, problem, case load_idx % 4 when 0 then 'VBS-100' else 'VBS-200' end from f where load_idx % 4 < 3 and problem is not null
  union all select load_idx, path, content, problem, 'VBS-901' from f where load_idx % 4 < 3 and problem is null and contains(content, 'PASSWORD')
)
select load_idx, path, rule, case when problem is null then 'detected' else 'notCheckable' end as status, coalesce(problem, '') as reason,
  case when contains(path, 'netlogon') and problem is null then 'automatic' else 'dormant' end as activation,
  case when rule = 'VBS-201' then regexp_extract(content, 'j[0-9][.]vbs') else '' end as target from hit""")
def file_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_FILES, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    rows = rows.withColumns({"content": F.encode("content", "utf-8"), "size": F.octet_length("content").cast("long")})
    found = detect.detect_files(rows)
    return found.select("load_idx", F.col("loc_path").alias("path"), "rule", "status", F.coalesce("reason", F.lit("")).alias("reason"), "activation", F.coalesce("target", F.lit("")).alias("target"))


# lines of an order's script, by language; block comments span items, blank and long lines are there too
_SCRIPT_LINES = """
select l_orderkey, l_linenumber as n, l_orderkey % 4 as lang, case l_partkey % 12 when 0 then '<# a block' when 1 then 'in block #> Run-It' when 2 then '  ' when 3 then '# only a note' when 4 then '; note'
  when 5 then concat('REM part ', cast(l_partkey as string)) when 6 then concat('@echo  done ', cast(l_partkey as string)) when 7 then '<# one line #> x' when 8 then concat(chr(39), ' note') when 9 then concat('set o = CreateObject("a', cast(l_suppkey as string), '")')
  else concat('  call job', cast(l_partkey as string)) end as line
from (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as l_linenumber, l_partkey, l_suppkey from {lineitem}) x
"""
_LANGUAGES = ("batch", "powershell", "kixtart", "vbscript")
_CODE = f"""
with x as ({_SCRIPT_LINES.replace("{lineitem}", "lineitem")}),
e as (select *, trim(line) as bare, case when lang = 1 and contains(line, '#>') then 0 when lang = 1 and starts_with(trim(line), '<#') then 1 end as event from x),
s as (select *, coalesce(last_value(event ignore nulls) over (partition by l_orderkey order by n rows between unbounded preceding and 1 preceding), 0) as inside from e),
code as (
  select l_orderkey, n as number, line from s where bare <> '' and inside = 0 and case lang when 0 then not regexp_matches(lower(bare), '^@*(rem( |$)|::|echo( |$))') when 1 then not starts_with(bare, '#') and not starts_with(bare, '<#')
    when 2 then not starts_with(bare, ';') else not starts_with(bare, chr(39)) and not regexp_matches(lower(bare), '^rem( |$)') end
)
"""


def _scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.sql(_SCRIPT_LINES, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    texts = lines.groupBy("l_orderkey", "lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\r\n").alias("text"))  # an order has a few items
    return texts.select("l_orderkey", F.get(F.array(*[F.lit(x) for x in _LANGUAGES]), F.col("lang").cast("int")).alias("language"), "text")


@query(f"{_CODE} select l_orderkey, number, line from code")
def script_code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return script_lines.code_lines(_scripts(spark, sf_dir), ["l_orderkey"]).select("l_orderkey", F.col("number").cast("long").alias("number"), "line")


@query(f"{_CODE} select l_orderkey, number, line from code qualify row_number() over (partition by l_orderkey order by contains(lower(line), 'createobject') desc, number) <= 2")
def script_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = script_lines.code_lines(_scripts(spark, sf_dir), ["l_orderkey"])
    return script_lines.evidence(code, ["l_orderkey"], most=2).select("l_orderkey", F.col("number").cast("long").alias("number"), "line")
