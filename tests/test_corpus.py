"""From files on disk to findings and items: what has to be found is, and nothing is found where there is nothing."""

import pytest
from pyspark.sql import functions as F

from ferrule.operators import detect
from ferrule.operators.assessment import assess
from ferrule.sources import files, listing

# path -> content, and the rules of the findings that it has to give
POSITIVE = {
    "Scripts/logon.vbs": ('Set s = CreateObject("WScript.Shell")\r\ns.Run "notepad"\r\n', {"VBS-101"}),
    "Scripts/_hidden.VBS": ("Dim x\nx = 1\nWScript.Echo x\n", {"VBS-101"}),
    "Scripts/.dotted.vbs": ("MsgBox 1\n", {"VBS-101"}),
    "Scripts/job.wsf": ('<job><script language="VBScript">x = 1\nWScript.Echo x</script></job>', {"VBS-103"}),
    "Scripts/part.wsc": ('<component><script language="VBScript"><![CDATA[Function f\nEnd Function]]></script></component>', {"VBS-104"}),
    "Apps/panel.hta": ('<html><script language="vbscript">Sub a\nEnd Sub</script></html>', {"VBS-105"}),
    "Batch/run.cmd": ("@echo off\r\nrem a note\r\ncscript //nologo C:\\Jobs\\a.vbs\r\n", {"VBS-201"}),
    "Batch/all.bat": ("wscript C:\\Jobs\\all.wsf\r\n", {"VBS-202"}),
    "Batch/call.ps1": ('& cscript.exe "C:\\Jobs\\b.vbs"\n', {"VBS-201"}),
    "Policies/Machine/Scripts/scripts.ini": ("[Startup]\r\n0CmdLine=C:\\Jobs\\s.vbs\r\n0Parameters=\r\n", {"VBS-341"}),
    "Scripts/utf16.vbs": ("\ufeffWScript.Echo 1\r\n", {"VBS-101"}),
}
NEGATIVE = {
    "Docs/notes.txt": "cscript a.vbs",
    "Batch/comment.cmd": "@echo off\r\nrem cscript C:\\Jobs\\a.vbs\r\n:: wscript b.vbs\r\necho cscript c.vbs\r\n",
    "Batch/block.ps1": "<#\ncscript C:\\a.vbs\n#>\n# wscript b.vbs\nWrite-Output 1\n",
    "Batch/copy.cmd": "copy C:\\Jobs\\a.vbs D:\\\r\ncscript //E:JScript C:\\Jobs\\a.js\r\n",
    "Apps/js.hta": '<html><script language="javascript">var x = 1;</script></html>',
    "Apps/js.wsf": '<job><script language="JScript">var x = 1;</script></job>',
    "Policies/scripts.ini": "[Startup]\r\n0CmdLine=C:\\Jobs\\s.exe\r\n0Parameters=\r\n",
    "Apps/page.html": '<script language="vbscript">Sub a\nEnd Sub</script>',
}


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("machine")
    for name, content in {**{k: v[0] for k, v in POSITIVE.items()}, **NEGATIVE}.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content.encode("utf-16-le" if "utf16" in name else "utf-8"))
    (root / "loop").symlink_to(root)
    listed, entries = files.listed(spark, str(root), set(detect.DETECTORS), frozenset(detect.NAMED))
    assert entries.first().entries == len(list(root.rglob("*")))
    rows = files.read_listed(listing.planned(listed).withColumn("load_idx", F.lit(0)))
    rules = {}
    out = detect.detect_files(rows).cache()
    for r in out.collect():
        rules.setdefault(r.loc_path.removeprefix(f"{root}/"), set()).add(r.rule)
    return rules, out


def test_all_that_is_there_is_found(found):
    assert {k: v for k, v in found[0].items() if k in POSITIVE} == {k: rules for k, (_, rules) in POSITIVE.items()}


def test_nothing_else_is_found(found):
    assert not set(found[0]) & set(NEGATIVE) and not set(found[0]) - set(POSITIVE)


def test_and_ranked(spark, found):
    scans = spark.sql("select 0L as load_idx, 'a.zip' as file, 's' as scan_id, 'PC-1' as hostname, cast(null as string) as domain, cast(null as string) as machine_id, timestamp'2026-01-01 08:00:00' as started_at, timestamp'2026-01-01 08:05:00' as finished_at, 'full' as coverage_mode")
    findings = found[1].withColumns({"load_idx": F.col("load_idx").cast("long"), "pos": F.monotonically_increasing_id(), "finding_id": F.lit("f")})
    a = assess(scans, findings)
    assert a.items.count() == len(POSITIVE) and {r.rule for r in a.items.where("activation = 'automatic'").collect()} >= {"VBS-341"}
