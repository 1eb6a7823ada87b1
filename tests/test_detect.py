import json

import pandas as pd
import pytest

from ferrule.operators import detect, event_logs, system
from ferrule.sources.formats.hive import Hive

from . import builders
from .test_formats import SOURCE

FILES = "load_idx long, path string, content binary, size long, problem string"
RUN = "Software\\Microsoft\\Windows\\CurrentVersion\\Run"


def files(spark, *rows):
    return spark.createDataFrame([(0, p, bytearray(c) if c is not None else None, len(c or b""), problem) for p, c, problem in rows], FILES)


def test_scripts_and_calls(spark):
    rows = files(
        spark,
        ("C:\\a.vbs", b'Set s = CreateObject("X")\r\n\' note\r\npwd = "Secret1"\r\n', None),
        ("C:\\b.wsf", b"<job><script language='JScript'>x</script></job>", None),
        ("C:\\c.hta", b"<body onload=\"vbscript:Go\"><script language=VBScript src='x.vbs'>If a<b Then\n</script>", None),
        ("C:\\d.cmd", b"@echo wscript x.vbs\r\nrem cscript y.vbs\r\ncscript //nologo z.vbs /pwd:abc\r\ncscript %1\r\n", None),
        ("C:\\e.ps1", b"<# cscript a.vbs\n#>\n# cscript b.vbs\n& 'c.vbs'\n", None),
        ("\\\\d\\sysvol\\d\\scripts\\f.vbs", None, "accessDenied"),
        ("C:\\g.txt", b"wscript x.vbs", None),
        ("C:\\h.vbs", b"PA30\x01\x02\x03", None),
        ("C:\\Scripts.ini", b"[Logon]\r\n0CmdLine=map.vbs\r\n0Parameters=/x\r\n[Startup]\n0CmdLine=run.exe", None),
    )
    out = detect.detect_files(rows).cache()
    assert {(r.loc_path, r.rule, r.status, r.target) for r in out.collect()} == {
        ("C:\\a.vbs", "VBS-101", "detected", None), ("C:\\a.vbs", "VBS-901", "detected", None), ("C:\\c.hta", "VBS-105", "detected", "x.vbs"),
        ("C:\\d.cmd", "VBS-201", "detected", "z.vbs"), ("C:\\d.cmd", "VBS-202", "detected", "%1"), ("C:\\d.cmd", "VBS-901", "detected", None),
        ("C:\\e.ps1", "VBS-201", "detected", "c.vbs"), ("\\\\d\\sysvol\\d\\scripts\\f.vbs", "VBS-100", "notCheckable", None), ("C:\\Scripts.ini", "VBS-341", "detected", "map.vbs"),
    }
    rows_ = {(r.loc_path, r.rule): r for r in out.collect()}
    assert len(rows_) == 9
    assert "Secret1" not in str(rows_) and rows_["C:\\a.vbs", "VBS-901"].evidence[0].masked
    assert json.loads(rows_["C:\\d.cmd", "VBS-201"].details) == {"via": "cscript", "calls": 1}
    assert rows_["C:\\c.hta", "VBS-105"].target == "x.vbs" and rows_["C:\\d.cmd", "VBS-202"].target == "%1"
    assert rows_["\\\\d\\sysvol\\d\\scripts\\f.vbs", "VBS-100"].reason == "accessDenied"
    got = rows.select("path", detect.file_activation_column("path").alias("a")).collect()
    assert all(r.a == detect.file_activation(r.path) for r in got)


def test_binary_files(spark):
    package = builders.package({"CustomAction": ([("Action", "s"), ("Type", "h"), ("Source", "s"), ("Target", "s")], [{"Action": "A", "Type": 38, "Target": "MsgBox 1"}])})
    rows = files(
        spark,
        ("C:\\a.lnk", builders.shell_link("C:\\Windows\\wscript.exe", "C:\\x.vbs", "C:\\w"), None),
        ("C:\\b.lnk", b"damaged", None),
        ("C:\\c.msi", package, None),
        ("C:\\d.msi", b"damaged", None),
        ("C:\\XLSTART\\e.xls", builders.compound(builders.vba_streams({"M": SOURCE})), None),
        ("C:\\f.docm", builders.compound({"EncryptedPackage": b"x"}), None),
        ("C:\\g.xls", b"", None),
    )
    rows_ = {(r.loc_path, r.loc_item, r.rule): r for r in detect.detect_files(rows).collect()}
    assert sorted((p, i or "", r) for p, i, r in rows_) == [
        ("C:\\XLSTART\\e.xls", "M", "VBS-601"), ("C:\\XLSTART\\e.xls", "M", "VBS-611"), ("C:\\XLSTART\\e.xls", "M", "VBS-621"), ("C:\\XLSTART\\e.xls", "M", "VBS-632"),
        ("C:\\a.lnk", "", "VBS-211"), ("C:\\b.lnk", "", "VBS-200"), ("C:\\c.msi", "A", "VBS-402"), ("C:\\d.msi", "", "VBS-400"), ("C:\\f.docm", "", "VBS-600"),
    ]
    assert rows_["C:\\b.lnk", None, "VBS-200"].kind == "shortcut" and rows_["C:\\f.docm", None, "VBS-600"].reason == "passwordProtected"
    macro = json.loads(rows_["C:\\XLSTART\\e.xls", "M", "VBS-601"].details)
    assert macro["autoMacros"] == "Workbook_Open" and macro["loadedAtStartup"] is True


def test_one_failing_file_leaves_the_others(spark, monkeypatch):
    def fails(file):
        raise RuntimeError

    monkeypatch.setitem(detect.DETECTORS, "vbs", [(fails, "VBS-100"), *detect.DETECTORS["vbs"]])
    batch = __import__("pandas").DataFrame({"load_idx": [0], "path": ["a.vbs"], "content": [b"x = 1"], "size": [5], "problem": [None]})
    assert sorted((f.rule, f.reason) for _, f in detect._inspect_files(batch)) == [("VBS-100", "internalError"), ("VBS-101", None)]


TASK = """<Task xmlns="x"><Triggers><LogonTrigger><Enabled>false</Enabled></LogonTrigger><BootTrigger/></Triggers>
<Settings><Enabled>{}</Enabled></Settings><Actions><Exec><Command>C:\\Program Files\\a b.exe</Command></Exec>
<Exec><Command>wscript.exe</Command><Arguments>//B &quot;C:\\x.vbs&quot;</Arguments></Exec></Actions></Task>"""


@pytest.mark.parametrize(("enabled", "activation"), [("true", "automatic"), ("False", "dormant")])
def test_tasks(spark, enabled, activation):
    rows = files(spark, ("\\T", TASK.format(enabled).encode("utf-16"), None), ("\\Bad", b"text", None), ("\\Locked", None, "locked"))
    out = {r.loc_path: r for r in detect.detect_tasks(rows).collect()}
    assert (out["\\T"].rule, out["\\T"].loc_item, out["\\T"].target, out["\\T"].activation) == ("VBS-301", "action 2", "C:\\x.vbs", activation)
    assert json.loads(out["\\T"].details)["triggers"] == "logon,boot"
    assert (out["\\Bad"].reason, out["\\Locked"].reason) == ("corrupt", "locked")


def test_long_tasks_are_read_whole_or_reported(spark):
    def task(n):
        return TASK.format("true").replace("<Triggers>", f"<!--{'x' * n}--><Triggers>", 1).encode("utf-16")

    longest = task((4 << 20) // 2 - len(task(0)) // 2)
    assert len(longest) == 4 << 20
    rows = files(spark, ("\\Long", task(600_000), None), ("\\Longest", longest, None), ("\\Larger", longest + b" \0", None))
    out = {r.loc_path: r for r in detect.detect_tasks(rows).collect()}
    assert {k: (r.rule, r.status, r.reason, r.target) for k, r in out.items()} == {
        "\\Long": ("VBS-301", "detected", None, "C:\\x.vbs"), "\\Longest": ("VBS-301", "detected", None, "C:\\x.vbs"), "\\Larger": ("VBS-300", "notCheckable", "tooLarge", None),
    }


REGISTRY = "load_idx long, hive string, view string, key string, name string, value string, offline boolean"


def test_system_entries(spark):
    services = "SYSTEM\\CurrentControlSet\\Services\\"
    gp = "SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\Group Policy\\Scripts\\"
    rows = [
        ("HKLM", "native", RUN, "A", "wscript a.vbs", False),
        ("HKLM", "wow32", RUN.upper(), "B", "wscript b.vbs", False),
        ("HKLM", "native", "SOFTWARE\\Microsoft\\Windows NT\\CurrentVersion\\Winlogon", "Userinit", "C:\\userinit.exe,wscript u.vbs", False),
        ("HKLM", "native", "SOFTWARE\\Other", "A", "wscript no.vbs", False),
        ("HKU", "native", "S-1-5-7\\" + RUN, "C", "notepad", False),
        ("HKU", "native", "S-1-5-7\\" + RUN, "D", "cscript %1", False),
        ("HKU", "native", "S-1-5-7\\Environment", "UserInitMprLogonScript", "\\\\s\\logon.vbs", False),
        ("HKLM", "native", services + "Svc", "Type", "16", False),
        ("HKLM", "native", services + "Svc", "Start", "2", False),
        ("HKLM", "native", services + "Svc", "ImagePath", "\\??\\C:\\wrap.exe", False),
        ("HKLM", "native", services + "Svc\\Parameters", "Application", "cscript.exe", False),
        ("HKLM", "native", services + "Svc\\Parameters", "AppParameters", "s.vbs", False),
        ("HKLM", "native", services + "Driver", "Type", "1", False),
        ("HKLM", "native", services + "Driver", "ImagePath", "wscript d.vbs", False),
        ("HKLM", "native", gp + "Startup\\0", "FileSysPath", "\\\\d\\p", False),
        ("HKLM", "native", gp + "Startup\\0", "GPOName", "Policy", False),
        ("HKLM", "native", gp + "Startup\\0\\0", "Script", "boot.vbs", False),
        ("HKLM", "native", gp + "Startup\\0\\0", "Parameters", "/q", False),
        ("HKLM", "native", gp.replace("Scripts", "State\\Machine\\Scripts") + "Startup\\0", "FileSysPath", "\\\\D\\P", False),
        ("HKLM", "native", gp.replace("Scripts", "State\\Machine\\Scripts") + "Startup\\0\\0", "Script", "BOOT.vbs", False),
        ("HKLM", "native", gp.replace("Scripts", "State\\Machine\\Scripts") + "Startup\\0\\0", "Parameters", "/Q", False),
    ]
    out = system.detect_all(spark.createDataFrame([(0, *r) for r in rows], REGISTRY)).collect()
    assert sorted((r.rule, r.loc_path, r.loc_item or "", r.target) for r in out) == sorted(
        [
            ("VBS-311", "HKLM\\" + RUN, "A", "a.vbs"),
            ("VBS-311", "HKLM\\SOFTWARE\\WOW6432Node\\" + RUN.upper()[9:], "B", "b.vbs"),
            ("VBS-311", "HKLM\\SOFTWARE\\Microsoft\\Windows NT\\CurrentVersion\\Winlogon", "Userinit", "u.vbs"),
            ("VBS-312", "HKU\\S-1-5-7\\" + RUN, "D", "%1"),
            ("VBS-321", "Svc", "Parameters\\Application", "s.vbs"),
            ("VBS-341", "HKLM\\" + gp + "Startup\\0\\0", "", "\\\\d\\p\\Scripts\\Startup\\boot.vbs"),
            ("VBS-341", "HKU\\S-1-5-7\\Environment", "UserInitMprLogonScript", "\\\\s\\logon.vbs"),
        ]
    )


def test_offline_hives(spark):
    data = builders.hive({RUN: {"A": "wscript a.vbs"}})
    rows = [(0, "HKU", "native", k, n, str(v), True, "S-1-5-9") for k, n, _, v in Hive(data).walk()]
    out = system.autostart(spark.createDataFrame(rows, REGISTRY + ", sid string")).collect()
    assert [(r.loc_path, r.details["offlineHive"]) for r in out] == [("HKU\\S-1-5-9\\" + RUN, "true")]
    profiles = spark.createDataFrame([(0, "S-1", "a"), (0, "S-2", "b")], "load_idx long, sid string, folder string")
    loaded = spark.createDataFrame([(0, "s-1")], "load_idx long, sid string")
    assert [r.sid for r in system.unloaded_profiles(profiles, loaded).collect()] == ["S-2"]


def test_subscriptions(spark):
    ns = "ROOT\\subscription"
    rows = [
        (0, ns, "ActiveScriptEventConsumer", 'ActiveScriptEventConsumer.Name="A"', {"ScriptingEngine": "VBScript", "ScriptText": 'x = 1\nCreateObject("y")'}),
        (0, ns, "CommandLineEventConsumer", f'\\\\HOST\\{ns}:CommandLineEventConsumer.Name="B"', {"CommandLineTemplate": "wscript b.vbs"}),
        (0, ns, "CommandLineEventConsumer", 'CommandLineEventConsumer.Name="C"', {"ExecutablePath": "C:\\wscript.exe", "CommandLineTemplate": "c.vbs"}),
        (0, ns, "__EventFilter", '__EventFilter.Name="F"', {"Query": "select 1"}),
        (0, ns, "__FilterToConsumerBinding", "1", {"Consumer": 'commandlineeventconsumer.Name="B"', "Filter": '__EventFilter.Name="F"'}),
    ]
    wmi = spark.createDataFrame(rows, "load_idx long, namespace string, class string, path string, properties map<string,string>")
    out = system.detect_all(spark.createDataFrame([], REGISTRY), wmi).collect()
    got = {r.loc_path.partition(":")[2]: (r.rule, r.activation, r.target) for r in out}
    assert got == {'ActiveScriptEventConsumer.Name="A"': ("VBS-331", "dormant", None), 'CommandLineEventConsumer.Name="B"': ("VBS-331", "automatic", "b.vbs"), 'CommandLineEventConsumer.Name="C"': ("VBS-331", "dormant", "c.vbs")}
    assert any("select 1" in r.details for r in out)


EVENTS = "load_idx long, record_id long, provider string, event_id int, time timestamp, data map<string,string>"


def test_alerts(spark):
    from datetime import datetime

    t = [datetime(2026, 1, d) for d in range(1, 9)]
    rows = [
        (0, 1, "VBScriptDeprecationAlert", 4096, t[0], {"#1": "a.EXE", "#2": "a.exe;cmd.exe", "#3": ""}),
        (0, 2, "vbscriptdeprecationalert", 4096, t[3], {"ProcessName": "A.exe", "ProcessTree": "A.exe;cmd.exe"}),
        (0, 3, "VBScriptDeprecationAlert", 4096, t[2], {"#1": "text\nProcessName: b.exe\nProcessTree= b.exe;x"}),
        (0, 4, "VBScriptDeprecationAlert", 4096, t[1], {"#1": "c.exe;d.exe"}),
        (0, 5, "VBScriptDeprecationAlert", 4096, t[1], {"#1": "?"}),
        (0, 6, "Other", 4096, t[1], {"#1": "a.exe"}),
    ]
    out = {r.key: r for r in event_logs.alerts(spark.createDataFrame(rows, EVENTS)).collect()}
    assert {k: r.events for k, r in out.items()} == {"a.exe|a.exe;cmd.exe": 2, "b.exe|b.exe;x": 1, "c.exe|c.exe;d.exe": 1, "unknown|": 1}
    a = out["a.exe|a.exe;cmd.exe"]
    assert (a.program, a.first_seen, a.last_seen) == ("A.exe", t[0], t[3])
    channels = spark.createDataFrame([(0, t[0], t[7])], "load_idx long, oldest timestamp, newest timestamp")
    records = spark.createDataFrame([(0, "q", t[4]), (0, "q", t[5]), (0, "r", t[1])], "load_idx long, query string, time timestamp")
    assert event_logs.covered(channels, records, most=2).first().time_from == t[4]


def test_streamed_alerts_equal_the_batch(spark, tmp_path):
    from ferrule.plans.event_queries import records
    from ferrule.streaming import event_stream

    batch = records(spark, "/root/testdata/sf0.001")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = event_stream.to_memory(event_stream.running_groups(stream), "alerts_now").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    key = ["load_idx", "key", "events", "first_seen", "last_seen", "program"]
    assert sorted(map(tuple, spark.sql("select * from alerts_now").select(*key).collect())) == sorted(map(tuple, event_logs.alerts(batch).select(*key).collect()))


def test_newest_groups_however_the_stream_is_cut():
    """The kept records after any order, with repeats, are the newest ones; each change of a group is told."""
    import random

    import pandas as pd

    from ferrule.streaming import event_state

    rng = random.Random(6)
    records = pd.DataFrame([(i, pd.Timestamp(2026, 1, 1) + pd.Timedelta(hours=rng.randrange(40)), rng.choice("abc"), f"P{i}", None) for i in range(60)], columns=event_state.COLUMNS)
    want = records.sort_values(["time", "record_id"]).tail(9)
    for _ in range(20):
        order = [rng.randrange(60) for _ in range(30)] + rng.sample(range(60), 60)
        processor, kept, known = event_state.NewestGroups(9), pd.DataFrame(columns=event_state.COLUMNS), {}
        while order:
            n = rng.randrange(1, 25)
            had, kept = kept, event_state.merged(kept, records.iloc[order[:n]], 9).reset_index(drop=True)
            order = order[n:]
            for r in processor._changed(1, had, kept).itertuples():
                known[r.key] = (r.events, r.first_seen, r.last_seen, r.program)
        assert sorted(kept["record_id"]) == sorted(want["record_id"])
        span = known.pop(None)
        assert span[0] == 9 and (span[1], span[2]) == (want["time"].min(), want["time"].max())
        groups = {k: (len(g), g["time"].min(), g["time"].max(), g["program"].iloc[-1]) for k, g in want.groupby("key")}
        assert {k: v for k, v in known.items() if v[0]} == groups


def test_state_of_newest_groups_is_merged_by_rows():
    """A machine's rows meet its packed state without a frame; records without a time are the oldest."""
    from pyspark.sql import Row

    from ferrule.streaming import event_state

    class State:
        value = None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    processor, known = event_state.NewestGroups(3), {}
    processor.state = State()
    row = lambda i, at, key: Row(record_id=i, at=at, key=key, program=f"P{i}", process_tree=None)
    for part in ([row(1, 10, "a"), row(2, None, "b")], [row(3, 30, "a"), row(1, 10, "a")], [row(4, 20, "c"), row(2, None, "b")]):
        known |= {r.key: (r.load_idx, r.events, r.first_seen, r.last_seen, r.program, r.capped) for r in processor.handleInputRows((7,), iter(part), None)}
    assert known == {"a": (7, 2, 10, 30, "P3", False), "b": (7, 0, None, None, None, False), "c": (7, 1, 20, 20, "P4", False), None: (7, 3, 10, 30, None, True)}
    many = event_state.kept_of([], ((i, i % 977, "k", "p", None) for i in range(5000)), 3)
    assert [(r[0], r[1]) for r in many] == [(i, 976) for i in (2930, 3907, 4884)]


def test_source_status_and_limits(spark):
    rows = spark.createDataFrame(
        [(True, None, 0, False, True), (False, "skipped", 1, False, True), (False, None, 1, False, True), (False, None, 0, True, False), (False, None, 0, True, True)],
        "panicked boolean, declared string, errors int, needs_admin boolean, elevated boolean",
    )
    assert [r[0] for r in rows.select(detect.source_status()).collect()] == ["failed", "skipped", "partial", "partial", "complete"]
    scans = spark.createDataFrame(
        [(True, True, True, False, {"files.x": "partial"}), (False, False, False, True, {"tasks": "partial"}), (True, False, True, False, {"files.x": "failed"})],
        "supported boolean, elevated boolean, system_sources boolean, restricted boolean, statuses map<string,string>",
    )
    assert [r[0] for r in scans.select(detect.limitations()).collect()] == [[], ["unsupportedPlatform", "systemSourcesSkipped", "fileScopeRestricted", "sourceIncomplete"], ["notElevated", "sourceIncomplete"]]


def test_calls_are_followed_one_level(spark):
    rows = files(spark, ("C:\\one.cmd", b"@echo off\r\nstart other.cmd\r\ncscript %2\r\nwscript a.vbs\r\n", None), ("C:\\two.bat", b"rem\r\nmshta x.hta\r\n", None), ("C:\\locked.cmd", None, "locked"), ("C:\\none.cmd", b"dir\r\n", None))
    lines = ['cmd /c "C:/ONE.CMD" -x', r"C:\two.bat & C:\one.cmd", r"C:\two.bat", r"C:\locked.cmd", r"C:\none.cmd", r"C:\gone.cmd", r"wscript b.vbs & C:\one.cmd", None]
    entries = spark.createDataFrame([(0, i, x) for i, x in enumerate(lines)], "load_idx long, entry long, line string")
    got = {r.entry: r for r in detect.follow_calls(entries, rows).collect()}
    assert {k: (r.called, r.usage, r.script, r.number, r.reason) for k, r in got.items()} == {
        0: ("C:/ONE.CMD", "vbscript", "a.vbs", 4, None), 1: (r"C:\one.cmd", "vbscript", "a.vbs", 4, None), 2: (r"C:\two.bat", "unknown", "x.hta", 2, None), 3: (r"C:\locked.cmd", None, None, None, "locked"),
    }


def test_all_files_that_a_command_names_are_followed(spark):
    """However many there are; the first that runs the engine counts, wherever it stands."""
    idle = [f"C:\\idle{i}.cmd" for i in range(40)]
    rows = files(spark, ("C:\\run.cmd", b"wscript a.vbs\r\n", None), ("C:\\ask.bat", b"cscript %1\r\n", None), ("C:\\locked.ps1", None, "locked"), *[(p, b"dir\r\n", None) for p in idle])
    lines = [" & ".join([*idle[:n], *more]) for n, more in ((3, ["C:\\run.cmd"]), (40, ["C:\\ask.bat", "C:\\run.cmd"]), (3, ["C:\\ask.bat"]), (3, ["C:\\locked.ps1"]), (40, []))]
    got = detect.follow_calls(spark.createDataFrame([(0, i, x) for i, x in enumerate(lines)], "load_idx long, entry long, line string"), rows).collect()
    assert {r.entry: (r.called, r.usage, r.reason) for r in got} == {0: ("C:\\run.cmd", "vbscript", None), 1: ("C:\\run.cmd", "vbscript", None), 2: ("C:\\ask.bat", "unknown", None), 3: ("C:\\locked.ps1", None, "locked")}
    entries = spark.createDataFrame([(0, "HKLM", "native", RUN, "A", lines[0], False)], REGISTRY)
    found = detect.detect_commands(system.autostart(entries), "VBS-311", "VBS-312", "autostart", rows).collect()
    assert [(r.rule, r.loc_item, r.target) for r in found] == [("VBS-311", "A", "C:\\run.cmd")]


def called_files(spark):
    return files(
        spark,
        ("C:\\jobs\\run.cmd", b"@echo off\r\nstart x.vbs\r\n", None), ("C:\\jobs\\ask.cmd", b"cscript %1\r\n", None), ("C:\\jobs\\locked.cmd", None, "locked"),
        ("C:\\Windows\\Installer\\1.msi", builders.package({"CustomAction": ([("Action", "s"), ("Type", "h"), ("Source", "s"), ("Target", "s")], [{"Action": "A", "Type": 38, "Target": "MsgBox 1"}])}), None),
        ("C:\\Windows\\Installer\\2.msi", b"damaged", None), ("C:\\Windows\\Installer\\3.msi", None, "accessDenied"), ("C:\\Windows\\Installer\\4.msi", None, "locked"),
    )


def test_commands_are_followed_into_scripts(spark):
    services = "SYSTEM\\CurrentControlSet\\Services\\"
    run = {"A": "C:\\jobs\\run.cmd /pwd:abc", "B": "%JOBS%\\ask.cmd", "C": "cmd /c C:/jobs/./locked.cmd", "D": "\\\\s\\d\\r.cmd", "E": "C:\\jobs\\gone.cmd", "F": "run.cmd", "G": "cscript %1 & C:\\jobs\\run.cmd", "H": "%OTHER%\\run.cmd"}
    rows = [(0, "HKLM", "native", RUN, k, v, False) for k, v in run.items()]
    rows += [(0, "HKLM", "native", services + "S" + k, n, v, False) for k, n, v in (("", "Type", "16"), ("\\Parameters", "Application", "cmd"), ("\\Parameters", "AppParameters", "/c run.cmd"), ("\\Parameters", "AppDirectory", "%JOBS%"))]
    wmi = [(0, "ROOT\\subscription", "CommandLineEventConsumer", 'CommandLineEventConsumer.Name="B"', {"CommandLineTemplate": "run.cmd", "WorkingDirectory": "C:\\jobs"})]
    wmi = spark.createDataFrame(wmi, "load_idx long, namespace string, class string, path string, properties map<string,string>")
    variables = spark.createDataFrame([(0, {"JOBS": "C:\\jobs"})], "load_idx long, variables map<string,string>")
    out = system.detect_all(spark.createDataFrame(rows, REGISTRY), wmi, called_files(spark), variables).collect()
    assert {(r.rule, r.loc_item, r.kind, r.reason, r.target) for r in out} == {
        ("VBS-311", "A", "autostart", None, "C:\\jobs\\run.cmd"), ("VBS-901", "A", "hardcodedCredential", None, None), ("VBS-312", "B", "autostart", None, "C:\\jobs\\ask.cmd"), ("VBS-300", "C", "autostart", "locked", "C:/jobs/./locked.cmd"),
        ("VBS-300", "D", "autostart", "networkLocation", "\\\\s\\d\\r.cmd"), ("VBS-311", "G", "autostart", None, "C:\\jobs\\run.cmd"), ("VBS-321", "Parameters\\Application", "service", None, "%JOBS%\\run.cmd".replace("%JOBS%", "C:\\jobs")), ("VBS-331", None, "wmiSubscription", None, "C:\\jobs\\run.cmd"),
    }
    a = next(r for r in out if (r.rule, r.loc_item) == ("VBS-311", "A"))
    assert json.loads(a.details) == {"autostartType": "run", "via": "script", "calledScriptStarts": "x.vbs"} and a.evidence[1].text == "run.cmd:2: start x.vbs"


def test_tasks_are_followed_into_scripts(spark):
    one = "<Task><Actions><Exec><Command>run.cmd</Command><WorkingDirectory>C:\\jobs</WorkingDirectory></Exec><Exec><Command>C:\\jobs\\locked.cmd</Command></Exec></Actions></Task>"
    out = detect.detect_tasks(files(spark, ("\\T", one.encode(), None)), called_files(spark)).collect()
    assert {(r.rule, r.loc_item, r.kind, r.reason, r.target, r.activation) for r in out} == {
        ("VBS-301", "action 1", "scheduledTask", None, "C:\\jobs\\run.cmd", "automatic"), ("VBS-300", "action 2", "scheduledTask", "locked", "C:\\jobs\\locked.cmd", "automatic"),
    }
    assert json.loads(next(r.details for r in out if r.rule == "VBS-301")) == {"enabled": True, "via": "script", "calledScriptStarts": "x.vbs"}


def test_installed_packages(spark):
    key = "SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\Installer\\UserData\\S-1-5-18\\Products\\{}\\InstallProperties"
    codes = {str(i): f"{i}" * 32 for i in range(1, 6)}
    rows = [(0, "HKLM", "native", key.format(c), "LocalPackage", f"%SystemRoot%\\Installer\\{i}.msi", False) for i, c in codes.items()]
    rows += [(0, "HKLM", "native", key.format(codes["1"]), "DisplayName", "Product", False)]
    variables = spark.createDataFrame([(0, {"SYSTEMROOT": "C:\\Windows"})], "load_idx long, variables map<string,string>")
    out = system.detect_all(spark.createDataFrame(rows, REGISTRY), None, called_files(spark), variables).collect()
    code = lambda i: "{" + "-".join(i * n for n in (8, 4, 4, 4, 12)) + "}"
    assert {(r.rule, r.loc_kind, r.loc_path, r.loc_item, r.reason) for r in out} == {("VBS-402", "msiPackage", code("1"), "A", None), ("VBS-400", "msiPackage", code("2"), None, "corrupt"), ("VBS-400", "msiPackage", code("4"), None, "locked")}
    assert json.loads(next(r.details for r in out if r.rule == "VBS-402"))["productName"] == "Product"
    cached = detect.detect_files(called_files(spark).where("path like '%msi'"), "C:\\WINDOWS\\Installer\\")
    assert cached.count() == 0


def test_limits_of_files_by_detector(spark, monkeypatch):
    """Of each detector the size that is read and the next one, which is reported."""
    from ferrule.operators import binary_detectors  # noqa: F401

    assert {f.__name__: detect.MOST[f] for f in detect.MOST}.items() >= {"script_files": 16 << 20, "invocations": 16 << 20, "policy_scripts": 16 << 20, "shortcuts": 1 << 20, "packages": 64 << 20}.items()
    monkeypatch.setitem(detect.MOST, detect.script_files, 10)
    monkeypatch.setitem(detect.MOST, detect.invocations, 10)
    batch = pd.DataFrame([(0, path, b"x = 1", size, None) for path in ("a.vbs", "b.cmd") for size in (10, 11)], columns=["load_idx", "path", "content", "size", "problem"])
    found = [(f.rule, f.loc_path, f.reason) for _, f in detect._inspect_files(batch)]
    assert ("VBS-100", "a.vbs", "tooLarge") in found and ("VBS-200", "b.cmd", "tooLarge") in found and ("VBS-101", "a.vbs", None) in found and len(found) == 3


def test_one_entry_does_not_stop_others(spark, monkeypatch):
    def broken(path, content):
        if content == b"bad":
            raise RuntimeError
        return []

    assert detect._safely(broken, "t", b"bad")[0][-1] == "internalError" and detect._safely(broken, "t", b"good") == []


def test_equal_entries_are_worked_out_once(monkeypatch):
    from ferrule.functions import command, markup, masking

    calls = []
    for module, name in ((markup, "tags"), (command, "_uses"), (command, "_callees")):
        real = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, real=real, name=name: (calls.append(name), real(*a))[1])
    definition = b"<Task><Actions><Exec><Command>wscript</Command><Arguments>once-%d.vbs</Arguments></Exec></Actions></Task>"
    got = [detect.inspect_task(f"T{i}", definition % (i % 3)) for i in range(300)]
    assert [(x[0][0], x[0][3]) for x in got] == [(f"T{i}", f"wscript once-{i % 3}.vbs") for i in range(300)] and calls.count("tags") == 3
    line = "wscript once.vbs & call once.cmd"
    assert all(command.analyze(line) == command.analyze(line) and command.called_scripts(line) == ["once.cmd"] for _ in range(100))
    assert calls.count("_uses") == 1 and calls.count("_callees") == 1
    command.analyze(line).clear()
    assert command.analyze(line)  # what callers do with a result stays theirs
    # long ones aren't kept
    calls.clear()
    assert [command.analyze("wscript once.vbs " + "x" * 5000) for _ in range(2)] and calls.count("_uses") == 2
    assert masking.mask_line("set DBPASSWORD=once") == masking.mask_line("set DBPASSWORD=once") == ("set DBPASSWORD=********", ["password"])
