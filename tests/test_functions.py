import base64
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ferrule.functions import command, details, masking, messages, paths, script_lines, text
from ferrule.functions import script as script_module


def restated(path: str) -> str:
    """The rule for paths, step by step."""
    blank = lambda c: c.isspace() or c in "\x85"
    while path and blank(path[0]):
        path = path[1:]
    while path and blank(path[-1]):
        path = path[:-1]
    path = path.strip('"').replace("/", "\\")
    if path.startswith("\\\\?\\UNC\\"):
        path = "\\\\" + path[8:]
    elif path.startswith("\\\\?\\"):
        path = path[4:]
    while len(path.encode()) > 3 and path.endswith("\\"):
        path = path[:-1]
    return path.lower()


def test_normalize_matches_its_rule(spark):
    import random

    rng = random.Random(4)
    parts = ["C:", "\\", "\\\\", "/", "?", "\\\\?\\", "UNC\\", '"', " ", "\t", "é", "€", "😀", "a", "B.vbs", "%X%"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 7))) for _ in range(3000)] + ["\\\\?\\UNC\\srv\\s\\", "C:\\", "C:\\\\", "éé\\", "é\\\\", "\\\\\\\\"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", paths.normalize("t").alias("n")).collect()
    assert [(r.t, r.n) for r in got if r.n != restated(r.t)] == []


@pytest.mark.parametrize(
    ("path", "windows"),
    [
        ("c:\\windows\\winsxs\\x\\a.vbs", True),
        ("d:\\containers\\windowsfilter\\abc\\files\\windows\\a.vbs", True),
        ("d:\\windowsfilter\\abc\\utilityvm\\files\\windows\\a.vbs", True),
        ("d:\\windowsfilter\\abc\\files\\app\\a.vbs", False),
        ("d:\\windowsfilter\\a\\b\\windowsfilter\\abc\\files\\windows\\a.vbs", False),
        ("c:\\windows\\system32\\logfiles\\sum\\current.mdb", True),
        ("c:\\windows\\system32\\logfiles\\sum\\current.txt", False),
        ("c:\\windows\\system32\\a.vbs", False),
    ],
)
def test_windows_locations(spark, path, windows):
    assert spark.createDataFrame([(path,)], "p string").select(paths.is_windows_location("p")).first()[0] is windows


def test_path_parts(spark):
    rows = spark.createDataFrame([("\\\\srv\\s\\a.b.vbs",), ("c:\\x\\noext",), ("%dir%\\a.hta",), (None,)], "p string")
    got = rows.select(paths.is_network("p"), paths.is_absolute("p"), paths.file_name("p"), paths.extension("p"), paths.is_script_file("p")).collect()
    assert [tuple(r) for r in got] == [
        (True, True, "a.b.vbs", "vbs", True),
        (False, True, "noext", None, False),
        (False, False, "a.hta", "hta", True),
        (None, None, None, None, False),
    ]


CERTAIN = [
    r"WSCRIPT D:\jobs\copy.vbs",
    r'"C:\Windows\System32\cscript.exe" //nologo "D:\my jobs\load.vbs" -all',
    r"cscript //e:vbscript D:\jobs\list.dat",
    r'start "window" /min D:\jobs\copy.vbe',
    r'cmd.exe /d /c "cscript //b D:\jobs\copy.vbs && exit 0"',
    r"%comspec% /k wscript copy.vbs",
    r"""pwsh -NoLogo -Command "& cscript 'D:\jobs\copy.vbs'" """,
    r'obj.Exec("cscript.com //t:5 D:\jobs\copy.vbs")',
    r'psexec \\pc7 -d "wscript.exe D:\jobs\copy.vbs"',
    r"for %%i in (1 2) do wscript D:\jobs\copy.vbs %%i",
    "rundll32 x,y vbscript:Close",
    "powershell -ec " + base64.b64encode(r"wscript D:\jobs\copy.vbs".encode("utf-16-le")).decode(),
]
POSSIBLE = [r"wscript D:\jobs\many.wsf", r"mshta D:\tools\form.hta", "wscript %2", r"D:\tools\form.hta"]
NONE = [r"cscript D:\jobs\tidy.js", "mshta about:blank", "cscript", r"xcopy D:\jobs\copy.vbs E:", r"erase copy.vbs", r"edit D:\jobs\copy.vbs.bak", " ", None]


@pytest.mark.parametrize("line", CERTAIN)
def test_certain_uses(line):
    assert command.strongest(command.analyze(line)) == command.VBSCRIPT


@pytest.mark.parametrize("line", POSSIBLE)
def test_possible_uses(line):
    assert command.strongest(command.analyze(line)) == command.UNKNOWN


@pytest.mark.parametrize("line", NONE)
def test_no_uses(line):
    assert command.analyze(line) == []


def test_called_scripts():
    assert command.called_scripts(r'cmd /c "D:\my jobs\every day.cmd" -x') == [r"D:\my jobs\every day.cmd"]
    assert command.called_scripts(r"pwsh -File D:\jobs\one.ps1 & call two.bat & call two.bat") == [r"D:\jobs\one.ps1", "two.bat"]
    assert command.called_scripts(r'at 10:00 "cmd /c D:\jobs\three.kix"') == [r"D:\jobs\three.kix"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc \"'&|;^\\/:.vbs\n%-", max_size=60))
def test_analysis_never_fails(line):
    command.analyze(line)
    command.called_scripts(line)


SECRETS = [
    ('userPwd = "Blue7Sky"', ["password"]),
    ('db.Open "Server=a;User=b;Password=Blue7Sky"', ["connectionString"]),
    ("set MYSQL_PASSWORD=Blue7Sky", ["password"]),
    ('tool -password "Blue7Sky"', ["password"]),
    ("https://user:pw1@host/x", ["urlCredentials"]),
    ("x = 1", []),
]


@pytest.mark.parametrize(("line", "kinds"), SECRETS)
def test_masking(spark, line, kinds):
    masked, found = masking.mask_line(line)
    assert found == kinds and masking.mask_line(masked) == (masked, [])
    assert spark.createDataFrame([(line,)], "t string").select(masking.mask_column("t")).first()[0] == masked


def test_decoding():
    assert text.decode("﻿äb".encode()) == "äb"
    assert text.decode("\ufeffäb".encode("utf-16-le")) == "äb"
    assert text.decode("Dim x As String".encode("utf-16-le")) == "Dim x As String"
    assert text.decode(b"gr\xfc\xdfe") == "grüße"


def test_lines_agree(spark):
    texts = ["", "a", "a\r\nb\rc\n", "\n", "a\n\n"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.lines_column("t").alias("l")).collect()
    assert {r.t: r.l for r in got} == {t: text.lines(t) for t in texts}
    assert [text.line_number("a\r\nb\rc", i) for i in (0, 3, 5)] == [1, 2, 3]


def test_excerpts(spark):
    long = "x" * 300
    row = spark.createDataFrame([(long, "a\x01b\tc")], "a string, b string").select(text.shorten_column("a"), text.clean_column("b")).first()
    assert row[0] == text.shorten(long) and len(row[0]) == 240 and row[1] == text.clean("a\x01b\tc") == "a b\tc"
    assert len(text.cell("ä" * 20000).encode()) <= text.CELL_BYTES


def test_servicing_data(spark):
    blobs = [b"DCM\x01xx", b"PA30\x01\x02", b"1234PA31abcd\x03", b"PA30zzzzzzzzzzzz", b"Dim x"]
    got = [r[0] for r in spark.createDataFrame([(bytearray(b),) for b in blobs], "c binary").select(text.is_servicing_column("c")).collect()]
    assert got == [text.is_servicing_data(b) for b in blobs] == [True, True, True, False, False]


def test_names_and_ids():
    assert text.expand("%SystemRoot%\\x %no name% %Unknown%", {"SYSTEMROOT": "C:\\Windows"}) == "C:\\Windows\\x %no name% %Unknown%"
    assert text.unpack_guid("21436587A9CB0FED1032547698BADCFE") == "{78563412-BC9A-DEF0-0123-456789ABCDEF}"
    assert text.extension('"C:\\x\\A.VBS"') == "vbs" and text.extension("a.b c") is None


def test_hours(spark):
    from ferrule.operators.summary import format_hours

    values = [0.25, 0.1, 1.0, 1.25, 9.96, 10.5, 11.5, 120.0, 0.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "h double").select(format_hours("h")).collect()]
    assert got == ["0.25", "0.1", "1", "1.2", "10", "10", "12", "120", "0"]


def test_rank(spark):
    from ferrule.operators.assessment import rank

    got = spark.createDataFrame([("automatic",), ("dormant",), ("later",), (None,)], "a string").select(rank("a")).collect()
    assert [r[0] for r in got] == [6, 1, 3, 3]


def test_script_lines_agree_with_those_of_one_text(spark):
    """Block comments that open, close, nest and never end, in every language, over random scripts."""
    rng = random.Random(4)
    parts = ["<# open", "x <# not at the start", "close #> y", "<# both #> z", "  <#", "#>", "# note", "; note", "REM note", "rem", "remark", "@echo off", "echo.", "echo/x", ":: note", "' note", "", " \t ", "set o = CreateObject(\"x\")", "WScript.Echo 1", "copy a b", "　# wide", "x.Run \"y\""]
    rows = []
    for i in range(120):
        text_ = "".join(rng.choice(parts) + rng.choice(["\n", "\r\n", "\r", "\n\n"]) for _ in range(rng.randrange(14)))
        rows.append((i, rng.choice(list(script_module.LANGUAGES.values()) + ["vbscript"]), rng.choice([text_, text_ + "last line"])))
    rows += [(900, "batch", None), (901, "powershell", "<#"), (902, "other", "x")]
    files = spark.createDataFrame(rows, "i int, language string, text string")
    got, shown = {}, {}
    code = script_lines.code_lines(files, ["i"])
    for r in code.collect():
        got.setdefault(r.i, []).append((r.number, r.line))
    for r in script_lines.evidence(code, ["i"], 3).collect():
        shown.setdefault(r.i, []).append((r.number, r.line))
    for i, language, t in rows:
        want = script_module.code_lines(t or "", language) if language != "other" else []
        assert sorted(got.get(i, [])) == want
        assert sorted(shown.get(i, [])) == script_module.evidence(want, 3)


def test_cells_are_cut_between_characters(spark):
    rows = [(lead + c * 40,) for c in ("a", "é", "中", "\U0001f600") for lead in ("", "x", "xx", "xxx")] + [("short",), (None,), ("",)]
    got = spark.createDataFrame(rows, "s string").select("s", text.cell_column("s", 50).alias("cut")).collect()
    assert all(r.cut == (None if r.s is None else text.cell(r.s, 50)) and len((r.cut or "").encode()) <= 50 for r in got)


def test_messages(spark):
    locales = {"de-AT": "de", "de_DE.UTF-8": "de", "pt-PT": "pt-BR", "pt_br": "pt-BR", "fr-CA@euro": "fr", "ja-JP": "en", "": "en", None: "en", "DE": "de", "deutsch": "en"}
    got = spark.createDataFrame([(x,) for x in locales], "x string").select("x", messages.negotiate("x").alias("lang")).collect()
    assert {r.x: r.lang for r in got} == locales
    forms = spark.range(140).select("id", *[messages.plural(F.lit(x), "id").alias(x.replace("-", "")) for x in ("pl", "fr", "en", "ptBR", "pt-BR")]).collect()
    assert [forms[n].pl for n in (0, 1, 2, 4, 5, 12, 14, 21, 22, 25, 112, 122)] == ["many", "one", "few", "few", "many", "many", "many", "many", "few", "many", "many", "few"]
    assert (forms[0].fr, forms[1].fr, forms[2].fr, forms[0].en, forms[1].en) == ("one", "one", "other", "other", "one")
    rows = spark.createDataFrame([("{a} {b} {} {x-y} {a}{", 1, "{b}"), (None, 2, None)], "t string, a int, c string")
    assert [r[0] for r in rows.select(messages.filled("t", {"a": F.col("a"), "c": F.col("c")})).collect()] == ["1 {b} {} {x-y} 1{", None]
    own = messages.Messages({"en": {"k": "all {v}", "n.other": "{n} things"}, "de": {"k": "alle {v}"}})
    rows = spark.createDataFrame([("de", "k"), ("fr", "k"), ("de", "none")], "lang string, key string")
    assert [r[0] for r in rows.select(own.text("lang", "key", v=F.lit("{k}"))).collect()] == ["alle {k}", "all {k}", "none"]
    assert [r[0] for r in rows.select(own.counted("lang", F.lit("n"), F.lit(1))).collect()] == ["1 things"] * 3


def test_details_keep_their_types(spark):
    rows = ['{"n": 5, "s": "5", "b": true, "z": null, "it\'s": "q"}', "{}", "no json", None]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").withColumn("d", details.parsed("x"))
    typed = [f("d", k).alias(f"{k}_{f.__name__}") for k in ("n", "s", "b", "z") for f in (details.number, details.text, details.flag)]
    got = d.select("i", *typed, details.text("d", "it's").alias("q"), details.names("d").alias("names"), details.kind("d", "z").alias("kind")).orderBy("i").collect()
    assert {k: v for k, v in got[0].asDict().items() if v is not None} == {"i": 0, "n_number": 5, "s_text": "5", "b_flag": True, "q": "q", "names": ["b", "it's", "n", "s", "z"]}
    assert [r.names for r in got[1:]] == [[], None, None] and d.select(details.shown("d")).first()[0].startswith("{")


def test_modules_name_rules_of_the_catalog():
    from ferrule.sources import catalog

    known = {r[0] for r in catalog.RULES}
    assert len({m[0] for m in catalog.MODULES}) == len(catalog.MODULES)
    assert {x for m in catalog.MODULES for x in (*m[2], m[3])} <= known
