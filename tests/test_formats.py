import io
import zipfile

import pytest

from ferrule.functions import vba
from ferrule.sources.formats import hive, office, package, shell_link, vba_project
from ferrule.sources.formats.compound import CompoundFile
from ferrule.sources.formats.raw import DamagedFile

from . import builders

SOURCE = """Attribute VB_Name = "M"
Sub Workbook_Open()
  Dim r As Object ' "VBScript.RegExp"
  Set r = CreateObject("VBScript.RegExp")
  Rem CreateObject("WScript.Shell")
  x = 1: Rem "y.vbs"
  Set sc = CreateObject("MSScriptControl.ScriptControl")
  sc.Language = "VBScript"
  wsh.Run "wscript " & Chr(34) & path & "\\x.vbs" & Chr(34), 0
  Shell _
     "cscript //nologo C:\\a.vbs", vbHide
  w.execScript "a, b", "JScript"
  w.execScript f(1, 2), "vbs"
  Kill "C:\\old.vbs"
  Set s = CreateObject("WScript.Shell")
End Sub
"""


def test_compound_files():
    data = builders.compound({"a/b/one": b"1" * 5000, "a/two": b"2", "Three": b"3" * 70_000})
    file = CompoundFile(data)
    assert file.read(file.find("A/B/ONE")) == b"1" * 5000 and file.read(file.find("three")) == b"3" * 70_000
    assert sorted(p for p, _ in file.walk()) == ["Three", "a", "a/b", "a/b/one", "a/two"]
    for cut in (b"", b"x" * 600, data[:600], data[:8] + b"\xff" * 600):
        with pytest.raises(DamagedFile):
            CompoundFile(cut)


def test_shell_links():
    link = shell_link.parse(builders.shell_link(r"C:\Windows\System32\wscript.exe", r'"C:\a b.vbs"', r"C:\Work"))
    assert (link.target, link.arguments, link.folder) == (r"C:\Windows\System32\wscript.exe", r'"C:\a b.vbs"', r"C:\Work")
    assert shell_link.parse(builders.shell_link(arguments="x")).target is None
    whole = builders.shell_link("C:\\x.vbs", "y")
    for n in (0, 10, 0x50, len(whole) - 1):
        with pytest.raises(DamagedFile):
            shell_link.parse(whole[:n])


def test_hives():
    run = "Software\\Microsoft\\Windows\\CurrentVersion\\Run"
    file = hive.Hive(builders.hive({run: {"A": "wscript a.vbs", "N": 7}, "Environment": {"X": "y"}}))
    assert file.values(file.find(run.upper())) == [("A", 1, "wscript a.vbs"), ("N", 4, 7)] and file.find("No\\Key") is None
    assert sorted((k, n) for k, n, _, _ in file.walk()) == [("Environment", "X"), (run, "A"), (run, "N")]
    with pytest.raises(DamagedFile):
        hive.Hive(b"regf" + b"\0" * 5000)


def test_packages():
    tables = {
        "Property": ([("Property", "s"), ("Value", "s")], [{"Property": "ProductName", "Value": "Tool"}, {"Property": "CODE", "Value": "MsgBox 2"}]),
        "CustomAction": (
            [("Action", "s"), ("Type", "h"), ("Source", "s"), ("Target", "s")],
            [{"Action": "A", "Type": 6, "Source": "S1", "Target": "Main"}, {"Action": "B", "Type": 6 | 0x20 | 0x40, "Target": "MsgBox 1"}, {"Action": "C", "Type": 6 | 0x30, "Source": "CODE"}, {"Action": "D", "Type": 1, "Source": "x"}],
        ),
        "InstallExecuteSequence": ([("Action", "s"), ("Condition", "s"), ("Sequence", "h")], [{"Action": "A", "Condition": "NOT X", "Sequence": 10}, {"Action": "B", "Sequence": 11}]),
    }
    found = package.analyze(builders.package(tables, {"S1": b"' start\nCreateObject(1)\n"}))
    assert found.product == "Tool"
    assert [(a.name, a.source, a.scheduled, a.goes_on, a.condition, a.target) for a in found.actions] == [
        ("A", "binary", True, False, "NOT X", "Binary.S1"), ("B", "inline", True, True, None, None), ("C", "property", False, False, None, "Property.CODE"),
    ]
    assert [(a.script or "") for a in found.actions] == ["' start\nCreateObject(1)\n", "MsgBox 1", "MsgBox 2"]
    with pytest.raises(DamagedFile):
        package.analyze(builders.compound({"x": b""}))


def test_decompression():
    assert vba_project.decompress(builders.compress(b"abc" * 3000)) == b"abc" * 3000
    # the specification's own example of copied text
    example = bytes.fromhex("012fb000236161616263646582660070616768696a013808616b6c00306d6e6f70067102700410727374757610777879 7a003c")
    assert vba_project.decompress(example) == b"#aaabcdefaaaaghijaaaaaklaaamnopqaaaaaaaaaaaarstuvwxyzaaa"
    for bad in (b"", b"\x02", b"\x01\x00\x00", b"\x01\x03\xb0\x01\x00\x00"):
        with pytest.raises(DamagedFile):
            vba_project.decompress(bad)


def test_uses_in_code():
    uses = vba.analyze_module("M", vba.logical_lines(SOURCE))
    assert [(u.kind, u.target, u.lines[0][0]) for u in uses] == [
        (vba.REGEXP, "VBScript.RegExp", 3),
        (vba.ENGINE, "MSScriptControl.ScriptControl", 6),
        (vba.ENGINE, "execScript", 12),
        (vba.STARTS, "…\\x.vbs", 8),
        (vba.STARTS, "C:\\a.vbs", 9),
        (vba.WSH, "WScript.Shell", 14),
    ]
    assert vba.auto_macro("Private Sub Document_Open()") == "Document_Open" and vba.auto_macro("Sub Other()") is None


@pytest.mark.parametrize(
    ("code", "kinds"),
    [
        ('x = CreateObject("ScriptControl"): x.Language = lang', [vba.ENGINE_UNKNOWN]),
        ('Dim s As New ScriptControl\ns.Language = "JScript"', []),
        ("Dim s As New WshShell", [vba.WSH]),
        ('FileCopy "a.vbs", "b.vbs"', []),
        ('Shell "mshta " & name', [vba.STARTS_UNKNOWN]),
        ("' Shell \"x.vbs\"", []),
        ('s = "it""s": Shell "c:\\q.vbs"', [vba.STARTS]),
    ],
)
def test_single_uses(code, kinds):
    assert [u.kind for u in vba.analyze_module("M", vba.logical_lines(code))] == kinds


LIBRARY = r"*\G{3F4DACA7-160D-11D2-A8E9-00104B365C9F}#5.5#0#C:\Windows\System32\vbscript.dll\3#Microsoft VBScript Regular Expressions 5.5"


def test_office_documents():
    data = builders.compound(builders.vba_streams({"M": SOURCE, "N": "Dim r As New RegExp"}, [("VBScript_RegExp_55", LIBRARY)], "Macros/"))
    document = office.analyze(data, "x.doc")
    project = document.projects[0].project
    assert [m.name for m in project.modules] == ["M", "N"] and project.modules[0].source == SOURCE
    last = vba.analyze(project)[-1]
    assert (last.kind, last.reference, last.lines[1][1]) == (vba.REGEXP, "VBScript_RegExp_55", "N:1: Dim r As New RegExp")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/vbaProject.bin", builders.compound(builders.vba_streams({"M": SOURCE})))
        z.writestr("xl/embeddings/inner.docm", b"PK\x03\x04 damaged")
    document = office.analyze(out.getvalue(), "x.xlsm")
    assert [p.storage for p in document.projects] == ["xl/vbaProject.bin"] and not document.obstacles
    assert office.analyze(builders.compound({"EncryptedPackage": b"x", "EncryptionInfo": b"y"})).obstacles[0][0] == "passwordProtected"
    assert office.analyze(b"PK\x03\x04 damaged").obstacles[0][0] == "corrupt"
    assert office.analyze(b"<html>").obstacles == []


def test_hidden_modules():
    streams = builders.vba_streams({"M": SOURCE, "Gone": "x"})
    del streams["VBA/Gone"]
    project = office.analyze(builders.compound(streams)).projects[0].project
    assert [m.problem for m in project.modules] == [None, "no module stream"]


def test_protection_fields():
    assert vba_project.unlock("zz") is None and vba_project.unlock("0102") is None
    plain, seed, key = b"\x01\x00\x00\x00", 0x04, 0x55
    # encoded as the specification tells: seed, version, key, ignored bytes, size, data
    raw, last, older, clear = [seed, 2 ^ seed, key ^ seed], key ^ seed, 2 ^ seed, key
    for b in [9] * ((seed & 6) >> 1) + list(len(plain).to_bytes(4, "little")) + list(plain):
        c = b ^ (older + clear & 0xFF)
        raw.append(c)
        older, last, clear = last, c, b
    assert vba_project.unlock(bytes(raw).hex()) == plain
