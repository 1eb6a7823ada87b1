import io
import json
import os
import re
import shutil
import zipfile
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ferrule.operators import finding_list, report, summary
from ferrule.sources import catalog, container, container_source, event_xml, files, import_state, listing, stores

SCAN = {
    "format": container.WRITTEN_TYPE, "schemaVersion": 1, "scanId": "0b9c3e0e-5a0c-4f67-9f55-3d1f2e8a7c11",
    "generator": {"product": "p", "component": "collector", "version": "1", "rulesAsOf": "2026-01-01", "platform": "windows"},
    "startedAt": "2026-01-02T08:00:00.000Z", "finishedAt": "2026-01-02T09:00:00+00:00",
    "machine": {"hostname": "SRV-1", "domain": "corp.example", "os": {"family": "windows", "build": 20348, "productType": "server"}},
    "scope": {"localDrives": True, "systemSources": True},
    "coverage": {"mode": "full", "elevated": True, "sources": [{"source": "files.localDrives", "status": "complete", "entries": 9, "errorSamples": ["x"] * 30}]},
    "findings": [
        {"id": "f1", "rule": "VBS-101", "kind": "scriptFile", "classification": "breaks", "status": "detected", "activation": "dormant", "location": {"type": "file", "path": "C:\\a.vbs"},
         "file": {"size": 10, "sha256": "ab"}, "evidence": [{"line": 1, "text": 'pwd = "Secret9"'}], "details": {"n": 1, "s": "x", "b": True}, "later": 1},
        {"id": "f2", "rule": "VBS-600", "kind": "newKind", "classification": "later", "status": "notCheckable", "reason": "locked", "activation": "dormant", "location": {"type": "file", "path": "C:\\b.xls"}},
    ],
}


def packed(scan, mimetype=container.WRITTEN_TYPE, name=container.RESULT):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", mimetype)
        z.writestr(name, scan if isinstance(scan, (str, bytes)) else json.dumps(scan))
    return out.getvalue()


def changed(**paths):
    scan = json.loads(json.dumps(SCAN))
    for path, value in paths.items():
        *way, last = path.split("__")
        node = scan
        for part in way:
            node = node[int(part) if part.isdigit() else part]
        if value is KeyError:
            del node[last]
        else:
            node[last] = value
    return scan


def test_round_trip():
    data = container.to_bytes(SCAN)
    back = container.read(data)
    assert "Secret9" not in json.dumps(back) and back["findings"][0]["evidence"][0]["masked"] is True
    assert len(back["coverage"]["sources"][0]["errorSamples"]) == 20
    assert container.read(container.to_bytes(back)) == back, "writing again changes nothing"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.namelist() == ["mimetype", "result.json"] and z.infolist()[0].compress_type == zipfile.ZIP_STORED
    assert container.unknown_values(SCAN) == 2


@pytest.mark.parametrize(
    ("data", "code"),
    [
        (b"", "notAResultFile"), (b"PK\x03\x04 damaged", "notAResultFile"), (packed(SCAN, "text/plain"), "wrongFormat"), (packed("{"), "invalid"), (packed(SCAN, name="other"), "invalid"),
        (packed(changed(schemaVersion=2)), "newerSchema"), (packed(changed(schemaVersion=0)), "invalid"), (packed(changed(schemaVersion=KeyError)), "invalid"), (packed([]), "invalid"),
        (packed(changed(machine__hostname=" ")), "invalid"), (packed(changed(finishedAt="2026-01-01T00:00:00Z")), "invalid"), (packed(changed(startedAt="yesterday")), "invalid"),
        (packed(changed(findings__1__id="f1")), "invalid"), (packed(changed(findings__0__rule="VBS-1")), "invalid"), (packed(changed(findings__0__reason="locked")), "invalid"),
        (packed(changed(findings__1__reason=KeyError)), "invalid"), (packed(changed(findings__0__location__path="x" * 40_000)), "limitExceeded"), (packed(changed(findings__0__file__size=-1)), "invalid"),
        (packed(changed(findings__0__details={str(i): i for i in range(65)})), "limitExceeded"), (packed(changed(machine__os=KeyError)), "invalid"), (packed(changed(scope__localDrives="yes")), "invalid"),
        (packed(changed(format="application/x")), "wrongFormat"),
    ],
)
def test_rejected(data, code):
    with pytest.raises(container.FormatError) as e:
        container.read(data)
    assert e.value.code == code


def test_too_many_entries():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(17):
            z.writestr(str(i), "")
    with pytest.raises(container.FormatError, match="limitExceeded"):
        container.read(out.getvalue())


@pytest.fixture
def folder(tmp_path):
    ids = [f"0b9c3e0e-5a0c-4f67-9f55-3d1f2e8a7c{i:02}" for i in range(9)]
    for name, scan in {
        "a.SCAN": changed(scanId=ids[0]), "sub/b.scan": changed(scanId=ids[1], machine__hostname="pc-2"), "c.scan": changed(scanId=ids[0]), "sub/d.scan": changed(scanId=ids[2], machine__hostname="PC-3"),
        "e.scan": changed(scanId=ids[3], startedAt="2026-01-02T08:30:00Z"), "f.scan": changed(schemaVersion=7), "g.txt": SCAN,
    }.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(packed(scan))
    (tmp_path / "h.scan").write_bytes(b"damaged")
    return tmp_path


def test_import(spark, folder):
    rows = container.read_files(spark, str(folder), "scan")
    name = lambda f: f.rpartition("/")[2]
    outcome = {name(r.file): r.outcome for r in container.imported(rows).collect()}
    assert outcome == {"a.SCAN": "accepted", "b.scan": "accepted", "c.scan": "duplicate", "d.scan": "accepted", "e.scan": "accepted", "f.scan": "error", "h.scan": "error"}
    limited = {name(r.file): r.outcome for r in container.imported(rows, machine_limit=2).collect()}
    assert limited["d.scan"] == "overLimit" and limited["b.scan"] == "accepted"
    errors = {name(r.file): r.error for r in rows.where("error is not null").collect()}
    assert errors == {"f.scan": "newerSchema", "h.scan": "notAResultFile"}
    order = container.load_order(container.imported(rows)).orderBy("load_idx").collect()
    assert [(r.load_idx, name(r.file)) for r in order] == [(0, "b.scan"), (1, "d.scan"), (2, "a.SCAN"), (3, "e.scan")]
    a = container.assess_files(spark, str(folder), "scan")
    assert sorted(r.hostname for r in a.machines.collect()) == ["PC-3", "SRV-1", "pc-2"] and [r.why for r in a.set_aside.collect()] == ["superseded"]
    assert {r.loc_path: r.machines for r in a.items.collect()} == {"C:\\a.vbs": 3, "C:\\b.xls": 3}


def test_discovery(spark, folder):
    """Files of the extension, links to files, files as they are given; links to folders aren't followed."""
    (folder / "link").symlink_to(folder / "sub")
    (folder / "z.scan").symlink_to(folder / "a.SCAN")
    listed = listing.tree(spark, [str(folder), str(folder / "g.txt"), str(folder / "none"), str(folder / "sub")], {"scan"}, file_links=True)
    rows = {r.path.removeprefix(str(folder) + "/"): r for r in listing.files(listed).collect()}
    assert set(rows) == {"a.SCAN", "c.scan", "e.scan", "f.scan", "h.scan", "sub/b.scan", "sub/d.scan", "g.txt", "z.scan", "none"}
    assert rows["none"].problem == "FileNotFoundError" and rows["h.scan"].size == 7 and rows["h.scan"].problem is None
    assert "z.scan" not in {r.path.rpartition("/")[2] for r in listing.tree(spark, str(folder), {"scan"}).collect()}
    assert listing.tree(spark, []).collect() == []
    rows = container.read_files(spark, [str(folder / "link"), str(folder / "none")], "scan")
    assert sorted((r.file.rpartition("/")[2], r.error) for r in rows.where("part = 'scan'").collect()) == [("b.scan", None), ("d.scan", None), ("none", "unreadable")]


def test_rows_of_a_container(spark, folder):
    """Each list is rows of its own part; a container is opened once for all of them."""
    rows = container.read_files(spark, str(folder / "a.SCAN"), "scan")
    parts = {p: [r for r in rows.collect() if r.part == p] for p in container.PARTS}
    assert [r.n_findings for r in parts["scan"]] == [len(SCAN["findings"])] and [r.finding.id for r in parts["finding"]] == [f["id"] for f in SCAN["findings"]]
    assert len(parts["source"]) == len(SCAN["coverage"].get("sources", [])) and parts["scan"][0].startedAt is not None
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("ferrule-containers") == 1
    got = container.tables(container.load_order(container.imported(rows)), rows)
    assert got["scans"].count() == 1 and [r.finding_id for r in got["findings"].orderBy("pos").collect()] == [f["id"] for f in SCAN["findings"]]


def test_parts_are_planned_by_bytes(spark):
    listed = spark.createDataFrame([(f"/x{i}", 100 if i else 10_000, None) for i in range(200)], "path string, size long, problem string")
    assert len(listing.planned(listed, bytes_each=1000).inputFiles()) > 20 and len(listing.planned(listed, files_each=10).inputFiles()) > 10
    assert listing.planned(listed, bytes_each=1000).count() == 200 and listing.planned(listed.where("false")).count() == 0


def test_a_deep_tree_and_many_folders(spark, tmp_path):
    deep = tmp_path
    for i in range(12):
        deep = deep / f"_l{i}"
        deep.mkdir()
        (deep / ".x.scan").write_bytes(b"1" * i)
    for i in range(70):
        (tmp_path / f"d{i}").mkdir()
    found = listing.tree(spark, str(tmp_path), {"scan"})
    assert sorted(r.size for r in found.where("kind = 'file'").collect()) == list(range(12))
    assert found.where("kind = 'expanded'").count() == 1 + 12 + 70 and found.where("kind = 'folder'").count() == 82


def scans(spark, *hosts, **changes):
    return spark.createDataFrame([(json.dumps(changed(machine__hostname=h, scanId=f"0b9c3e0e-5a0c-4f67-9f55-3d1f2e8a7c{i:02}", **changes)),) for i, h in enumerate(hosts)], "scan string")


def test_published_by_a_commit(spark, tmp_path):
    """All containers or none; a failing task, two scans of one name or another file of the name leave the folder as it was."""
    container_source.save(scans(spark, "A", "B", "C"), str(tmp_path))
    names = sorted(f.name for f in tmp_path.iterdir())
    assert names == [f"{h}_20260102-080000Z.zip" for h in "ABC"]
    assert container.read_files(spark, str(tmp_path), "zip").where("part = 'scan' and error is null").count() == 3
    container_source.save(scans(spark, "A", "B", "C"), str(tmp_path))  # the same again is no fault
    for bad in (scans(spark, "D", " "), scans(spark, "E", "E"), scans(spark, "F", "A", machine__domain="other.example"), spark.createDataFrame([("{",)], "scan string")):
        with pytest.raises(Exception):  # noqa: B017
            container_source.save(bad, str(tmp_path))
        assert sorted(f.name for f in tmp_path.iterdir()) == names


def test_attempts_that_do_not_count_leave_nothing(tmp_path):
    """A repeated attempt writes elsewhere; only the one whose message is committed is published."""
    writer = container_source.Writer(str(tmp_path), "zip")
    batch = pa.RecordBatch.from_pydict({"scan": [json.dumps(SCAN)]})
    broken = pa.RecordBatch.from_pydict({"scan": [json.dumps(SCAN), "{"]})
    with pytest.raises(ValueError):
        writer.write(iter([broken]))
    lost, kept = writer.write(iter([batch])), writer.write(iter([batch]))
    names = os.listdir(kept.folder)
    assert lost.folder != kept.folder and os.listdir(lost.folder) == names and len(names) == 1
    assert [f.name for f in tmp_path.iterdir() if not f.name.startswith(".job-")] == []
    writer.commit([kept, None])
    assert [f.name for f in tmp_path.iterdir()] == names
    other = container_source.Writer(str(tmp_path), "zip")
    other.write(iter([batch]))
    other.abort([None])
    assert [f.name for f in tmp_path.iterdir()] == names


def test_state_of_imports(spark, tmp_path):
    """Versions add up, a damaged file is tried again, two imports at once conflict, one version holds all after compact()."""
    (tmp_path / "in").mkdir()
    put = lambda name, **x: (tmp_path / "in" / name).write_bytes(container.to_bytes(changed(**x)))
    ids = [f"0b9c3e0e-5a0c-4f67-9f55-3d1f2e8a7c{i:02}" for i in range(9)]
    state = import_state.ImportState(spark, f"file://{tmp_path}/state")
    outcomes = lambda limit=None: {r.file.rpartition("/")[2]: r.outcome for r in state.take_up(container.read_files(spark, str(tmp_path / "in"), "zip"), limit).collect()}
    put("a.zip", scanId=ids[0], machine__hostname="A")
    (tmp_path / "in" / "b.zip").write_bytes(b"damaged")
    put("c.zip", scanId=ids[1], machine__hostname="C")
    assert state.table().count() == 0 and outcomes(1) == {"a.zip": "accepted", "b.zip": "error", "c.zip": "overLimit"}
    put("b.zip", scanId=ids[0], machine__hostname="A")
    put("0.zip", scanId=ids[2], machine__hostname="a")
    assert outcomes(1) == {"0.zip": "accepted", "a.zip": "alreadyLoaded", "b.zip": "duplicate", "c.zip": "overLimit"}
    assert outcomes(2) == {"0.zip": "alreadyLoaded", "a.zip": "alreadyLoaded", "b.zip": "alreadyLoaded", "c.zip": "accepted"}
    before = sorted(map(tuple, state.table().collect()))
    state.compact()
    assert sorted(map(tuple, state.table().collect())) == before and state.version() == 4 and state.vacuum() == 3 and state.vacuum() == 0
    assert sorted(map(tuple, state.table().collect())) == before and set(outcomes(2).values()) == {"alreadyLoaded"}
    late = import_state.ImportState(spark, f"file://{tmp_path}/state")
    late.version = lambda: state.version() - 1  # as if another import had come between
    with pytest.raises(import_state.Conflict):
        late.take_up(container.read_files(spark, str(tmp_path / "in"), "zip"))
    assert not [f for f in (tmp_path / "state").iterdir() if f.name.startswith("_aside")]


def test_written_once(spark, tmp_path):
    rows = spark.createDataFrame([(json.dumps(SCAN),), (json.dumps(changed(machine__hostname=" ")),)], "scan string").coalesce(1)
    got = container.written(rows, str(tmp_path)).collect()
    assert [r.error for r in got] == [None, "FormatError"]
    assert container.read(next(tmp_path.glob("SRV-1_*.zip")).read_bytes())["machine"]["hostname"] == "SRV-1"
    again = container.written(rows.limit(1), str(tmp_path)).collect()
    assert [r.error for r in again] == [None], "a task that is repeated finds its own file"
    other = spark.createDataFrame([(json.dumps(changed(machine__domain="other.example")),)], "scan string")
    assert [r.error for r in container.written(other, str(tmp_path)).collect()] == ["FileExistsError"]
    assert [f.name for f in tmp_path.iterdir()] == ["SRV-1_20260102-080000Z.zip"], "no parts are left"


def test_names_with_a_dot_or_underscore_and_files_loaded_before(spark, tmp_path):
    for name in ("_a.scan", ".b.scan", "c.scan"):
        (tmp_path / name).write_bytes(container.to_bytes(changed(scanId=f"0b9c3e0e-5a0c-4f67-9f55-3d1f2e8a7c{len(list(tmp_path.iterdir())):02}")))
    rows = container.read_files(spark, [str(tmp_path), str(tmp_path / "gone")], "scan")
    got = {r.file.rpartition("/")[2]: r.outcome for r in container.imported(rows).collect()}
    assert got == {"_a.scan": "accepted", ".b.scan": "accepted", "c.scan": "accepted", "gone": "error"}
    before = rows.where("file like '%c.scan'").select("file")
    got = {r.file.rpartition("/")[2]: r.outcome for r in container.imported(rows, loaded=before).collect()}
    assert got["c.scan"] == "alreadyLoaded" and got["_a.scan"] == "accepted"


def test_reports(spark, folder, tmp_path):
    a = container.assess_files(spark, str(folder), "scan")
    tables = report.sheets(a, catalog.rules(spark), finding_list.FREE)
    assert set(tables) == {"summary", "findings", "locations", "machines", "rules", "setAside"} and "min_hours" not in tables["findings"].columns
    report.write_sheets(tables, str(tmp_path / "out"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "out" / "findings")).count() == a.items.count()
    view = json.loads(report.overview(a).first()[0])
    assert view["machines"] == 3 and view["coverage"] == {"full": 3, "limited": 0} and [k["kind"] for k in view["by_kind"]] == sorted(k["kind"] for k in view["by_kind"])
    text = report.management_report(a)
    assert "2 items on 3 machines" in text and "## Effort" in text and "## Effort" not in report.management_report(a, finding_list.FREE)
    assert summary.machine_names(a.occurrences, a.machines, shown=1).first().more == 2


def test_event_xml(spark):
    xml = "<Event><System><Provider Name='P'/><EventID Qualifiers='0'>4096</EventID><TimeCreated SystemTime='2026-09-01T08:02:11.1234567Z'/><EventRecordID>120</EventRecordID></System><EventData><Data>a.exe</Data><Data Name='X'>y &amp; z</Data><Data></Data></EventData></Event>"
    user = "<Event><System><Provider EventSourceName='Q'/></System><UserData><Info xmlns='x'><n:Path>C:\\a.vbs</n:Path><Empty/></Info></UserData></Event>"
    rows = event_xml.read_events(spark.createDataFrame([(1, xml), (2, user), (3, None), (4, "<broken")], "load_idx long, xml string")).orderBy("load_idx").collect()
    assert (rows[0].record_id, rows[0].provider, rows[0].event_id, rows[0].data) == (120, "P", 4096, {"#1": "a.exe", "X": "y & z", "#2": ""})
    assert rows[0].time.microsecond == 123456 and (rows[1].provider, rows[1].data, rows[1].time) == ("Q", {"Path": "C:\\a.vbs"}, None)
    assert rows[2].data == rows[3].data == {}


def test_listing_and_reading(spark, tmp_path):
    (tmp_path / "OneDrive - X").mkdir()
    (tmp_path / "d").mkdir()
    for name in ("a.VBS", "d/b.vbs", "d/c.txt", "d/scripts.ini", "OneDrive - X/e.vbs"):
        (tmp_path / name).write_bytes(b"x = 1")
    (tmp_path / "loop").symlink_to(tmp_path)
    found, entries = files.listed(spark, [str(tmp_path), str(tmp_path / "none")], {"vbs"}, frozenset({"scripts.ini"}))
    rows = found.orderBy("path").collect()
    assert [r.path.rpartition("/")[2] for r in rows if not r.problem] == ["e.vbs", "a.VBS", "b.vbs", "scripts.ini"] and [r.problem for r in rows if r.problem] == ["FileNotFoundError"]
    assert {r.entries for r in entries.collect()} == {8}
    assert stores.on_demand(SimpleNamespace(st_file_attributes=0x400020)) and not stores.on_demand(SimpleNamespace(st_file_attributes=0x20))
    more = [(str(tmp_path / "gone.vbs"), 1, None), (str(tmp_path / "big.vbs"), 1 << 40, None), (str(tmp_path / "loop"), 1, None), ("d/b.vbs", 1, None), ("//fs01/share/b.vbs", 1, None), ("\\\\.\\pipe\\x", 1, None), ("\\\\fs01\\s\\b.vbs", 1, None)]
    listed = found.union(spark.createDataFrame(more, found.schema)).withColumn("load_idx", F.lit(0))
    got = {re.split(r"[/\\]", r.path)[-1] if r.path.startswith(str(tmp_path)) else r.path: r for r in files.read_listed(listed).collect()}
    assert bytes(got["a.VBS"].content) == b"x = 1" and "gone.vbs" not in got and "none" not in got
    assert {k: r.problem for k, r in got.items() if r.problem} == {"big.vbs": "tooLarge", "loop": "corrupt", "d/b.vbs": "corrupt", "//fs01/share/b.vbs": "networkLocation", "\\\\.\\pipe\\x": "corrupt", "\\\\fs01\\s\\b.vbs": "networkLocation"}
    stored = files.read_store(spark, str(tmp_path / "d"), {"vbs", "ini"}).collect()
    assert sorted(r.path.rpartition("/")[2] for r in stored) == ["b.vbs", "scripts.ini"]
    kinds = ["PermissionError", "FileNotFoundError", None, "Odd", "Encrypted"]
    rows = spark.createDataFrame([(k,) for k in kinds], "e string").select(files.reason_column(F.col("e"))).collect()
    assert [r[0] for r in rows] == [files.reason(k) for k in kinds] == ["accessDenied", None, None, "corrupt", "encrypted"]


def test_names_of_files_are_not_broadcast(spark):
    """Joins by file or scan stay joins by exchange, however small Spark takes their tables to be."""
    rows = container.read_contents(spark.createDataFrame([("a.zip", bytearray(packed(SCAN))), ("b.zip", bytearray(b"x"))], "file string, content binary")).localCheckpoint()
    loaded = container.imported(rows)
    plan = loaded._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert sorted((r.file, r.outcome) for r in loaded.collect()) == [("a.zip", "accepted"), ("b.zip", "error")]
    order = loaded.where("outcome = 'accepted'").withColumn("load_idx", F.lit(0))
    plan = container.tables(order, rows)["findings"]._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_alike_files_share_their_content(spark, tmp_path):
    from ferrule.plans.import_queries import put

    rows = spark.createDataFrame([(f"d{i % 3}/f{i}", bytearray(b"x" * (i % 4))) for i in range(40)], "file string, content binary").coalesce(1)
    assert put(rows, str(tmp_path), alike=3) == 40
    found = {os.path.relpath(p, tmp_path): os.stat(p) for p in map(str, tmp_path.rglob("f*"))}
    assert {n: s.st_size for n, s in found.items()} == {f"d{i % 3}/f{i}": i % 4 for i in range(40)}
    assert len({s.st_ino for s in found.values()}) == 3 + 10, "a content more than it remembers is written each time"
    assert sorted(r["size"] for r in listing.files(listing.tree(spark, str(tmp_path))).collect()) == sorted(i % 4 for i in range(40))


def test_containers_in_portions(spark, monkeypatch):
    """Results are the same in however many portions containers lie on the disk, and no folder is left."""
    from ferrule.plans import import_queries
    from ferrule.runtime import session_dir

    sf_dir = "/root/testdata/sf0.001"
    at_once = []
    put = import_queries.put
    monkeypatch.setattr(import_queries, "put", lambda rows, folder, alike=0: at_once.append(put(rows, folder, alike)) or at_once[-1])
    key = lambda q: sorted(map(tuple, q(spark, sf_dir).collect()))
    whole = key(import_queries.container_files), key(import_queries.container_written)
    monkeypatch.setattr(import_queries, "PORTION", 600)
    assert (key(import_queries.container_files), key(import_queries.container_written)) == whole
    assert len(at_once) > 2 and sum(at_once[1:]) == at_once[0] > 600 and max(at_once[1:]) < 900
    assert not [n for n in os.listdir(stores.local_path(session_dir(spark))) if n.startswith("files-")]


def test_small_containers_are_opened_without_zipfile(monkeypatch):
    """Archives are packed as zipfile does, and opened as it does, whatever is odd about them."""
    import random

    def zipped(*entries, comment=b"", before=b"", date=(1980, 1, 1, 0, 0, 0)):
        out = io.BytesIO(before)
        out.seek(0, 2)
        with zipfile.ZipFile(out, "w") as z:
            z.comment = comment
            for name, content, method in entries:
                z.writestr(zipfile.ZipInfo(name, date), content, method)
        return out.getvalue()

    def got(content):
        try:
            return container.read(content)
        except Exception as e:
            return type(e), str(e)

    result, kind = (container.RESULT, json.dumps(SCAN), zipfile.ZIP_DEFLATED), (container.MIMETYPE, container.WRITTEN_TYPE, zipfile.ZIP_STORED)
    for entries in ((kind, result), (result, kind), (kind,), (), (kind, (container.RESULT, "é" * container.SMALL, zipfile.ZIP_DEFLATED))):
        assert container.pack(*entries) == zipped(*entries)
    plain = container.pack(kind, result)
    odd = [plain, b"", b"PK", plain[:-1], plain + b"x", plain[1:], plain[:40], container.pack(result), container.pack(kind), container.pack((container.MIMETYPE, "text/plain", 0), result), container.pack((container.MIMETYPE, "x" * 257, 0), result)]
    odd += [zipped(kind, result, comment=b"c"), zipped(kind, result, before=b"self extracting"), zipped(kind, result, ("é", "x", 0)), zipped(kind, kind, result), zipped(kind, (container.RESULT, json.dumps(SCAN), zipfile.ZIP_BZIP2)), zipped(kind, result, date=(2026, 1, 2, 3, 4, 6))]
    odd += [container.pack(kind, result, *[(f"e{i}", "", 0) for i in range(n)]) for n in (14, 15)]
    chance = random.Random(7)
    for content in (plain, zipped((container.MIMETYPE, container.WRITTEN_TYPE, 8), (container.RESULT, json.dumps(SCAN), 0))):
        for _ in range(1500):
            changed_bytes = bytearray(content)
            for _ in range(chance.choice((1, 1, 3))):
                changed_bytes[chance.choice((chance.randrange(len(content)), -chance.randrange(1, 150), chance.randrange(60)))] = chance.choice((0, 1, 8, 255, chance.randrange(256)))
            odd.append(bytes(changed_bytes))
    quick = [got(x) for x in odd]
    with monkeypatch.context() as m:
        m.setattr(container, "_unpacked", lambda content: None)
        assert [got(x) for x in odd] == quick
    monkeypatch.setattr(zipfile, "ZipFile", None)
    assert container.read(plain) == SCAN and container.to_bytes(SCAN), "the usual form goes without"


def test_scans_are_checked_at_once_as_they_are_field_by_field():
    """What the quick test lets pass is what the one that tells the place lets pass."""
    full = changed(
        machine__machineId="m", coverage__limitations=[{"code": "x"}],
        coverage__sources=[{"source": "s", "status": "complete", "roots": ["r"], "entries": 1, "timeRange": {"from": "2026-01-02T08:00:00Z", "to": "2026-01-02T08:00:00Z"}}],
        findings=[{"id": "f", "rule": "VBS-101", "kind": "scriptFile", "classification": "breaks", "status": "detected", "activation": "dormant", "location": {"type": "file", "path": "p"}, "file": {"size": 1}, "evidence": [{"line": 1, "text": "t", "masked": True}], "details": {"a": 1}}],
    )
    odd = [None, True, 1, -1, 1 << 63, 1.5, "", "x", "2026-01-02T08:00:00Z", "2026-13-02T08:00:00Z", [], [None], [1], ["x"], {}, {"code": "x"}]

    def places(value, at=()):
        yield at
        for k in value if isinstance(value, dict) else range(len(value)) if isinstance(value, list) else ():
            yield from places(value[k], (*at, k))

    def accepted(check, scan):
        try:
            check(scan)
            return True
        except container.FormatError:
            return False

    seen = set()
    for at in list(places(full))[1:]:
        for new in [*odd, odd]:
            scan = json.loads(json.dumps(full))
            inner = scan
            for k in at[:-1]:
                inner = inner[k]
            if new is odd:
                del inner[at[-1]]
            else:
                inner[at[-1]] = new
            assert container._fits(scan) == accepted(lambda s: container._check(s, container.SHAPE, ""), scan) == accepted(container.check, scan), (at, new)
            seen.add(container._fits(scan))
    assert seen == {True, False} and container._fits(full) and not container._fits([])


def test_files_of_removed_containers_are_written_over(spark, tmp_path):
    """A later portion makes no new files, and never writes over one that still has a name."""
    from ferrule.plans.import_queries import put
    from ferrule.sources.spare import Folder

    folder, spare = tmp_path / "0", tmp_path / "0.spare"
    scans = lambda day, n: spark.range(n).select(F.format_string(json.dumps(changed(machine__hostname="H%s")).replace("2026-01-02", f"2026-01-{day:02}"), F.col("id").cast("string")).alias("scan")).coalesce(2)
    inodes = lambda: {p.stat().st_ino for p in folder.rglob("*") if p.is_file()}
    folder.mkdir()
    container_source.save(scans(2, 40), str(folder), spare=str(spare))
    first = inodes()
    assert len(first) == 40 and len(list(spare.iterdir())) == 2 and not [n for n in os.listdir(folder) if n.startswith(".")]
    for p in sorted(folder.iterdir())[:30]:
        p.unlink()
    stay = {p.name: p.read_bytes() for p in folder.iterdir()}
    container_source.save(scans(3, 30), str(folder), spare=str(spare))
    assert {n: (folder / n).read_bytes() for n in stay} == stay and len(os.listdir(folder)) == 40
    assert len(inodes() - first) <= 10, "but for those whose files are in use"
    assert all(container.read(p.read_bytes())["startedAt"].startswith(f"2026-01-{3 if p.name not in stay else 2:02}") for p in folder.iterdir())

    rows = lambda n, size: spark.createDataFrame([(f"d{i % 3}/f{i}", bytearray(b"%d" % i * (size - i % 5))) for i in range(n)], "file string, content binary").coalesce(1)
    folder, spare = tmp_path / "1", tmp_path / "1.spare"
    spare.mkdir()
    for n, size in ((20, 9), (20, 30), (25, 6)):
        folder.mkdir()
        before = {p.stat().st_ino for p in spare.rglob("*") if p.is_file()}
        assert put(rows(n, size), str(folder)) == n
        assert {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("f*")} == {f"d{i % 3}/f{i}": b"%d" % i * (size - i % 5) for i in range(n)}
        assert not before or len(inodes() - before) == n - 20
        shutil.rmtree(folder)
        for p in (tmp_path / "1.taken").iterdir():
            p.rename(spare / p.name)

    one = Folder(str(tmp_path / "own"), str(spare))
    names = sorted(os.listdir(one.own))
    one.left = [names[0], names[1]]
    assert one.write(b"a", names[0]) != one.write(b"b", "n") and one.write(b"c") and {n: (tmp_path / "own" / n).read_bytes() for n in (names[0], "n")} == {names[0]: b"a", "n": b"b"}
    with pytest.raises(FileExistsError):
        one.write(b"x", "n")


def test_a_portion_that_fails_ends_the_query(spark, monkeypatch):
    from ferrule.plans import import_queries
    from ferrule.runtime import session_dir

    def broken(orders, folder):
        raise RuntimeError("broken")

    monkeypatch.setattr(import_queries, "PORTION", 200)
    with pytest.raises(RuntimeError, match="broken"):
        import_queries._in_portions(spark, "/root/testdata/sf0.001", "a int", broken)
    assert not [n for n in os.listdir(stores.local_path(session_dir(spark))) if n.startswith("files-")]
