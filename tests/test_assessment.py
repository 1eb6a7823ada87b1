import random
from datetime import datetime, timedelta

import pytest

from ferrule.operators import coverage, finding_list, report, search_index, summary, upkeep
from ferrule.operators.assessment import assess, newest_scans, propagate
from ferrule.sources import catalog

T = datetime(2026, 1, 1, 10)
RULES = {r[0]: r for r in catalog.RULES}
SCAN = "load_idx long, file string, scan_id string, hostname string, domain string, machine_id string, started_at timestamp, finished_at timestamp, coverage_mode string"
FINDING = (
    "load_idx long, pos long, finding_id string, rule string, kind string, classification string, status string, reason string, activation string, "
    "loc_kind string, loc_path string, loc_item string, target string, file_size long, sha256 string"
)


def finding(rule, activation, loc_kind, path, item=None, target=None, size=None, sha=None):
    odd = rule.endswith("00")
    _, kind, klass, *_ = RULES.get(rule, (rule, "laterKind", "later"))
    return (rule, kind, klass, "notCheckable" if odd else "detected", "accessDenied" if odd else None, activation, loc_kind, path, item, target, size, sha)


def script(path, sha, size=1000):
    return finding("VBS-101", "dormant", "file", path, size=size, sha=sha)


def task(name, target, activation="automatic"):
    return finding("VBS-301", activation, "scheduledTask", name, target=target)


@pytest.fixture
def build(spark):
    def run(machines, limit=None):
        scans, findings = [], []
        for i, (host, started, own) in enumerate(machines):
            scans.append((i, f"{i:03}.zip", f"s{i}", host, "corp.example", f"id-{host.lower()}", started, started + timedelta(minutes=5), "full"))
            findings += [(i, k, f"f{k + 1}", *f) for k, f in enumerate(own)]
        return assess(spark.createDataFrame(scans, SCAN), spark.createDataFrame(findings, FINDING), machine_limit=limit)

    return run


def by_path(a, *columns):
    return {r.loc_path: r[columns[0]] if len(columns) == 1 else tuple(r[c] for c in columns) for r in a.items.collect()}


def test_newest_scan_and_limit(spark, build):
    rows = [("PC-1", T, []), ("pc-1", T + timedelta(hours=1), []), ("PC-2", T, []), ("PC-2", T, []), ("PC-3", T, [])]
    scans = spark.createDataFrame([(i, f"{i}.zip", f"s{i}", h, None, None, t, t, "full") for i, (h, t, _) in enumerate(rows)], SCAN)
    chosen, aside = newest_scans(scans, 2)
    assert sorted(r.load_idx for r in chosen.collect()) == [1, 2]
    assert sorted((r.file, r.why) for r in aside.collect()) == [("0.zip", "superseded"), ("3.zip", "superseded"), ("4.zip", "machineLimit")]


def test_shares_merge_and_local_files_by_content(build):
    a = build([("A", T, [script(r"\\FS\s\x.vbs", "1"), script(r"C:\x.vbs", "1"), script(r"C:\y.vbs", "2")]), ("B", T, [script(r"\\fs\S\X.vbs", "9"), script(r"c:\X.VBS", "1"), script(r"C:\y.vbs", "3")])])
    assert sorted((r.loc_path, r.machines) for r in a.items.collect()) == [(r"C:\x.vbs", 2), (r"C:\y.vbs", 1), (r"C:\y.vbs", 1), (r"\\FS\s\x.vbs", 2)]


def test_identical_content_counts_once(build):
    a = build([("A", T, [script(r"C:\a.vbs", "1"), script(r"C:\b.vbs", "1")])])
    got = by_path(a, "same_as", "effort_kind")
    assert got[r"C:\a.vbs"] == (None, "hours") and got[r"C:\b.vbs"] == (1, "sameAs")


def test_activation_runs_through_chains(build):
    own = [script(r"C:\x.vbs", "1"), finding("VBS-201", "manual", "file", r"C:\run.bat", target="x.vbs"), task(r"\T", r"C:\run.bat")]
    got = by_path(build([("A", T, own)]), "activation", "risk")
    assert got[r"C:\x.vbs"] == ("automatic", "high") and got[r"C:\run.bat"] == ("automatic", "high")


def test_cycles_end(build):
    own = [finding("VBS-201", "dormant", "file", r"C:\a.bat", target=r"C:\b.bat"), finding("VBS-201", "dormant", "file", r"C:\b.bat", target=r"C:\a.bat"), task(r"\T", r"C:\a.bat")]
    assert set(by_path(build([("A", T, own)]), "activation").values()) == {"automatic"}


def test_long_chains(build):
    own = [finding("VBS-201", "dormant", "file", rf"C:\{i}.bat", target=rf"C:\{i + 1}.bat") for i in range(25)] + [script(r"C:\25.bat", "1"), task(r"\T", r"C:\0.bat")]
    assert set(by_path(build([("A", T, own)]), "activation").values()) == {"automatic"}


def test_chains_of_any_length(spark):
    n = 67
    items = spark.createDataFrame([(i, i, "dormant" if i else "automatic") for i in range(n)], "item_key int, first_seen int, own_activation string").coalesce(1)
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "src int, dst int").coalesce(1)
    assert {r.activation for r in propagate(items, edges).collect()} == {"automatic"}


@pytest.fixture
def few_rows(spark):
    """Many plans over few rows: compiling and replanning them would take most of the time."""
    names = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.adaptive.enabled": "false"}
    had = {n: spark.conf.get(n, None) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in had.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def test_kept_up_to_date(spark, few_rows, tmp_path):
    """Updates in any order of hosts: contents that enter and leave component stores, names that cease to be unique, items that change their kind."""
    rng = random.Random(2)
    store = script(r"C:\Windows\WinSxS\p\t.vbs", "1")

    def some(i):
        out = [script(rf"C:\s{rng.randrange(3)}\x{rng.randrange(2)}.vbs", str(rng.randrange(4))) for _ in range(rng.randrange(4))]
        out += [script(rf"\\fs\s\{rng.randrange(3)}.vbs", "9")] * rng.randrange(2) + [store] * (rng.random() < 0.2)
        out += [task(rf"\T{rng.randrange(3)}", rng.choice([r"x0.vbs", r"%D%\x1.vbs", r"C:\s1\x0.vbs", r"\\FS\S\1.vbs", r"C:\none.vbs", None]), rng.choice(["automatic", "dormant"])) for _ in range(rng.randrange(3))]
        # one item, of a kind that depends on who has it first
        return out + [("VBS-201", rng.choice(["scriptInvocation", "hardcodedCredential", "shortcut"]), "breaks", "detected", None, "manual", "file", r"C:\odd.bat", None, "x0.vbs", 5, "o")] * rng.randrange(2)

    scans, findings = [], []
    for i in range(24):
        host = f"H{rng.randrange(9)}"
        scans.append((i, f"{i:03}.zip", f"s{i}", host, None, None, T + timedelta(hours=rng.randrange(30)), T + timedelta(hours=40), "full"))
        findings += [(i, k, f"f{k + 1}", *f) for k, f in enumerate(some(i))]
    columns = ["number", "origin", "machines", "occurrences", "risk", "activation", "reported_activation", "rule", "kind", "loc_path", "target", "same_as", "min_hours", "machine", "first_seen"]
    kept, last = upkeep.Upkeep(), 0
    for end in (16, 20, 24):
        kept = kept.update(spark.createDataFrame(scans[last:end], SCAN), spark.createDataFrame([f for f in findings if last <= f[0] < end], FINDING))
        last = end
        if end == 24:
            want, got = assess(spark.createDataFrame(scans[:end], SCAN), spark.createDataFrame([f for f in findings if f[0] < end], FINDING)), kept.assess()
            rows = lambda a: sorted(map(tuple, a.items.select(*columns).collect()))
            assert rows(got) == rows(want) and sorted(map(tuple, got.links.collect())) == sorted(map(tuple, want.links.collect()))
            assert sorted(map(tuple, got.machines.select("load_idx", "detected").collect())) == sorted(map(tuple, want.machines.select("load_idx", "detected").collect()))
            assert got.set_aside.distinct().count() == want.set_aside.count() == end - len({s[3] for s in scans[:end]})
        if end == 16:  # goes on in another application
            place = f"file://{tmp_path}/state"
            saved, layers = kept.save(place), lambda: len(list((tmp_path / "state" / "layers").iterdir()))
            before = layers()
            saved.save(place)
            assert before == 7 == layers(), "layers that are there aren't written again"
            kept = upkeep.Upkeep.load(spark, place)
        if end == 20:
            kept = kept.compact()
    # an update writes what has changed: the layer of one machine has that machine's rows only
    more = kept.update(spark.createDataFrame([(90, "090.zip", "s90", "NEW", None, None, T, T, "full")], SCAN), spark.createDataFrame([(90, 0, "f1", *script(r"C:\new.vbs", "n"))], FINDING))
    assert more.occurrences.layers[-1].rows.count() == more.parts.layers[-1].rows.count() == more.drafts.layers[-1].rows.count() == 1


def test_only_unique_names_link(build):
    own = [script(r"C:\a\x.vbs", "1"), script(r"C:\b\x.vbs", "2"), script(r"C:\b\y.vbs", "3"), task(r"\T1", r"%Dir%\x.vbs"), task(r"\T2", r"%Dir%\y.vbs"), task(r"\T3", r"C:\b\Y.VBS")]
    a = build([("A", T, own)])
    names = {r.number: r.loc_path for r in a.items.collect()}
    assert {(names[r.starter], names[r.script]) for r in a.links.collect()} == {(r"\T2", r"C:\b\y.vbs"), (r"\T3", r"C:\b\y.vbs")}


def test_system_files_and_their_copies(build):
    a = build([("A", T, [script(r"C:\Windows\WinSxS\p\t.vbs", "w")]), ("B", T, [script(r"C:\Windows\System32\t.vbs", "w"), script(r"C:\t.vbs", "o")])])
    got = by_path(a, "origin", "risk", "machines")
    assert got[r"C:\t.vbs"][0] == "own" and [v for k, v in got.items() if k != r"C:\t.vbs"] == [("windows", "info", 2)]


@pytest.mark.parametrize(
    ("rule", "activation", "risk"),
    [("VBS-101", "automatic", "high"), ("VBS-101", "logged", "high"), ("VBS-101", "macro", "medium"), ("VBS-101", "later", "medium"), ("VBS-101", "dormant", "low"), ("VBS-302", "automatic", "medium"), ("VBS-302", "manual", "low")],
)
def test_risk(build, rule, activation, risk):
    assert by_path(build([("A", T, [finding(rule, activation, "file", r"C:\x")])]), "risk") == {r"C:\x": risk}


def test_effort(build):
    own = [script(r"D:\tiny.vbs", "s", 3000), script(r"D:\big.vbs", "l", 70_000), task(r"\Known", r"D:\tiny.vbs"), task(r"\Lost 1", r"\\nas\jobs\late.vbs"), task(r"\Lost 2", r"\\NAS\Jobs\Late.VBS"), task(r"\Page", "mshta.exe")]
    got = by_path(build([("HOST-A", T, own)]), "min_hours", "max_hours", "typical_script")
    assert got[r"D:\tiny.vbs"] == (1.0, 4.0, False) and got[r"D:\big.vbs"] == (4.0, 16.0, False) and got[r"\Known"] == (0.5, 2.0, False)
    assert sorted(got[x] for x in (r"\Lost 1", r"\Lost 2")) == [(0.5, 2.0, False), (1.5, 6.0, True)]
    assert got[r"\Page"] == (0.5, 2.0, False)


def test_unknown_rules_are_a_manual_check(build):
    assert by_path(build([("A", T, [finding("VBS-999", "manual", "file", r"C:\x")])]), "min_hours", "max_hours") == {r"C:\x": (0.25, 1.0)}


def test_order_and_figures(build):
    a = build([("A", T, [script(r"C:\b.vbs", "2"), script(r"C:\a.vbs", "1"), task(r"\T", r"C:\b.vbs"), finding("VBS-600", "dormant", "file", r"C:\x.xlsm"), finding("VBS-901", "dormant", "file", r"C:\a.vbs")])])
    assert [(r.number, r.loc_path) for r in a.items.orderBy("number").collect()] == [(1, r"C:\b.vbs"), (2, r"\T"), (3, r"C:\a.vbs"), (4, r"C:\a.vbs"), (5, r"C:\x.xlsm")]
    s = summary.summary(a.items).first()
    assert (s["items"], s.high, s.not_checkable, s.credentials, s.breaks, s.review) == (5, 2, 1, 1, 3, 1)
    assert [r.kind for r in summary.by_kind(a.items, a.occurrences).collect()] == ["scriptFile", "scheduledTask", "officeMacro", "hardcodedCredential"]
    assert [tuple(r) for r in summary.not_checkable_reasons(a.items).collect()] == [("accessDenied", 1)]


def test_empty_fleet(build, spark):
    a = build([("A", T, [])])
    assert a.items.count() == 0 and summary.summary(a.items).first()["items"] == 0 and a.machines.first().detected == 0
    assert finding_list.page(a.items, a.occurrences, a.machines, finding_list.Query())[0] == 0


def test_pages(build):
    a = build([("HOST-7", T, [script(rf"C:\s{i:03}.vbs", str(i)) for i in range(120)]), ("B", T, [task(r"\Needle 100%", None)])])
    total, rows = finding_list.page(a.items, a.occurrences, a.machines, finding_list.Query())
    assert total == 121 and rows.count() == 100
    assert finding_list.page(a.items, a.occurrences, a.machines, finding_list.Query(offset=500))[1].count() == 0
    find = lambda text: finding_list.page(a.items, a.occurrences, a.machines, finding_list.Query(search=text, limit=1000))[0]
    assert find("needle") == 1 and find("host-7") == 120 and find("%") == 1 and find("vbs-301") == 1 and find("S00") == 10
    assert finding_list.page(a.items, a.occurrences, a.machines, finding_list.Query(risk="high", kind="scheduledTask"))[0] == 1
    assert "min_hours" not in finding_list.masked(a.items, finding_list.FREE).columns and "hint" in finding_list.masked(a.items, finding_list.ORGANIZATION).columns
    d = finding_list.detail(a.items, a.occurrences, a.machines, a.links, 1)
    assert d["occurrences"].count() == 1 and d["more"].first().more == 0


def test_coverage(spark):
    t = T
    sources = spark.createDataFrame(
        [(0, "files.a", "complete", 10, 2, 1, 3, None, None), (1, "files.a", "later", 5, 1, 0, 0, None, None), (0, "eventLog.s", "partial", 1, 0, 0, 0, t, t + timedelta(days=3)), (1, "eventLog.s", "failed", 1, 0, 0, 0, t, t + timedelta(days=9))],
        "load_idx long, source string, status string, entries long, inspected long, errors long, skipped long, time_from timestamp, time_to timestamp",
    )
    assert coverage.file_totals(sources).first().asDict() == {"entries": 15, "inspected": 3, "errors": 1, "skipped": 3}
    span = coverage.log_spans(sources).first()
    assert (span.reported, span.read, span.min_days, span.max_days) == (2, 1, 3.0, 3.0)
    files = {r.source: r for r in coverage.source_statuses(sources).collect()}["files.a"]
    assert (files.complete, files.other) == (1, 1)


def test_sample_organization(spark):
    from ferrule.sources.sample import organization

    a = assess(*organization(spark, 30, extra=8))
    items = {r.loc_path: r for r in a.items.collect()}
    logon = items[r"\\dc01\netlogon\logon.vbs"]
    assert logon.machines == 30 and logon.activation == "automatic" and logon.risk == "high"
    assert any(r.origin == "windows" and r.machines == 30 for r in items.values())
    assert summary.summary(a.items).first().not_checkable > 0


def test_catalog():
    import json

    assert len(catalog.RULES) == 37 and [r[0] for r in catalog.RULES] == sorted(r[0] for r in catalog.RULES)
    good = {"formatVersion": 1, "sources": [{"id": "a"}], "rules": [{"id": "VBS-101", "kind": "scriptFile", "classification": "breaks", "sources": ["a"], "effort": {"minHours": 1, "maxHours": 4}, "hint": "h"}]}
    assert catalog.parse(json.dumps(good)) == [("VBS-101", "scriptFile", "breaks", 1.0, 4.0, "fixed", "h", ("a",))]
    for change in ({"kind": "x"}, {"sources": ["b"]}, {"id": "VBS-1"}, {"effort": {"minHours": 5, "maxHours": 4}}):
        bad = json.loads(json.dumps(good))
        bad["rules"][0] |= change
        with pytest.raises(ValueError):
            catalog.parse(json.dumps(bad))


def test_search_through_the_index(spark, build):
    """Same rows as a search through all occurrences, for long and short texts, blanks, cases and characters beyond ASCII."""
    a = build([
        ("PC-Äpfel", T, [script(r"C:\Jobs\straße.vbs", "1"), task(r"\Nightly", r"C:\Jobs\straße.vbs")]),
        ("srv-2", T, [script(r"C:\jobs\JOB1.vbs", "2"), finding("VBS-601", "macro", "file", r"D:\a.xlsm", item="Module One")]),
    ])
    index = search_index.build(a)
    for text in ("job", "JOBS\\", "äpfel", "straße", "vbs-3", "module one", "x", "pc", "aaa", "job1.vbs ", "s.v", "e.vb"):
        rows = [sorted(r.number for r in finding_list.matching(a.items, a.occurrences, a.machines, finding_list.Query(search=text), i).collect()) for i in (None, index)]
        assert rows[0] == rows[1], text
    total, page = finding_list.page(a.items, a.occurrences, a.machines, finding_list.Query(search="srv"), index=index)
    assert total == 2 and page.count() == 2
    assert "gram" in index.text_postings.columns and index.text_postings.where("gram = 'job'").count() == 3


def test_sheets_lose_no_row(spark, build, tmp_path):
    a = build([("A", T, [script(rf"C:\{i}.vbs", str(i)) for i in range(7)])])
    tables = report.sheets(a, catalog.rules(spark), most_rows=3)
    assert sorted((r.number, r.sheet) for r in tables["findings"].collect()) == [(i + 1, i // 3 + 1) for i in range(7)]
    report.write_sheets(tables, str(tmp_path))
    assert sorted(p.name for p in (tmp_path / "locations").glob("sheet=*")) == ["sheet=1", "sheet=2", "sheet=3"]
    assert spark.read.option("header", "true").csv(str(tmp_path / "locations")).count() == 7


def test_lines_are_dealt_by_their_number(spark, monkeypatch):
    """Tasks take a bounded number of lines however small these are when they move; findings are the same."""
    from ferrule.plans import fleet

    sf = "/root/testdata/sf0.001"
    usual = sorted(map(str, fleet.findings(spark, sf).collect()))
    monkeypatch.setattr(fleet, "LINES", 500)
    dealt = fleet.findings(spark, sf)
    assert "REPARTITION_BY_NUM" in dealt._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, dealt.collect())) == usual


def test_newest_scans_and_their_findings_are_written_once(spark):
    """Later queries over an assessment read neither all scans nor all findings again."""
    from ferrule.plans import fleet

    sf = "/root/testdata/sf0.001"
    a = assess(fleet.scans(spark, sf), fleet.findings(spark, sf))
    read = [*a.machines.inputFiles(), *a.occurrences.inputFiles()]
    assert read and not [f for f in read if sf in f]


def test_newest_scans_are_joined_once(spark):
    """All scans are sorted for one join; what stays and what is set aside make up the scans as before."""
    from ferrule.plans import fleet

    scans = fleet.scans(spark, "/root/testdata/sf0.001")
    for limit in (None, 20):
        chosen, aside = newest_scans(scans, limit)
        assert chosen._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
        assert chosen.columns == scans.columns
        files = [r.file for r in chosen.collect()], [r.file for r in aside.collect()]
        assert sorted(files[0] + files[1]) == sorted(r.file for r in scans.collect())
        assert limit is None or len(files[0]) == limit
