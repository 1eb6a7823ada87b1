"""Operators that find copies: n-gram join, exact dedup, substring dedup, decontamination, lines."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrule.llm import components, decontaminate, exact_dedup, line_dedup, ngram_join, substring_dedup
from ferrule.llm.store import Scratch, spread_join

from . import fixtures as fx

EMPTY = "doc_id long, text string"


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("options", [{}, {"table_bits": 12, "group_members": 3}])
def test_ngram_components(spark, seed, options):
    rows = fx.corpus(seed)
    expected, links = fx.components(rows), fx.links(rows)
    text = {i: t for i, t in rows if i is not None}
    got = ngram_join.ngram_jaccard_components(fx.frame(spark, rows), **options).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            own = text[r.doc_id]
            assert r.n_shingles == len(fx.shingles(own))
            assert r.component_id == expected.get(own, r.doc_id), own[:60] if own else own
            assert r.n_links == links[own]
    unnamed = [t for i, t in rows if i is None]
    assert sorted((r.n_shingles, r.n_links) for r in got if r.doc_id is None) == sorted((len(fx.shingles(t)), links[t]) for t in unnamed)
    assert sorted((r.n_shingles, r.component_id) for r in got if r.doc_id is None and r.n_shingles == 0) == [(0, None)]


def test_tiles_and_size_classes(spark, monkeypatch):
    """Many groups behind each token, over several tiles and classes of sizes."""
    monkeypatch.setattr(ngram_join, "TILE", 2)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*base[: 40 + 4 * (i % 20)], f"x{i % 33}", *base[40 + 4 * (i % 20) : 60 + 3 * i % 61]])) for i in range(90)]
    expected, links = fx.components(rows), fx.links(rows)
    got = ngram_join.ngram_jaccard_components(fx.frame(spark, rows), group_members=1).collect()
    assert {r.doc_id: (r.component_id, r.n_links) for r in got} == {i: (expected.get(t, i), links[t]) for i, t in rows}
    assert max(links.values()) > 10


def test_size_classes_never_part_linked_sizes():
    import numpy as np

    for percent in (50, 80, 90, 100):
        n = np.arange(1, 5000)
        most = np.minimum(100 * n // percent, 4999)
        one = ngram_join.size_classes(n, percent)
        assert (ngram_join.size_classes(most, percent) - one <= 1).all() and (np.diff(one) >= 0).all()


def test_near_copies_dropped(spark):
    """Repeated ids, rows without id, repeated rows: one row of each component, all rows without words."""
    long = " ".join(f"w{i}" for i in range(60))
    near, other = long + " more", " ".join(f"v{i}" for i in range(60))
    rows = [(1, long), (7, near), (7, other), (None, near), (None, "alone here"), (8, None), (None, ""), (9, other), (9, other), (3, "x y"), (3, "x y")]
    got = ngram_join.drop_near_copies(fx.frame(spark, rows))
    assert got.columns == fx.frame(spark, rows).columns
    assert sorted(((r.doc_id or 0, r.text or "") for r in got.collect())) == sorted([(1, long), (7, other), (0, "alone here"), (8, ""), (0, ""), (3, "x y")])


def test_ngram_empty_and_alone(spark):
    assert ngram_join.ngram_jaccard_components(spark.createDataFrame([], EMPTY)).count() == 0
    only = ngram_join.ngram_jaccard_components(spark.createDataFrame([(7, None)], EMPTY)).collect()
    assert [(r.doc_id, r.n_shingles, r.component_id) for r in only] == [(7, 0, 7)]


def test_links_between_agree_with_brute_force():
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 60).astype(np.uint64)
    sets = []
    for _ in range(40):
        own = base.copy()
        change = rng.integers(0, 14)
        own[rng.choice(60, change, False)] = rng.integers(0, 1 << 62, change).astype(np.uint64)
        sets.append(np.unique(own))
    links = {(i, j) for i in range(20) for j in range(20, 40) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    found = ngram_join.links_between(sets[:20], sets[20:], 80)
    assert set(found) <= links

    def classes(pairs):
        root = list(range(40))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        return [find(x) for x in range(40)]

    one, two = classes(found), classes(links)
    assert {(a, b) for a in range(40) for b in range(40) if one[a] == one[b]} == {(a, b) for a in range(40) for b in range(40) if two[a] == two[b]}


@pytest.mark.parametrize("options", [{}, {"table_bits": 12, "group_members": 3}])
def test_ngram_links_are_all_there(spark, options):
    base = [f"w{i}" for i in range(200)]
    family = [(1000 + i, " ".join([*base[: 5 * i], f"x{i}", *base[5 * i :]])) for i in range(40)]
    rows = fx.corpus(1) + family + [(2000, family[0][1])]
    own = {}
    for i, t in rows:
        if fx.shingles(t):
            own.setdefault(fx.shingles(t), []).append(i)
    sets = list(own)
    expected = {frozenset((x, y)) for k, x in enumerate(sets) for y in sets[k + 1 :] if 100 * len(x & y) >= 80 * len(x | y)}
    ids = {r.doc_id: r.set_id for r in ngram_join.ngram_jaccard_components(fx.frame(spark, rows), **options).collect() if r.doc_id is not None}
    name = {s: next((ids[i] for i in own[s] if i is not None), None) for s in sets}
    got = [(r.a, r.b) for r in ngram_join.ngram_jaccard_links(fx.frame(spark, rows), **options).collect()]
    assert len(got) == len(set(got)) == len(expected) >= 40 * 39 // 2 and all(a < b for a, b in got)
    assert {frozenset(name[x] for x in pair) for pair in expected if all(name[x] is not None for x in pair)} <= {frozenset(x) for x in got}


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(5, 5), (7, 6)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect())
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    assert components.components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_a_hot_key_is_dealt_to_several_tasks(spark):
    left = Scratch(spark, "t").keep(spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id")).alias("k"), "id"), "left")
    right = spark.createDataFrame([(7, "a"), (1, "b"), (5000, "c")], "k long, x string")
    got = spread_join(left, right, ["k"], ["id"], "left").groupBy("x").count().collect()
    assert {r.x: r["count"] for r in got} == {"a": 1001, "b": 1, None: 1998}
    assert spread_join(left, right, ["k"], ["id"], "left_semi").count() == 1002


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_groups(spark, keep):
    rows = fx.corpus(3)
    groups: dict = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(fx.LOWER), []).append(i)
    got = exact_dedup.exact_groups(fx.frame(spark, rows), keep=keep).collect()
    expected = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        stays = (min if keep == "smallest" else max)(known) if known else None
        expected += [(i, stays, len(ids), i == stays, fx.sha(t)) for i in ids]
    order = lambda x: (x[0] is None, x[0] or 0, x[4])
    assert sorted((tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in got), key=order) == sorted(expected, key=order)


def test_exact_drop_keeps_one_row_of_each_text(spark):
    rows = fx.corpus(4)
    df = fx.frame(spark, rows)
    got = exact_dedup.drop_copies(df, keep="largest")
    assert got.columns == df.columns
    kept = [(r.text or "").translate(fx.LOWER) for r in got.collect()]
    assert sorted(kept) == sorted({(t or "").translate(fx.LOWER) for _, t in rows})
    assert exact_dedup.drop_copies(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        exact_dedup.exact_groups(df, keep="first")


def test_exact_many_runs(spark):
    rows = [(i, f"t{i % 50}") for i in range(2000)]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, EMPTY), run_rows=10, fan=2).where("kept").collect()
    assert sorted(r.doc_id for r in got) == list(range(50)) and {r.group_size for r in got} == {40}


@pytest.mark.parametrize("seed", [5, 6])
@pytest.mark.parametrize("bits", [26, 12])
def test_substrings(spark, seed, bits):
    rows = [x for x in fx.corpus(seed) if x[0] is not None]
    distinct = sorted(set(rows), key=lambda x: x[0])
    expected = fx.kept_words(distinct)
    got = substring_dedup.remove_repeats(fx.frame(spark, rows), table_bits=bits).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        assert (r.n_words, r.n_removed, r.kept) == expected[r.doc_id, text[r.doc_id]]


def test_substrings_of_equal_ids(spark):
    """Documents of one doc_id are ordered by their texts' hashes; those without id come last, equally."""
    words = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    rows = [(4, words("p", 25) + " x"), (4, words("p", 25) + " y z"), (None, "a " + words("q", 22)), (None, words("q", 22) + " b"), (4096, words("q", 22)), (8192, words("q", 21))]
    got = {(r.doc_id, r.kept): r.n_removed for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, EMPTY)).collect()}
    assert {got[k] for k in got if k[0] == 4} == {0, 25} and got[4096, words("q", 22)] == 0 and got[8192, ""] == 21
    assert got[None, "a"] == got[None, "b"] == 22


def test_substrings_without_ids_and_empty(spark):
    long = " ".join(f"w{i}" for i in range(30))
    got = substring_dedup.remove_repeats(spark.createDataFrame([(None, long), (5, long), (6, None)], EMPTY)).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in got) == [(0, 30, 30, ""), (5, 30, 0, long), (6, 0, 0, "")]
    assert substring_dedup.remove_repeats(spark.createDataFrame([], EMPTY)).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(spark.createDataFrame([], EMPTY), window=7)


@pytest.mark.parametrize("bits", [22, 4])
def test_contamination(spark, bits, monkeypatch):
    monkeypatch.setattr(decontaminate, "LEVEL_BITS", bits)
    monkeypatch.setattr(decontaminate, "bits_for", lambda n: bits)
    rows = fx.corpus(7)
    texts = [t for _, t in rows if t and len(t.split()) > 30]
    items = [(1, " ".join(texts[0].split()[3:20])), (2, "one"), (30, "Two, WORDS"), (4, None), (5, "..."), (None, "one"), (6, "never to be found here"), (1, " ".join(texts[4].split()[:12])), (7, "mi"), *[(100 + i, " ".join(texts[0].split()[2:19])) for i in range(5)]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(fx.frame(spark, rows), bench)
    assert {"lang", "score", "n", "_id"} <= set(found.columns)
    got = decontaminate.digest(found).collect()
    assert len(got) == len(rows)
    def digest(i, t):
        n, hit, ids = fx.hits(t, items)
        return (-1 if i is None else i, n, hit, len(ids), fx.sha(",".join(ids)), hit > 0)

    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == sorted(digest(*x) for x in rows)


def test_contamination_plan_is_the_same_for_any_benchmark(spark):
    docs = fx.frame(spark, fx.corpus(7))
    plans = []
    for n in (1, 400):
        bench = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(n)], "item_id long, text string")
        plans.append(decontaminate.contamination(docs, bench)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow"))
    assert plans[0] == plans[1] == 1


def test_contamination_of_and_by_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], EMPTY)
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.digest(decontaminate.contamination(docs, none)).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in got] == [(3, 0, False), (0, 0, False)]
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.contamination(docs.limit(0), some).count() == 0


def test_lines_by_site(spark):
    page = lambda *lines: "<div>" + "</p><p>".join(lines) + "</div>"
    rows = [(i, f"https://User@A.example:8080/{i}", page("menu", f"own {i}", "menu", " ")) for i in range(6)]
    rows += [(10 + i, f"http://b.example/{i}", page("menu", f"own {i}")) for i in range(3)]
    rows += [(20, None, None), (21, "no host", ""), (None, "http://a.example/x", page("menu")), rows[0], (30, "http://c.example/", page("menu", "once"))]
    df = spark.createDataFrame([(i, u, h, "t", 1) for i, u, h in rows], "page_id long, url string, html string, text string, host int")
    got = {(r.page_id, r.host): r for r in line_dedup.drop_boilerplate(df).collect()}
    assert got[1, "a.example"].text == "own 1" and got[1, "a.example"].n_dropped == 2 and got[None, "a.example"].text == ""
    assert got[10, "b.example"].text == "own 0", "small hosts are judged as well"
    assert got[30, "c.example"].text == "menu\nonce", "one page has nothing in common with others"
    assert (got[20, ""].n_lines, got[20, ""].text) == (0, "")
    assert line_dedup.drop_boilerplate(df.limit(0)).count() == 0


def test_what_a_line_is(spark):
    cases = {
        "<p>one <a href='x'>two</a> three</p>four<br>five": ["one two three", "four", "five"],
        "<pre>a\n b\r\nc</pre>": ["a", "b", "c"],
        "<script>x = 1 < 2; track(0);</script>seen<style>p{}</style><title>t</title><!-- <p>no -->": ["seen"],
        "kept<script>never closed <p>gone": ["kept"],
        "<table><tr><td>a<td>b</tr><TR class=x><td>c&nbsp;&amp;lt;</table>": ["a b", "c &lt;"],
        "1 < 2 <!doctype x> 3 > 2 <b": ["1 < 2 3 > 2"],
        "<pro>x</pro><p/>y<hr\n/>z": ["x", "y", "z"],
    }
    df = spark.createDataFrame(list(enumerate(cases)), "page_id long, html string")
    got = {r.page_id: r.lines for r in df.select("page_id", line_dedup.lines(F.col("html")).alias("lines")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_lines_by_brute_force(spark):
    """A hot host, lines at exactly the ratio, long pages, pages full of unclosed tags."""
    import random

    rng = random.Random(4)
    rows = []
    for i in range(900):
        site = "hot" if i % 3 == 0 else f"s{rng.randrange(40)}"
        own = [f"line {rng.randrange(8)}" if rng.random() < 0.5 else f"own {i} {j}" for j in range(rng.randrange(12))]
        rows.append((i, site, own + own[:1]))
    rows += [(1000 + i, "ten", ["at the ratio"] * (i < 3) + ["above it"] * (i < 4) + [f"x{i}"]) for i in range(10)]
    rows.append((2000, "long", [f"l{j}" for j in range(50_000)]))
    counts, total = {}, {}
    for _, site, own in rows:
        total[site] = total.get(site, 0) + 1
        for x in set(own):
            counts[site, x] = counts.get((site, x), 0) + 1
    expected = {i: "\n".join(x for x in own if not (counts[site, x] > 1 and 10 * counts[site, x] > 3 * total[site])) for i, site, own in rows}
    df = spark.createDataFrame([(i, f"http://{site}/", "<li>".join(own)) for i, site, own in rows] + [(3000, "http://broken/", "<a '" * 100_000 + "<script " * 50_000)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in line_dedup.drop_boilerplate(df).collect()}
    assert got.pop(3000) == "" and got == expected and "at the ratio" in got[1000] and "above" not in got[1000]


def test_counted_tokens_take_few_bytes():
    x = np.sort(np.random.default_rng(5).integers(0, 1 << 32, 32_768, dtype=np.uint64).astype(np.uint32))
    for some in (x, x[:1], x[:0], np.array([0, 0, 2**32 - 1], np.uint32)):
        assert (ngram_join.unpacked(ngram_join.packed(some)) == some).all()
    assert len(ngram_join.packed(x)) < 3 * len(x)


def test_equal_sets_of_a_task_move_once(spark):
    """Tokens of copies are handed on once a task, however many batches they come in; their number is still counted."""
    rows = [(i, "one two three four five six seven") for i in range(50)] + [(50, "one two three four five six seven eight")]
    frame = fx.frame(spark, rows).coalesce(1)
    table = spark.sparkContext.broadcast(ngram_join.rarity_table(frame.select("doc_id", "text"), 5, 24, 51))
    with ngram_join.small_batches(spark, 256):
        kinds = "doc_id long, n long, v binary, prefix array<long>, key long, class int, tokens binary"
        assert frame.select("doc_id", "text").mapInArrow(ngram_join._prefixes(5, 75, 24, table), kinds).where("tokens is not null").count() == 2
    assert {r.n_links for r in ngram_join.ngram_jaccard_components(frame, percent=75).collect()} == {50}


def test_groups_that_are_never_opened_are_not_written(spark, monkeypatch):
    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    whole, near = words("a", 100), words("b", 100)
    # 2 holds all of 1 but is too long to be linked with it; 3 and 4 are linked; 5 and 6 are linked, of two classes
    long = words("c", 154)
    rows = [(1, whole), (2, whole + " " + words("z", 120)), (3, near), (4, near + " end"), (5, long), (6, long + " " + words("y", 32))]
    written, keep = {}, Scratch.keep

    def kept(self, df, name, *args):
        out = keep(self, df, name, *args)
        written[name] = out.count()
        return out

    monkeypatch.setattr(Scratch, "keep", kept)
    got = {r.doc_id: (r.component_id, r.n_links) for r in ngram_join.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 0), 2: (2, 0), 3: (3, 1), 4: (3, 1), 5: (5, 1), 6: (5, 1)}
    assert written["pairs"] == 1 and written["groups"] == 3
