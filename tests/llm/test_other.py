"""Extraction, classifiers, sharding and packing."""

import random
import re

import numpy as np
import pytest

from ferrule.llm import html_text, packing, quality, sharding, toxicity
from ferrule.llm.labelled import remainder, training_rows
from ferrule.llm.queries import TOKENIZER

from . import fixtures as fx

EMPTY = "doc_id long, text string"


def test_rendering():
    render = html_text.render
    assert render(None) == render("") == render("<p></p>") == ""
    assert render("<p>one<p>two") == "one\n\ntwo"
    assert render("a <b>b</b>c\n\n d<br>e") == "a bc d\ne"
    assert render("<ul><li>a<li>b<ol start=3><li>x<li value=9>y<li>z</ol></ul>") == "- a\n- b\n  3. x\n  9. y\n  10. z"
    assert render("<table><tr><th>Name<th>Qty<tr><td>apple pie<td>3<tr><td>x<td>1234</table>") == "Name       Qty\napple pie  3\nx          1234"
    assert render("<table><tr><td colspan=2>wide one<tr><td>a<td>b</table>") == "wide one\na  b"
    assert render("<td>loose") == "loose"
    assert render("<table>stray<tr><td>x</table>") == "stray\n\nx"
    assert render("x<span hidden>no</span><div style='color:red; DISPLAY : none'>no</div><input type=hidden value=no>y") == "xy"
    assert render("<title>t</title><style>p{}</style><script>if (a < b) '</p>'</script>z<template>q</template>") == "z"
    assert render("<pre>a\n  b</pre>") == "a\n  b"
    assert render("1 < 2 &amp; &lt;b&gt; &nbsp;x<!-- <p>no --> <![CDATA[raw]]>") == "1 < 2 & <b> x raw"
    assert render("<p hidden='until-found'>seen") == "seen"
    assert render("<select><option>a<option>b</select>") == "a\nb"
    assert render("<blockquote>in</blockquote>out") == "    in\n\nout"
    assert render("<dl><dt>t<dd>d</dl>") == "t\n    d"


def test_rendering_keeps_all_visible_words_of_any_nesting():
    from html.parser import HTMLParser

    class Words(HTMLParser):
        def __init__(self):
            super().__init__()
            self.words = []

        def handle_data(self, data):
            self.words += data.split()

    rng = random.Random(2)
    tags = ["div", "p", "b", "ul", "li", "table", "tr", "td", "span", "h2", "blockquote", "section", "td", "th", "tbody", "dl", "dt", "dd"]
    for n in range(300):
        page, k = [], 0
        for _ in range(rng.randint(1, 40)):
            tag = rng.choice(tags)
            page.append(rng.choice([f"<{tag}>", f"</{tag}>", f" w{k} ", f"w{k}. ", "<br>"]))
            k += 1
        page = "".join(page)
        plain = Words()
        plain.feed(page)
        plain.close()
        got = [w for w in html_text.render(page).split() if w != "-"]
        assert sorted(" ".join(got).replace(".", ". ").split()) == sorted(" ".join(plain.words).replace(".", ". ").split()), (n, page)


def test_rendering_of_formulas_and_drawings():
    render = html_text.render
    assert render("let <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></math>.") == "let x= 1 2."
    assert render("<math><semantics><mi>a</mi><annotation>tex</annotation></semantics><mphantom><mi>no</mi></mphantom></math>b") == "ab"
    assert render("a<math display=block><mtable><mtr><mtd><mn>1</mn></mtd><mtd><mn>2</mn></mtd></mtr><mtr><mtd><mn>3</mn></mtd></mtr></mtable></math>b") == "a\n1 2\n3\nb"
    assert render("a<svg viewBox='0 0 1 1'><title>no</title>no<defs><text>no</text></defs><g><text>one <tspan>two</tspan><tspan dy=1>three</tspan></text><text>four</text></g></svg> b") == "a one two three four b"
    assert render("<svg><style>no</style><text>a</text><foreignObject><p>b</p><p>c</p></foreignObject><text>d</text></svg>e") == "a\n\nb\n\nc\n\nd e"
    assert render("<svg><text display=none>no</text><text style='display:none'>no</text></svg>x") == "x"
    for page in ("<body><svg width='1'/>after<p>more", "<body><math/>after<p>more", "<svg><path d='x'/><g/></svg>after<p>more", "<svg><g><p>after</svg><p>more", "<div><svg><g></div>after<p>more", "<svg><text><b>after</b></svg><p>more"):
        assert render(page) == "after\n\nmore", page
    assert render("<svg><a href=x/>no</svg><text>no</text></svg>") == "no" and render("<div/>a<b/>b") == "ab"


def test_rendering_of_text_in_forms_of_tables():
    render = html_text.render
    assert render("<table><form>Name <tr><td>a<td>b</form></table>c") == "Name\n\na  b\n\nc"
    assert render("<table><tr><form><td>a<td>b<tr><td>cc<td>d</table>") == "a   b\ncc  d"
    assert render("<table><tbody><form hidden>x<tr><td>a</table>") == "x\n\na"
    assert render("<table><colgroup>x<col><tr><td>a</table>") == "x\n\na"


def test_rendering_of_tables_lines_up():
    render = html_text.render
    long = "x" * 70
    assert render(f"<table><tr><td>a<td>b<tr><td>{long}<td>c</table>") == f"a{' ' * 71}b\n{long}  c"
    assert render("<table><tr><td rowspan=2>a<td>b<td>c<tr><td>dd<td>e<tr><td>f<td>g<td>h</table>") == "a  b   c\n   dd  e\nf  g   h"
    assert render("<table><tr><td>a<td rowspan=0>b<td>c<tr><td>d<td>e<tbody><tr><td>f<td>g</table>") == "a  b  c\nd     e\nf  g"
    assert render("<table><tr><td colspan=2 rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e<td>f</table>") == "a     b\n      c\nd  e  f"
    assert render("<table><tr><td colspan=2>a wide one<td>b<tr><td>c<td>d<td>e</table>") == "a wide one  b\nc  d        e"
    assert render("<table><tr><td colspan=150>a<td>b<tr>" + "<td>c" * 150 + "<td>d</table>").split("\n")[0].index("b") == 450
    assert render("<table><tr><td colspan=x>a<td>b<tr><td colspan=9999>c</table>") == "a  b\nc"
    rows = [("word " * 200_000, "x"), *((f"a{i}", f"b{i}") for i in range(5000))]
    lines = render("<table>" + "".join(f"<tr><td>{a}<td>{b}" for a, b in rows) + "</table>").split("\n")
    assert sum(map(len, lines)) < 3_000_000 and sum(x.count("word") for x in lines) == 200_000 and {x.index("b") for x in lines if "b" in x} == {lines[0].index("x")}


def test_tables_of_many_spans_are_bounded():
    page = "<table><tr>" + "<td rowspan=9999>w" * 9000 + "<tr><td>x" * 9000 + "</table>"
    text = html_text.render(page)
    assert len(text) < 1 << 20 and text.count("w") == text.count("x") == 9000


def test_rendering_of_random_tables_lines_up():
    rng = random.Random(4)
    for n in range(200):
        wide = rng.randint(1, 5)
        rows, taken, want = [], {}, {}
        for y in range(rng.randint(1, 6)):
            row, x = "<tr>", 0
            while x < wide:
                if taken.get((y, x)):
                    x += 1
                    continue
                span = rng.randint(1, wide - x)
                span = next((k for k in range(1, span + 1) if taken.get((y, x + k))), span)
                down, name = rng.choice([1, 1, 1, 2, 3]), f"c{y}.{x}." + "w" * rng.choice([0, 3, 80])
                taken |= {(y + j, x + i): True for i in range(span) for j in range(down)}
                want[name] = x
                row += f"<td colspan={span} rowspan={down}>{name}"
                x += span
            rows.append(row)
        lines = html_text.render("<table>" + "".join(rows) + "</table>").split("\n")
        at: dict[int, set] = {}
        for line in lines:
            for m in re.finditer(r"c\S+", line):
                at.setdefault(want.pop(m[0]), set()).add(m.start())
        assert not want and all(len(x) == 1 for x in at.values()), (n, rows)
        assert [min(at[x]) for x in sorted(at)] == sorted({min(x) for x in at.values()}), (n, rows)


def test_rendering_keeps_all_visible_words_with_foreign_elements():
    rng = random.Random(3)
    tags = ["div", "p", "b", "ul", "li", "table", "tr", "td", "form", "tbody", "colgroup", "math", "mi", "mrow", "mfrac", "svg", "g", "text", "tspan", "foreignObject"]
    for n in range(400):
        page, words, formulas = [], [], []
        for k in range(rng.randint(1, 40)):
            tag = rng.choice(tags)
            page.append(rng.choice([f"<{tag}>", f"</{tag}>", f"<{tag}/>", f" w{k} ", f"<math><mi>w{k}</mi></math>", f"<svg/><p>w{k}</p>", f"<svg><text>w{k}</text></svg>"]))
            if f"w{k}" in page[-1]:
                (words if "<p>" in page[-1] or "<text>" in page[-1] else formulas).append(f"w{k}")
        page = "".join(page)
        got = re.findall(r"w\d+", html_text.render(page))
        assert len(got) == len(set(got)) and set(words) <= set(got), (n, page)
        if "<svg>" not in page:  # what else stands in a drawing isn't shown
            assert sorted(got) == sorted(words + formulas), (n, page)


def test_rendering_is_bounded(spark):
    rows = [(1, "u", "<div>" * 5000 + "deep"), (2, "u", None), (3, None, "<a '" * 500), (4, "u", "<p>" + "word " * 20000), (4, "u", "<p>again")]
    df = spark.createDataFrame([(i, u, h, "old") for i, u, h in rows], "page_id long, url string, html string, text string")
    got = html_text.extract(df)
    assert got.columns == ["page_id", "url", "text"]
    texts = {(r.page_id, len(r.text)): r.text for r in got.collect()}
    assert texts[1, 4] == "deep" and texts[2, 0] == "" and (4, 99_999) in texts and texts[4, 5] == "again"
    assert html_text.extract(df.limit(0)).count() == 0


def labelled(n: int = 900, seed: int = 1):
    """Prose and junk, some with insults."""
    rng = random.Random(seed)
    words = ["ta", "mi", "kora", "lem", "us", "ont", "the", "of", "and", "le", "la", "des"]
    insults = ["vuxor", "gribol", "snarfe"]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) + rng.choice(["", "", "", "ra", "no"]) for _ in range(rng.randint(5, 120))]
        bad, toxic = rng.random() < 0.3, rng.random() < 0.3
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(insults))
        if bad:
            text = [w.upper() + "!!" for w in text] if rng.random() < 0.5 else [text[0]] * len(text)
            toxic = toxic and text[0] != text[-1]
        docs.append((i, " ".join(text)))
        labels.append((i, int(not bad), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def labelled_frames(spark):
    docs, labels = labelled()
    docs += [(5000, None), (5001, ""), (5002, " "), (5003, "ta " * 30_000), (None, "ta mi"), docs[0]]
    labels += [(1, None, None), (7777, 1, 1), (None, 1, 0), (2, labels[2][1], labels[2][2])]
    df = spark.createDataFrame([(i, t, 0.1, "x") for i, t in docs], "doc_id long, text string, score double, y string")
    return df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((i, (q, t)) for i, q, t in labels if q is not None)


@pytest.mark.parametrize(("module", "label", "at", "fold"), [(quality, "quality", 0, (3, 1)), (toxicity, "toxic", 1, (5, 0))])
def test_classifiers_hold_out(labelled_frames, module, label, at, fold):
    docs, labels, truth = labelled_frames
    held = remainder(fold[0]) == fold[1]
    model = module.train(docs, labels, label, ~held)
    got = module.score(docs, model).withColumn("held", held).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    out = [(r.score >= 0.5) == bool(truth[r.doc_id][at]) for r in got if r.held and r.doc_id in truth]
    assert len(out) > 100 and np.mean(out) > 0.93
    assert all((__import__("zlib").crc32(str(r.doc_id).encode()) % fold[0] == fold[1]) == r.held for r in got if r.doc_id is not None)
    assert module.score(docs.limit(0), model).count() == 0
    assert module.score(docs, model, keep_text=False).columns == ["doc_id", "y", "score"]


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_without_labels(spark, module, label):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], EMPTY)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = module.train(docs, none, label, remainder(3) != 1)
    assert {r.score for r in module.score(docs, model).collect()} == {0.5}


def test_quality_is_fitted_in_a_task(labelled_frames, monkeypatch):
    docs, labels, _ = labelled_frames
    here = quality.train(docs, labels, "quality", remainder(3) != 1)

    def refuse(*_):
        raise AssertionError("training rows came to the driver")

    monkeypatch.setattr(quality, "fit", refuse)
    again = quality.train(docs.repartition(7), labels, "quality", remainder(3) != 1)
    assert again.weight.tobytes() == here.weight.tobytes() and (again.bias, again.slope, again.shift) == (here.bias, here.slope, here.shift)


def test_naive_bayes_ratios_by_hand():
    rng = random.Random(2)
    rows = [sorted(rng.sample(range(40), rng.randint(0, 9))) for _ in range(60)]
    y = np.array([rng.random() < 0.4 for _ in rows]).astype(np.int64)
    got = quality.ratios([np.array(r, np.uint32) for r in rows], y)
    count = [[1 + sum(f in r for r, label in zip(rows, y, strict=True) if label == c) for f in range(40)] for c in (0, 1)]
    whole = [sum(own) + len(got) - 40 for own in count]  # features that no row has count once
    expected = np.array([np.log(b / whole[1]) - np.log(a / whole[0]) for a, b in zip(*count, strict=True)] + [np.log(whole[0] / whole[1])] * (len(got) - 40))
    assert np.allclose(got, expected)


def test_features_are_of_words_and_pairs():
    def found(text):
        raw = np.frombuffer(text.encode(), np.uint8)
        return set(quality.features(raw, np.array([0, len(raw)]))[0].tolist())

    assert found("one two three") != found("two one three"), "order counts through pairs of words"
    assert len(found("")) == 1


def test_repeated_ids_do_not_outgrow_the_sample(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, None)], EMPTY)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1), (None, 1)], "doc_id long, quality int")
    got = training_rows(docs, labels, "quality", remainder(3) >= 0, 10, 5).collect()
    assert sorted((r.doc_id, r.text, r.y) for r in got) == [(1, "text 0", 1), (2, "", 0)]


def test_convolution_and_its_gradient_by_hand():
    rng = np.random.default_rng(1)
    net = toxicity.Network.new(dims=3, each=2)
    net.embed = rng.normal(0, 1, (30, 3))
    net.filters, net.bias, net.out = [f.astype(np.float64) for f in net.filters], rng.normal(0, 0.1, 6), net.out.astype(np.float64)
    net.out_bias = 0.3
    texts = [np.stack([rng.integers(0, 20, n), rng.integers(20, 30, n)]) for n in (1, 2, 5, 9)]
    y, weight = np.array([1, 0, 1, 0]), np.array([1.0, 2.0, 0.5, 1.0])

    def logit(text):
        x = [net.embed[a] + net.embed[b] for a, b in text.T.tolist()]
        best = []
        for k, f in enumerate(net.filters):
            for c in range(f.shape[2]):
                best.append(max(0.0, max(net.bias[2 * k + c] + sum(float(x[p + j] @ f[j][:, c]) for j in range(len(f)) if p + j < len(x)) for p in range(len(x)))))
        return float(np.dot(best, net.out)) + net.out_bias

    def loss():
        z = np.array([logit(t) for t in texts])
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() / len(y))

    first = np.concatenate([[0], np.cumsum([t.shape[1] for t in texts])])
    assert np.allclose(net.logits(np.concatenate(texts, 1), first), [logit(t) for t in texts])
    gradients = {}
    toxicity._step(net, texts, y, weight, lambda name, value, gradient, rows=None: gradients.__setitem__(name, (gradient, rows)), np.zeros(30, bool))
    gradients["out"] = gradients["out"][0] - 1e-4 * net.out, None  # its own decay isn't of the loss

    def slope(array, index):
        held, array[index] = array[index], array[index] + 1e-5
        high = loss()
        array[index] = held - 1e-5
        low = loss()
        array[index] = held
        return (high - low) / 2e-5

    for name, array in [("bias", net.bias), ("out", net.out), *[(f"filter{k}", f) for k, f in enumerate(net.filters)]]:
        assert np.allclose(gradients[name][0], [slope(array, i) for i in np.ndindex(array.shape)] if array.ndim == 1 else np.reshape([slope(array, i) for i in np.ndindex(array.shape)], array.shape), atol=2e-4), name
    change, rows = gradients["embed"]
    full = np.zeros_like(net.embed)
    full[rows] = change
    assert np.allclose(full, np.reshape([slope(net.embed, i) for i in np.ndindex(net.embed.shape)], net.embed.shape), atol=2e-4)


def test_dual_descent_separates():
    rng = np.random.default_rng(1)
    rows = [rng.choice(50, 8, False) for _ in range(300)]
    y = np.array([int(3 in r or 7 in r) for r in rows])
    values = [np.ones(8) for _ in rows]
    w, b = quality.dual_descent(rows, values, y, 50, cost=10.0, epochs=60)
    assert np.mean([(w[r].sum() + b > 0) == bool(t) for r, t in zip(rows, y, strict=True)]) > 0.98


def test_shards(spark):
    rows = fx.corpus(8)
    got = sharding.assign(fx.frame(spark, rows)).collect()
    assert len(got) == len(rows) and {r.shard for r in got} <= set(range(8))
    text = dict(x for x in rows if x[0] is not None)
    for r in got:
        assert r.grown_shard in (r.shard, 8)
        if r.doc_id is not None:
            t = text[r.doc_id] or ""
            assert (r.size, r.text_crc32) == (len(t.encode()) + 1, fx.crc(t))
    for s in range(8):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))
    assert len({r.shard for r in got if r.doc_id is None}) == 1
    assert sharding.assign(fx.frame(spark, [])).count() == 0


def test_descent_by_hand(spark):
    """The tree's draws again in plain Python."""
    import math

    import xxhash

    def place(key: str, node) -> int:
        while node.children:
            def draw(child):
                seed = xxhash.xxh64(key.encode(), seed=42).intdigest()
                return -math.log(((xxhash.xxh64(child.name.encode(), seed=seed).intdigest() >> 11) + 0.5) / 2**53) / child.total

            node = min(node.children, key=draw)
        return node.shard

    leaf = lambda i, w=1.0: sharding.Node(f"s{i}", weight=w, shard=i)
    own = sharding.Node("root", children=(sharding.Node("a", children=(leaf(0, 2.0), leaf(1, 0.5), leaf(2))), leaf(3, 3.0)))
    df = spark.createDataFrame([(i, "x") for i in [*range(300), None]], EMPTY)
    for tree in (sharding.layout(8), sharding.layout(9), own):
        got = {r.doc_id: r.shard for r in sharding.assign(df, tree=tree).collect()}
        assert got == {i: place("none" if i is None else str(i), tree) for i in got} and len(set(got.values())) == len(tree.leaves())


def test_slots_of_equal_rows(spark):
    rows = [(1, "same")] * 500 + [(i, None) for i in range(50)]
    got = sharding.assign(spark.createDataFrame(rows, EMPTY), slice_rows=5).collect()
    for s in range(8):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))
    packed = packing.pack_documents(spark.createDataFrame(rows, EMPTY), TOKENIZER).collect()
    assert len({(r.sequence_id, r.offset) for r in packed}) == len(rows)


def test_shards_move_only_where_weights_change(spark):
    keys = spark.range(20000).select(__import__("pyspark.sql.functions", fromlist=["col"]).col("id").cast("string").alias("k"))
    from pyspark.sql import functions as F

    trees = [sharding.layout(n) for n in (8, 9, 10, 12)]
    rows = keys.select(*[sharding.place(F.col("k"), t).alias(f"p{i}") for i, t in enumerate(trees)]).collect()
    for a, b, new in ((0, 1, {8}), (1, 2, {9}), (2, 3, {10, 11})):
        assert all(r[a] == r[b] or r[b] in new for r in rows)
    counts = np.bincount([r[0] for r in rows], minlength=8)
    assert counts.min() > 0.9 * 2500 and counts.max() < 1.1 * 2500 and np.mean([r[1] == 8 for r in rows]) == pytest.approx(1 / 9, rel=0.1)
    # a heavier rack takes rows from elsewhere, and within other racks nothing moves
    leaf = lambda i, w=1.0: sharding.Node(f"s{i}", weight=w, shard=i)
    tree = lambda w: sharding.Node("root", children=(sharding.Node("a", children=(leaf(0), leaf(1))), sharding.Node("b", children=(leaf(2), leaf(3, w)))))
    moved = keys.select(sharding.place(F.col("k"), tree(1.0)).alias("x"), sharding.place(F.col("k"), tree(3.0)).alias("y")).where("x <> y").collect()
    assert moved and all(m.y in (2, 3) and (m.x in (0, 1) or m.y == 3) for m in moved)


def check_plan(counts: dict[int, int], capacity: int) -> packing.Plan:
    plan = packing.make_plan(counts, capacity)
    fill: dict[int, list] = {}
    for length, n in counts.items():
        if n:
            sequence, offset = plan.find(np.full(n, length), np.arange(n))
            for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
                fill.setdefault(s, []).append((o, length))
    for own in fill.values():
        at = 0
        for o, length in sorted(own):
            assert o == at
            at += length
        assert at <= capacity
    assert len(fill) == plan.sequences
    return plan


def first_fit(counts: dict[int, int], capacity: int) -> int:
    bins: list[int] = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            for i, room in enumerate(bins):
                if room >= length:
                    bins[i] -= length
                    break
            else:
                bins.append(capacity - length)
    return len(bins)


def test_plans():
    rng = random.Random(1)
    for _ in range(200):
        capacity = rng.choice([10, 37, 100])
        counts = {length: rng.choice([0, 1, 2, 5, 30]) for length in rng.sample(range(1, capacity + 1), rng.randint(1, 10))}
        plan = check_plan(counts, capacity)
        total = sum(k * n for k, n in counts.items())
        assert -(-total // capacity) <= plan.sequences <= first_fit(counts, capacity)
    assert check_plan({}, 5).sequences == 0
    assert check_plan({4096: 1_000_000, 4000: 500_000, 96: 500_000}, 4096).sequences == 1_500_000
    assert check_plan({6: 3, 4: 3}, 10).fixed == 3, "perfect pairs are fixed"
    with pytest.raises(ValueError):
        packing.make_plan({11: 1}, 10)


def test_packed_documents(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    rows = fx.corpus(9)
    got = packing.pack_documents(fx.frame(spark, rows), TOKENIZER).collect()
    text = dict(x for x in rows if x[0] is not None)
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        if r.doc_id is not None:
            ids = [*tokenizer.encode(text[r.doc_id] or "", add_special_tokens=False).ids, 1]
            part = np.array(ids[r.start : r.start + r.length], "<u4")
            assert r.start == r.piece * 4096 and r.ids_crc32 == __import__("zlib").crc32(part.tobytes()) and (r.length == 4096 or r.start + r.length == len(ids))
    for own in sequences.values():
        at = 0
        for o, length in sorted(own):
            assert o == at
            at += length
        assert at <= 4096
    assert len(sequences) <= -(-sum(r.length for r in got) // 4096) + 1
    assert packing.pack_documents(fx.frame(spark, []), TOKENIZER).count() == 0


def test_tokens_of_awkward_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    tokenizer, rng = Tokenizer.from_file(TOKENIZER), random.Random(1)
    marks = ["a", "B", "é", "É", "İ", "Σ", "ς", "'s", "'", "’", "—", ",", ".", "!!", "%", "1", "23", "́", " ", "\n", "foo", "It's", "don't", "ß", "<", "|", ">", "中", "😀", "_", "\x1c", "\x85"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    for some in ([t for t in texts if "<|" not in t], [*texts, "a<|endoftext|>b C<|ENDOFTEXT|> x", "", None]):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(some))), pa.array(some)], ["doc_id", "text"])
        for out in packing._pieces(TOKENIZER, 4096, 1, True)(iter([batch])):
            for d, ids in zip(out.column(0).to_pylist(), out.column(5).to_pylist(), strict=True):
                assert ids == [*tokenizer.encode(some[d] or "", add_special_tokens=False).ids, 1]


def test_broken_pages_take_linear_time():
    import time

    for part in ("<a '", "<a ", "<a x='", '<a x=">"', "<script ", "<!--", "<style>@{", "<style>.a{", "</a "):
        begin = time.perf_counter()
        html_text.render(part * (1_000_000 // len(part)))
        assert time.perf_counter() - begin < 10, part


def test_styles_decide_what_is_seen():
    render = html_text.render
    sheet = "<style>.x{display:none} #y{visibility:hidden} p.v,.u{display:none} /* .q{display:none} */ @media print{.w{display:none}} .x#z{display:block} div .r{display:none}</style>"
    assert render(sheet + "<p class=x>no</p><p class='a x' id=z>yes</p><div class=v>div</div><p class=v>no</p><i class=u>no</i><p class=q>q</p><p class=w>w</p><p class=r>r</p>").split() == ["yes", "div", "q", "w", "r"]
    assert render(sheet + "<div id=y>no <b style='visibility:visible'>yes</b> no</div><div id=y>no<p>no</p></div>after").split() == ["yes", "after"]
    assert render("<p hidden>no</p><p hidden style='display:block'>yes</p><p style='display:none;display:block'>two</p><p style='display:none!important;display:block'>no</p>").split() == ["yes", "two"]
    assert render("<style media=print>p{display:none}</style><p>a</p><style>p{display:none}</style>") == ""
    assert render("<div style='white-space:pre'>a   b\n c</div><pre style='white-space:normal'>d   e\nf</pre><p style='white-space:pre-line'>g  h\ni</p>") == "a   b\n c\n\nd e f\n\ng h\ni"
    assert render("<table style='visibility:hidden'><tr><td>no<td style='visibility:visible'>yes</table>").split() == ["yes"]
    assert render("<dialog>no</dialog><dialog open>yes</dialog>") == "yes"
