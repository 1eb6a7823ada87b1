"""The divergence audit against its contract by brute force."""

import random
import re
from collections import Counter, defaultdict

import pytest

from ferrule.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def naive(rows, least_docs, top=50):
    docs = [(a or "", b or "", TERM.findall((t or "").translate(LOWER))) for a, b, t in rows]
    out = []
    for lang in {a for a, _, _ in docs}:
        own = [(s, w) for a, s, w in docs if a == lang]
        seen = Counter(x for _, w in own for x in set(w))
        kept = {x for x, n in seen.items() if n >= least_docs}
        counts = defaultdict(Counter)
        for s, w in own:
            counts[s].update(x for x in w if x in kept)
        whole = sum(counts.values(), Counter())

        def p(c, x, kept=kept):
            return 1 + 10**9 * (c[x] + 5) // (sum(c.values()) + 5 * len(kept))

        for s, c in counts.items():
            pairs = [(o, sum(abs(p(c, x) - p(d, x)) for x in kept)) for o, d in counts.items() if o != s]
            terms = [(x, p(c, x) - p(whole, x)) for x in kept if c[x] and p(c, x) > p(whole, x)]
            for part, items in (("pair", pairs), ("term", terms)):
                ranked = sorted(items, key=lambda i: (-i[1], i[0].encode()))
                out += [(lang, s, part, item, value, r) for r, (item, value) in enumerate(ranked, 1) if part == "pair" or r <= top]
    return out


def corpus(seed, n=160):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "été", "ÉTÉ", "über", "中文", "x", "don't", "a1b", "Z z", "naïve", "\U0001f600", *[f"w{chr(97 + i)}" for i in range(26)]]
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "S2", "é", None, "only digits"]), " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 20, 60])))) for _ in range(n)]
    rows += [("en", "s1", None), ("fr", "lonely", "word " * 40), ("it", "a", "12 34"), ("it", "b", ""), ("en", "hot", "beta " * 5000), rows[0], rows[0]]
    return rows


@pytest.mark.parametrize("seed, least, tile", [(1, 1, 256), (2, 5, 2), (3, 30, 1)])
def test_audit(spark, seed, least, tile):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, a, s, "x", 7, "tile") for i, (a, s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, n int, item string")
    got = [tuple(r) for r in divergence.audit(df, least_docs=least, tile=tile).collect()]
    assert Counter(got) == Counter(naive(rows, least))


def test_top_and_ties(spark):
    rows = [("en", s, " ".join(f"{s}{chr(97 + i)}" for i in range(12)) + " same") for s in ("p", "q") for _ in range(3)]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    got = [tuple(r) for r in divergence.audit(df, least_docs=2, top=5).collect()]
    assert Counter(got) == Counter(naive(rows, 2, 5)) and max(r[5] for r in got if r[2] == "term") == 5


def test_probability_is_exact_for_large_counts(spark):
    from pyspark.sql import functions as F

    cases = [(c, n, v) for c in (0, 1, 10**17, 10**18 - 5) for n in (0, 7, 10**18) for v in (1, 10**7)]
    df = spark.createDataFrame(cases, "c long, n long, v long").withColumn("p", divergence.probability(F.col("c"), F.col("n"), F.col("v")))
    for r in df.where("c <= n").collect():
        assert r.p == 1 + 10**9 * (r.c + 5) // (r.n + 5 * r.v)


def test_empty(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0
    bare = divergence.audit(spark.createDataFrame([(None, None, "a"), ("..", None, "b")], "text string, lang string, source string")).collect()
    assert sorted(map(tuple, bare)) == [("", "a", "pair", "b", 0, 1), ("", "b", "pair", "a", 0, 1)]
