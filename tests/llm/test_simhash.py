"""SimHash near-duplicates against fingerprints and links by brute force."""

import random

import numpy as np
import pytest
import xxhash

from ferrule.llm import simhash
from ferrule.llm.store import Scratch

from . import fixtures as fx


def naive_fingerprint(text):
    w = fx.SPACE_WORD.findall((text or "").translate(fx.LOWER))
    grams = [" ".join(w)] if 0 < len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(fps, distance=2):
    """The smallest fingerprint that links reach, of each."""
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    own = sorted(root)
    for i, a in enumerate(own):
        for b in own[:i]:
            if (a ^ b).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in own}


def signed(f):
    return f - (1 << 64) if f >> 63 else f


@pytest.mark.parametrize("options", [{}, {"most": 2}, {"segments": 8, "most": 3}, {"distance": 1}, {"segments": 64}])
def test_near_copies(spark, options):
    rows = fx.corpus(3)
    fps = [(i, naive_fingerprint(t)) for i, t in rows]
    root = roots({f for _, f in fps}, options.get("distance", 2))
    least = {}
    for i, f in fps:
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    got = simhash.near_copies(fx.frame(spark, rows), **options).collect()
    want = [(i or 0, f"{f:016x}", least.get(root[f]) or 0) for i, f in fps]
    assert sorted((r.doc_id or 0, r.fingerprint, r.component_id or 0) for r in got) == sorted(want)


def test_links_of_dense_and_scattered_fingerprints(spark):
    """A family that walks away bit by bit, a ball of radius two, pairs at each distance: few rows, all components."""
    rng = random.Random(5)
    fps, walk, centre = set(), rng.getrandbits(64), rng.getrandbits(64)
    for _ in range(150):
        fps.add(walk)
        walk ^= 1 << rng.randrange(64)
    fps |= {centre ^ 1 << a ^ 1 << b for a in range(0, 64, 3) for b in range(0, 64, 5)}
    for d in range(5):
        a = rng.getrandbits(64)
        fps |= {a, a ^ sum(1 << b for b in rng.sample(range(64), d))}
    fps |= {0, (1 << 64) - 1, 1, 3, 7, 1 << 63}
    root = roots(fps)
    table = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    for options in ({}, {"segments": 32, "most": 4}, {"segments": 4, "most": 8}):
        found = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in simhash.links(table, Scratch(spark, "t"), **options).collect()]
        assert all((a ^ b).bit_count() <= 2 for a, b in found)
        joined = {f: f for f in fps}

        def find(f, joined=joined):
            while joined[f] != f:
                f = joined[f]
            return f

        for a, b in found:
            x, y = find(a), find(b)
            joined[max(x, y)] = min(x, y)
        assert {f: find(f) for f in fps} == root


def test_cells_meet_within_the_radius():
    """Two fingerprints share a cell if their counts are within two, and links always are."""
    rng = np.random.default_rng(1)
    one = rng.integers(-(1 << 63), 1 << 63, 300)
    other = one ^ (np.int64(1) << rng.integers(0, 63, 300)) ^ (np.int64(1) << rng.integers(0, 63, 300))
    for segments in (2, 8, 16, 64):
        a, b = ([set(simhash.cells(x[i : i + 1], segments)[0].tolist()) for i in range(300)] for x in (one, other))
        far = np.abs(simhash._counts(one, segments).astype(int) - simhash._counts(np.roll(one, 1), segments)).sum(axis=1)
        assert all(x & y for x, y in zip(a, b, strict=True))
        assert [bool(x & y) for x, y in zip(a, a[-1:] + a[:-1], strict=True)] == (far <= 2).tolist()
        assert max(map(len, a)) <= 1 + 2 * segments


def test_pieces_and_long_texts(monkeypatch):
    """Cutting a text into pieces changes nothing; separators are those of ASCII only."""
    text = fx.corpus(1)[7][1] or "a b"
    texts = [t for _, t in fx.corpus(2) if t] + ["nbsp is no\u0085blank x", "one\x1ctwo three four", " \x0b\x0c ", text]
    whole = [simhash.fingerprint(t.encode()) for t in texts]
    assert whole == [signed(naive_fingerprint(t)) for t in texts]
    for size in (1, 7, 50):
        monkeypatch.setattr(simhash, "PIECE", size)
        assert [simhash.fingerprint(t.encode()) for t in texts] == whole


def test_empty_hot_and_wrong(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_copies(empty).count() == 0
    got = simhash.near_copies(spark.createDataFrame([(5, None), (None, ""), (3, " \n"), (None, "x")], "doc_id long, text string")).collect()
    zero = [r for r in got if r.fingerprint == "0" * 16]
    assert sorted((r.doc_id or 0, r.component_id) for r in zero) == [(0, 3), (3, 3), (5, 3)]
    assert [r.component_id for r in got if r.fingerprint != "0" * 16] == [None]
    hot = spark.createDataFrame([(i, "the same text again") for i in range(3000)] + [(3000 + i, f"text number {i} of many {i}") for i in range(300)], "doc_id long, text string")
    rows = simhash.near_copies(hot).collect()
    assert len(rows) == 3300 and {r.component_id for r in rows if r.doc_id < 3000} == {0}
    with pytest.raises(ValueError):
        simhash.near_copies(empty, distance=3)
