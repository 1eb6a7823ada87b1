"""The prefix trie against its contract by brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from ferrule.llm import prefix_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string, pos long, depth string, words string"


def naive(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [(r, x) for _, _, r, x in sorted(own[c])] for c in own}
    full = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = turns.get(c - c % 20, [])[:h] + turns[c][h:]
    members = defaultdict(list)
    for c in sorted(full):
        for d in range(len(full[c]) + 1):
            members[tuple(full[c][:d])].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)

    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[k] for k in kids[path]) or 1
        words = len(WORD.findall(path[-1][1])) if path else 0
        saved[path] = (len(members[path]) - 1) * words + sum(saved[k] for k in kids[path])
    out = []
    for path, who in members.items():
        ends = ",".join(str(c) for c in who if len(full[c]) == len(path))
        out.append((who[0], len(path), members[path[:-1]][0] if path else None, len(who), len(kids[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, 3, "d", "w") for r in rows], SCHEMA)
    assert Counter(tuple(r) for r in prefix_trie.build(df).collect()) == Counter(naive(rows))


def corpus(seed):
    rng = random.Random(seed)
    said = ["yes", "no", "hello there", "", None, " a b c\td ", "x " * 50]
    rows = []
    for c in rng.sample(range(200), 120):
        deep = rng.choice([0, 1, 2, 3, 5, 9])
        rows += [(c, t, rng.choice(["user", "user", None]), rng.choice(said)) for t in range(max(deep, 1))]
    rows += [(c, None, "system", "first of all") for c in (3, 40, 44, 61)]
    rows += [(500, t, "u", f"turn {t}") for t in range(60)] + [(501, t, "u", f"turn {t}") for t in range(60)] + [(523, t, "u", f"turn {t}") for t in range(59)]
    rows += [(None, 0, "user", "nobody's"), (None, None, None, None), (77, 2, "a", "same turn"), (77, 2, "a", "same turn"), (77, 2, "b", "")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie(spark, seed, monkeypatch):
    if seed == 2:  # chains and lists in many blocks and pieces
        monkeypatch.setattr(prefix_trie, "BLOCK", 7)
        monkeypatch.setattr(prefix_trie, "PIECE", 10)
    check(spark, corpus(seed))


def test_copies_of_one_conversation(spark):
    """A group that holds most rows, prefixes of it, and turnless conversations."""
    rows = [(c, t, "user", f"part {t}") for c in range(0, 400) for t in range(3)]
    rows += [(1000 + 20 * k, t, "user", f"part {t}") for k in range(5) for t in range(k)]
    rows += [(c, 0, "user", "short") for c in range(2001, 2020)]  # their first conversation is absent: most lose their only turn
    assert any(r[1] == 0 and r[3] > 1 and r[7] != prefix_trie.NONE for r in naive(rows))
    check(spark, rows)


def test_few(spark):
    check(spark, [(4, 1, "a", "b c")])
    assert prefix_trie.build(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefix_trie.build(spark.createDataFrame([(None, 1, "a", "b", 1, "", "")], SCHEMA)).count() == 0
