"""Small awkward corpora, and the contracts restated by brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, n string, _id string"


def corpus(seed: int = 1) -> list[tuple[int | None, str | None]]:
    """Copies, near copies, shared passages, nulls, blanks, a very long text, repeated rows."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ka", "to", "mi", "é", "ß", "ru", "Ne", "x", "中"]) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() + rng.choice(["", "", "", ",", ".", "\n", "\t"]) for _ in range(n))
    passage = prose(60)
    base = prose(150).split(" ")
    texts: list[str | None] = [None, "", "   \n\t ", "one", "one", "two words", "a b c d", "a b c d e", "A B C D E", "the\x0bvertical\x0ctab"]
    for _ in range(60):  # a family of near copies, some far from others
        own = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 4, 8])):
            own[rng.randrange(len(own))] = word()
        texts.append(" ".join(own))
    for _ in range(25):
        texts.append(prose(rng.randint(1, 90)) + " " + passage + " " + prose(rng.randint(0, 60)))
    for _ in range(40):
        texts.append(prose(rng.randint(1, 200)))
    texts += [texts[-1], texts[-2], texts[-2].upper(), texts[-3] + " ", prose(20_000), "word " * 400, ("line of words that repeats\n") * 30]
    rng.shuffle(texts)
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[20], (None, "no id here at all"), (None, None)]


def frame(spark, rows):
    """With columns that clash with names which operators use."""
    return spark.createDataFrame([(i, t, None, "src0", None, None, "s", "n", "x") for i, t in rows], SCHEMA)


def shingles(text: str | None, k: int = 5) -> frozenset:
    w = SPACE_WORD.findall((text or "").translate(LOWER))
    return frozenset([tuple(w)]) if 0 < len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def components(rows) -> dict:
    """Smallest doc_id that links of 0.8 reach, by each text."""
    sets = {t: shingles(t) for _, t in rows}
    texts = [t for t in sets if sets[t]]
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            common = len(sets[a] & sets[b])
            if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                root[find(a)] = find(b)
    least: dict = {}
    for i, t in rows:
        if i is not None and sets[t]:
            least[find(t)] = min(least.get(find(t), i), i)
    return {t: least.get(find(t)) for t in texts}


def links(rows) -> dict:
    """Number of other rows that a text's row is linked with."""
    sets = [shingles(t) for _, t in rows]
    out = {}
    for k, (_, t) in enumerate(rows):
        out[t] = sum(100 * len(sets[k] & x) >= 80 * len(sets[k] | x) for j, x in enumerate(sets) if j != k and x and sets[k])
    return out


def hits(text: str | None, items: list[tuple]) -> tuple[int, int, list[str]]:
    w = PLAIN_WORD.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item_id, item in items:
        if item_id is None:
            continue
        v = PLAIN_WORD.findall((item or "").translate(LOWER))
        windows = {tuple(v[i : i + 10]) for i in range(max(len(v) - 9, 1))} if v else set()
        for window in windows:
            for s in range(len(w) - len(window) + 1):
                if tuple(w[s : s + len(window)]) == window:
                    hit.update(range(s, s + len(window)))
                    found.add(str(item_id))
    return len(w), len(hit), sorted(found)


def kept_words(rows) -> dict:
    """(doc_id, text) -> words that stay; documents of one id by a hash of the text, without ids last."""
    seen, out = set(), {}
    for i, t in rows:
        w = SPACE_WORD.findall(t or "")
        gone, own = set(), []
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            if key in seen:
                gone.update(range(s, s + 20))
            else:
                own.append(key)
                seen.add(key)
        out[i, t] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def crc(text: str) -> int:
    return zlib.crc32(text.encode())
