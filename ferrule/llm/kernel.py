"""Vectorised text kernels that run inside Arrow batches.

A batch of texts is one byte buffer with offsets.  Words are found with a
256-entry class table, hashed with a polynomial over the buffer's prefix sums
(one pass, no Python loop over words) and finished with a 64-bit mixer, so all
later work is on integer arrays.  Batches are cut at about a megabyte, which
bounds memory at any text length but that of a single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C55  # odd, so that it has an inverse modulo 2**64
_INV = pow(_BASE, -1, 1 << 64)
CHUNK = 1 << 20

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK + 1)
        out = np.empty(size, U)
        out[0] = 1
        filled = 1
        while filled < size:  # doubling keeps it vectorised
            step = min(filled, size - filled)
            out[filled : filled + step] = out[:step] * U(pow(base, filled, 1 << 64))
            filled += step
        have = out
        if size <= 2 * CHUNK + 1:
            _powers[base] = out
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def multiplier(j: int) -> np.uint64:
    return mix(np.array([0xD1342543DE82EF95 + 2 * j + 1], U))[0] | U(1)


def space_words() -> np.ndarray:
    """Bytes of words that white space (space, tab to carriage return) separates."""
    table = np.ones(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def plain_words() -> np.ndarray:
    """Bytes of words made of digits, lower-case letters and all non-ASCII characters."""
    table = np.zeros(256, bool)
    table[0x30:0x3A] = table[0x61:0x7B] = table[0x80:] = True
    return table


def ascii_lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 32
    return table


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32, len(column) + 1 + column.offset)
    offsets = offsets[column.offset :].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `limit` bytes; a longer text is alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


class Words:
    """The words of some texts: hash h, byte range [start, end), and first[d]..first[d+1] of text d."""

    __slots__ = ("buf", "end", "first", "h", "start")

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: np.ndarray | None, cuts: np.ndarray | None = None):
        if lower is not None:
            buf = lower[buf]
        self.buf = buf
        n = len(buf)
        inside = table[buf]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        if cuts is not None:  # where a word ends and the next begins, without a byte between
            edge[cuts] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:n]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | edge[1:n]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        sums = np.zeros(n + 1, U)
        np.cumsum((buf.astype(U) + U(1)) * _power(_BASE, n), out=sums[1:])
        h = (sums[self.end] - sums[self.start]) * _power(_INV, n + 1)[self.start]
        self.h = mix(h + (self.end - self.start).astype(U) * U(0xA24BAED4963EE407))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, a: int, b: int) -> bytes:
        """Words a..b-1, joined by one space."""
        return b" ".join(self.buf[s:e].tobytes() for s, e in zip(self.start[a:b].tolist(), self.end[a:b].tolist(), strict=True))

    def grams(self, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The hash of words i..i+k-1 for each i, and whether they lie within one text.  Salts give independent hashes."""
        n = len(self.h)
        if n < k:
            return np.zeros(0, U), np.zeros(0, bool)
        g = self.h[: n - k + 1] * multiplier(salt << 32)
        for j in range(1, k):
            g += self.h[j : n - k + 1 + j] * multiplier((salt << 32) + j)
        last = np.repeat(self.first[1:], self.counts)[: n - k + 1]
        return mix(g), np.arange(n - k + 1) + k <= last

    def whole(self, d: int) -> np.uint64:
        """A hash of all words of text d, distinct from that of any k-gram."""
        a, b = int(self.first[d]), int(self.first[d + 1])
        g = U((b - a) * 0x51ED270B27D4EB2F % (1 << 64))
        with np.errstate(over="ignore"):
            for j in range(b - a):
                g += self.h[a + j] * multiplier(j)
        return mix(np.array([g], U))[0]


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingles of each text, and where those of text d begin."""
    n_docs = len(words.first) - 1
    counts = words.counts
    grams, valid = words.grams(k)
    owner = np.repeat(np.arange(n_docs), counts)[: len(grams)][valid]
    grams = grams[valid]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        grams = np.concatenate([grams, np.array([words.whole(d) for d in short.tolist()], U)])
        owner = np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        grams, owner = grams[order], owner[order]
    first = np.searchsorted(owner, np.arange(n_docs + 1))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        grams[a:b].sort()
    keep = np.ones(len(grams), bool)
    keep[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[keep], np.searchsorted(owner[keep], np.arange(n_docs + 1))


def signatures(tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit sum over each set; equal sets have equal sums."""
    one = np.concatenate([[U(0)], np.cumsum(mix(tokens ^ U(0x2545F4914F6CDD1D)))])
    two = np.concatenate([[U(0)], np.cumsum(mix(tokens + U(0x632BE59BD9B4E019)))])
    return (one[first[1:]] - one[first[:-1]]).view(np.int64), (two[first[1:]] - two[first[:-1]]).view(np.int64)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i]+lengths[i]-1 of every i, one after another."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(before - np.asarray(starts, np.int64), lengths)


def blobs(values: list[np.ndarray]) -> pa.Array:
    return pa.array([v.tobytes() for v in values], pa.binary())


def from_blob(blob: bytes | None, kind: type = np.uint64) -> np.ndarray:
    return np.frombuffer(blob or b"", kind)
