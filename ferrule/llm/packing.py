"""Best-fit packing of token sequences, after Martello-Toth dominance reduction.

Lengths are whole numbers up to the capacity, so an instance of any size is
described by at most `capacity` counts.  Those are all that the driver sees.
It fixes sets of at most two documents that dominate every alternative for
their longest document (a perfect pair, a document that nothing fits with, a
best partner that no feasible pair or triple beats), takes them out, and
repeats on what is left; the remainder is packed by best fit, longest first.
Equal lengths are interchangeable, so both steps move whole counts: the plan is
a list of (length, ranks from..to, first sequence, offset) whose size is
bounded by the capacity too.  Each piece then finds its move by its rank among
the pieces of its length, in parallel.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import CHUNK, Words, ascii_lower, buffers, pieces, ragged, space_words
from .sharding import TIE, numbered, tied
from .store import Scratch, shards_for, ship

CACHED_WORDS = 1 << 20


@dataclass
class Plan:
    """Moves, sorted by length and rank, and how many sequences they fill."""

    length: np.ndarray
    rank: np.ndarray
    first: np.ndarray
    offset: np.ndarray
    sequences: int
    fixed: int

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces of these lengths and ranks."""
        wide = int(self.rank.max()) + 1 if len(self.rank) else 1
        wide = max(wide, int(rank.max()) + 1 if len(rank) else 1)
        at = np.searchsorted(self.length * wide + self.rank, length.astype(np.int64) * wide + rank, "right") - 1
        return self.first[at] + rank - self.rank[at], self.offset[at]


def make_plan(counts: dict[int, int], capacity: int) -> Plan:
    """Packs counts[length] pieces of each length into sequences of `capacity`."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is not within 1 and {capacity}")
        left[length] += n
    taken = np.zeros(capacity + 1, np.int64)
    moves: list[tuple[int, int, int, int]] = []
    sequences = 0

    def put(length: int, n: int, first: int, offset: int) -> None:
        moves.append((length, int(taken[length]), first, offset))
        taken[length] += n
        left[length] -= n

    # reduction: the longest document's set is fixed while one dominates
    for long in range(capacity, 0, -1):
        while left[long]:
            room = capacity - long
            left[long] -= 1
            partner = _largest(left, room)
            sure = partner == 0 or partner == room or _dominates(left, partner, room)
            left[long] += 1
            if not sure:
                break
            if partner == 0:
                n = int(left[long])
            else:
                n = int(left[long]) // 2 if partner == long else int(min(left[long], left[partner]))
            put(long, n, sequences, 0)
            if partner:
                put(partner, n, sequences, long)
            sequences += n
    fixed = sequences

    # best fit of the rest; sequences of equal room are interchangeable
    rooms: list[int] = []
    ranges: dict[int, list[tuple[int, int]]] = {}

    def give(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in ranges:
                ranges[room] = []
                insort(rooms, room)
            ranges[room].append((first, n))

    for long in range(capacity, 0, -1):
        while left[long]:
            at = bisect_left(rooms, long)
            if at < len(rooms):
                room = rooms[at]
                first, n = ranges[room].pop()
                if not ranges[room]:
                    del ranges[room], rooms[at]
            else:
                room, first = capacity, sequences
                n = -(-int(left[long]) // (capacity // long))
                sequences += n
            each = room // long
            full = min(n, int(left[long]) // each)
            for j in range(each if full else 0):
                put(long, full, first, capacity - room + j * long)
            give(room - each * long, first, full)
            rest = min(int(left[long]), each - 1) if full < n else 0
            for j in range(rest):
                put(long, 1, first + full, capacity - room + j * long)
            if full < n:
                give(room - rest * long, first + full, 1)
                give(room, first + full + 1, n - full - 1)
    table = np.array(sorted(moves), np.int64).reshape(-1, 4)
    return Plan(table[:, 0], table[:, 1], table[:, 2], table[:, 3], sequences, fixed)


def _largest(left: np.ndarray, room: int) -> int:
    """The longest length that is left and fits; 0 if none does."""
    some = np.flatnonzero(left[: room + 1])
    return int(some[-1]) if len(some) else 0


def _dominates(left: np.ndarray, partner: int, room: int) -> bool:
    """No feasible set of two or more is longer than the single best partner."""
    sizes = np.flatnonzero(left[: room + 1])
    smallest = np.repeat(sizes[:3], np.minimum(left[sizes[:3]], 3))[:3]
    if len(smallest) < 2 or smallest[0] + smallest[1] > room:
        return True
    if len(smallest) == 3 and smallest.sum() <= room:
        return False
    for s in sizes.tolist():  # only pairs fit: is the best of them no longer than the partner?
        left[s] -= 1
        other = _largest(left, room - s)
        left[s] += 1
        if other and s + other > partner:
            return False
    return True


def _units(buf: np.ndarray, offsets: np.ndarray) -> Words:
    """Parts of texts that are tokenized each by itself, so that few of them are distinct.

    White space separates pre-tokens, and so does the place between an ASCII
    letter and ASCII punctuation; A-Z are lower-cased, as the tokenizer does.
    Texts that may hold special tokens, which are told before both, are only
    cut at white space.
    """
    if b"<|" in buf.tobytes():
        return Words(buf, offsets, space_words(), None)
    letter, mark = np.zeros(256, bool), np.zeros(256, bool)
    letter[0x41:0x5B] = letter[0x61:0x7B] = True
    mark[0x21:0x7F] = ~letter[0x21:0x7F]
    mark[0x30:0x3A] = False
    cuts = np.flatnonzero(letter[buf[:-1]] & mark[buf[1:]]) + 1
    return Words(buf, offsets, space_words(), ascii_lower(), cuts)


_encoders: dict[str, _Encoder] = {}


def _encoder(path: str) -> _Encoder:
    """One a process: tasks that follow each other share what is cached."""
    if path not in _encoders:
        _encoders[path] = _Encoder(path)
    return _encoders[path]


class _Encoder:
    """Token ids of units: a text's ids are its units' ids in a row."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.hashes, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # sorted by hash
        self.ids = np.zeros(1 << 16, np.uint32)
        self.start, self.size, self.used = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32), 0

    def __call__(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in a row, and how many each has."""
        distinct, first, which = np.unique(words.h, return_index=True, return_inverse=True)
        if len(self.hashes) + len(distinct) > CACHED_WORDS:
            self.clear()
        at = np.searchsorted(self.hashes, distinct)
        new = np.flatnonzero(self.hashes[np.minimum(at, len(self.hashes) - 1)] != distinct) if len(self.hashes) else np.arange(len(distinct))
        if len(new):
            texts = [words.buf[words.start[i] : words.end[i]].tobytes().decode("utf-8", "replace") for i in first[new].tolist()]
            ids, size = self._encode(texts)
            slot = len(self.hashes) + np.arange(len(new), dtype=np.int32)
            while self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            while slot[-1] >= len(self.start):
                self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
            self.size[slot] = size
            self.start[slot] = self.used + np.cumsum(size) - size
            self.ids[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
            self.hashes, self.slots = np.insert(self.hashes, at[new], distinct[new]), np.insert(self.slots, at[new], slot)
            at = np.searchsorted(self.hashes, distinct)
        slots = self.slots[at][which]
        size = self.size[slots]
        return self.ids[ragged(self.start[slots], size)], size

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts in a row, and how many each has.

        Words of letters alone are one pre-token each, which ends in one token
        that closes a word, so many are encoded as one text.  Where the number
        of such tokens tells otherwise, and for all others, each is encoded by
        itself.
        """
        sizes = np.zeros(len(texts), np.int64)
        parts: list[np.ndarray] = []
        order: list[np.ndarray] = []
        plain = np.array([t.isalpha() for t in texts], bool)
        rest = [np.flatnonzero(~plain)]
        groups = [g for g in np.array_split(np.flatnonzero(plain), -(-int(plain.sum()) // 256)) if len(g)] if plain.any() else []
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(texts[i] for i in g.tolist()) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            last = np.flatnonzero(self.closes[ids])
            if len(last) != len(group):
                rest.append(group)
                continue
            sizes[group] = np.diff(last, prepend=-1)
            parts.append(ids)
            order.append(group)
        single = np.concatenate(rest)
        each = [e.ids for e in self.tokenizer.encode_batch_fast([texts[i] for i in single.tolist()], add_special_tokens=False)]
        sizes[single] = list(map(len, each))
        parts.append(np.array([x for row in each for x in row], np.uint32))
        order.append(single)
        at, ids = np.concatenate(order), np.concatenate(parts)
        begin = np.empty(len(texts), np.int64)
        begin[at] = np.cumsum(sizes[at]) - sizes[at]
        return ids[ragged(begin, sizes)], sizes


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        tail = np.array([end_id], np.uint32)
        for batch in batches:
            buf, offsets = buffers(batch.column(1))
            docs = batch.column(0).to_pylist()
            for a, b in pieces(offsets, 2 * CHUNK):  # fewer parts repeat the commonest words
                words = _units(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ids, size = encoder(words)
                before = np.concatenate([[0], np.cumsum(size)])[words.first].tolist()
                out: list[tuple] = []
                for d in range(b - a):
                    own = np.concatenate([ids[before[d] : before[d + 1]], tail])
                    for k, s in enumerate(range(0, len(own), capacity)):
                        part = own[s : s + capacity]
                        out.append((docs[a + d], k, s, len(part), zlib.crc32(part.astype("<u4").tobytes()), part))
                columns = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([x[5].astype(np.int32) for x in out], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def token_pieces(docs: DataFrame, tokenizer: str, *, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Each text's token ids, closed by end_id and cut into pieces of at most `capacity`.

    `tokenizer` is the path of a vocabulary file whose pre-tokens never span
    white space, on every executor.  Returns doc_id, piece, start, length,
    ids_crc32 (of the ids as little-endian unsigned 32-bit numbers) and, with
    with_ids, ids.  A null text counts as empty: its one piece is end_id.
    """
    ship(docs.sparkSession)
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, capacity, end_id, with_ids), kind)


def _locate(plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        for batch in batches:
            names = batch.schema.names
            length, rank = (batch.column(names.index(x)).to_numpy() for x in ("length", "slot"))
            sequence, offset = p.find(length, rank)
            kept = [i for i, x in enumerate(names) if x != "slot"]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*[names[i] for i in kept], "sequence_id", "offset"])

    return run


def pack(items: DataFrame, order: list[str], *, capacity: int = 4096, slice_rows: int = 100_000) -> DataFrame:
    """Adds sequence_id and offset to items, which have a `length` of 1 to `capacity`.

    `order` are columns that tell items apart; items that they don't tell
    apart share no place, whichever comes first.  An item of another length is
    an error.  An empty table gives an empty one.  items is read three times,
    so it should be a written table.
    """
    spark = items.sparkSession
    counts = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan = spark.sparkContext.broadcast(make_plan(counts, capacity))
    ranked = numbered(items, ["length"], order, shards_for(sum(counts.values()), slice_rows, 32))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    return ranked.select(*items.columns, F.col("slot").cast("long").alias("slot")).mapInArrow(_locate(plan), f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, *, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """A row for each piece of each text, with its sequence and place there.

    docs has doc_id and text; other columns are ignored.  Null and empty texts
    are a piece of one token; repeated rows and rows without doc_id are packed
    each.  Only texts of more than `capacity` tokens are cut.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    items = scratch.keep(tied(token_pieces(docs, tokenizer, capacity=capacity, end_id=end_id)), "pieces")
    return pack(items, ["doc_id", "piece", "start", "ids_crc32", TIE], capacity=capacity).drop(TIE)
