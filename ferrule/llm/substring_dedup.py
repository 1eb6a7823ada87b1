"""Removal of passages that occur earlier in the corpus, by fixed-block anchors.

Every text is cut into non-overlapping reference blocks of half the window's
words.  A window that repeats one in another place contains at least one whole
reference block of that place, so only windows over anchors can be repeats.

1. Blocks are indexed and every rolling window of a block's length probes the
   index: both are dealt by hash, and a block that occurs anywhere else is an
   anchor.  Two bits a cell of a table of fixed size say which rolling windows
   repeat at all and which are anchors; it is all that is broadcast, and false
   bits only cost work.
2. Anchors are extended over rolling windows that repeat to maximal runs.  Each
   window of a run that holds an anchor is dealt out by a hash of 128 bits of
   all its words, each task sending only its own earliest place of a hash; the
   earliest of all is found, and goes back to its text.
3. A text's windows in runs, without those that are the first of their kind,
   are repeats; the words that they cover are removed.

Nothing is cut off: popular passages cost each task one entry a window, not
one a copy, and no pairs of copies are made.  Among n windows, two that differ
share a hash of 128 bits with a chance of about n**2 / 2**129.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import U, Words, buffers, from_blob, mix, pieces, space_words
from .store import Scratch, shards_for, ship, small_batches

FLUSH = 1 << 22
LAST = (1 << 63) - 1


def _chunks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, Words]]:
    buf, offsets = buffers(batch.column(column))
    table = space_words()
    for a, b in pieces(offsets):
        yield a, b, Words(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], table, None)


def _deal_anchors(window: int, bits: int):
    """Rolling hashes of a block's length, and which of them are reference blocks, by bucket."""
    block = window // 2

    def deal(rolled: list[np.ndarray], aligned: list[np.ndarray]) -> pa.RecordBatch:
        def split(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            hashes.sort()
            short = hashes >> U(32 - bits)
            first = np.flatnonzero(np.concatenate([[True], short[1:] != short[:-1]])) if len(short) else np.zeros(0, np.int64)
            many = np.diff(np.append(first, len(short))) > 1
            short = short[first]
            return short.astype(np.uint32), many, np.searchsorted((short >> U(32)).astype(np.int64), np.arange((1 << bits) + 1))

        r, many, rc = split(np.concatenate(rolled))
        x, _, xc = split(np.concatenate(aligned))
        rows = [i for i in range(1 << bits) if rc[i + 1] > rc[i]]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(rows, pa.int32()),
                pa.array([r[rc[i] : rc[i + 1]].tobytes() for i in rows], pa.binary()),
                pa.array([r[rc[i] : rc[i + 1]][many[rc[i] : rc[i + 1]]].tobytes() for i in rows], pa.binary()),
                pa.array([x[xc[i] : xc[i + 1]].tobytes() for i in rows], pa.binary()),
            ],
            ["bucket", "rolled", "again", "blocks"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolled, aligned, size = [], [], 0
        for batch in batches:
            for _, _, words in _chunks(batch, 0):
                grams, valid = words.grams(block)
                counts = words.counts
                valid &= np.repeat(counts, counts)[: len(grams)] >= window  # shorter texts have no window
                offset = np.arange(len(grams)) - np.repeat(words.first[:-1], counts)[: len(grams)]
                rolled.append(grams[valid])
                aligned.append(grams[valid & (offset % block == 0)])
                size += len(rolled[-1])
                if size >= FLUSH:
                    yield deal(rolled, aligned)
                    rolled, aligned, size = [], [], 0
        if size:
            yield deal(rolled, aligned)

    return run


def _hits(bits: int, table_bits: int):
    """A bucket's slice of the table: cells of rolling windows that occur more than once, and of blocks among them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rolled = np.concatenate([from_blob(x, np.uint32) for x in [*pdf["rolled"], *pdf["again"]]])
        rolled.sort()
        twice = np.unique(rolled[1:][rolled[1:] == rolled[:-1]])
        blocks = np.unique(np.concatenate([from_blob(x, np.uint32) for x in pdf["blocks"]]))
        hit = np.intersect1d(twice, blocks, assume_unique=True)
        cells = np.zeros((2, 1 << (table_bits - bits)), bool)
        for k, some in enumerate((twice, hit)):
            cells[k, (some >> np.uint32(32 - (table_bits - bits))).astype(np.int64)] = True
        return pd.DataFrame({"bucket": [int(pdf["bucket"].iloc[0])], "cells": [zlib.compress(np.packbits(cells, axis=1).tobytes(), 1)]})

    return run


def _anchor_table(texts: DataFrame, window: int, table_bits: int, rows: int) -> bytes:
    bits = min(max(4, (shards_for(rows, 2000) - 1).bit_length()), table_bits - 6)
    dealt = texts.mapInArrow(_deal_anchors(window, bits), "bucket int, rolled binary, again binary, blocks binary")
    with small_batches(texts.sparkSession):
        slices = dealt.groupBy("bucket").applyInPandas(_hits(bits, table_bits), "bucket int, cells binary").collect()
    table = np.zeros((2, 1 << bits, 1 << (table_bits - bits - 3)), np.uint8)
    for row in slices:
        table[:, row["bucket"]] = np.frombuffer(zlib.decompress(bytes(row["cells"])), np.uint8).reshape(2, -1)
    return zlib.compress(table.tobytes(), 1)


def _unpack(shared) -> np.ndarray:
    return np.frombuffer(zlib.decompress(shared.value), np.uint8).reshape(2, -1)


def _candidates(words: Words, window: int, table: np.ndarray, table_bits: int) -> np.ndarray:
    """Starts of windows all of whose rolling blocks repeat, with an anchor among them: the windows of maximal runs."""
    block = window // 2
    grams, valid = words.grams(block)
    cell = (grams >> U(64 - table_bits)).astype(np.int64)
    bit = np.uint8(128) >> (cell & 7).astype(np.uint8)
    repeats = valid & (table[0][cell >> 3] & bit > 0)
    inside = window - block + 1
    if len(repeats) < inside:
        return np.zeros(0, np.int64)
    run = np.concatenate([[0], np.cumsum(repeats)])
    start = np.flatnonzero(run[inside:] - run[:-inside] == inside)
    anchors = np.concatenate([[0], np.cumsum(repeats & (table[1][cell >> 3] & bit > 0))])
    return start[anchors[start + inside] > anchors[start]]


ENTRY = np.dtype([("h", np.uint64), ("h2", np.uint64), ("doc", np.int64), ("text", np.int64), ("at", np.int64)])


def _earliest(entries: np.ndarray) -> np.ndarray:
    """Of equal hashes the entry of the smallest document, text and place."""
    entries = entries[np.lexsort([entries["at"], entries["text"], entries["doc"], entries["h2"], entries["h"]])]
    new = (entries["h"][1:] != entries["h"][:-1]) | (entries["h2"][1:] != entries["h2"][:-1])
    return entries[np.concatenate([[True], new])] if len(entries) else entries


def _deal(entries: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    """Rows of (bucket, entries).  Documents are listed once a row."""
    order = np.argsort(bucket, kind="stable")
    entries, bucket = entries[order], bucket[order]
    names, cut = np.unique(bucket, return_index=True)
    out = []
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(entries)], strict=True):
        part = entries[a:b]
        own, which = np.unique(part[["doc", "text"]], return_inverse=True)
        out.append((part["h"].tobytes(), part["h2"].tobytes(), which.astype(np.uint32).tobytes(), part["at"].astype(np.uint32).tobytes(), own["doc"].tobytes(), own["text"].tobytes()))
    columns = [pa.array([x[i] for x in out], pa.binary()) for i in range(6)]
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), *columns], ["bucket", "h", "h2", "which", "at", "doc", "text"])


DEALT = "bucket int, h binary, h2 binary, which binary, at binary, doc binary, text binary"


def _gather(pdf: pd.DataFrame) -> np.ndarray:
    parts = []
    for h, h2, which, at, doc, text in zip(pdf["h"], pdf["h2"], pdf["which"], pdf["at"], pdf["doc"], pdf["text"], strict=True):
        which = from_blob(which, np.uint32)
        part = np.empty(len(which), ENTRY)
        part["h"], part["h2"], part["at"] = from_blob(h), from_blob(h2), from_blob(at, np.uint32)
        part["doc"], part["text"] = from_blob(doc, np.int64)[which], from_blob(text, np.int64)[which]
        parts.append(part)
    return np.concatenate(parts)


def _deal_windows(window: int, table_bits: int, bits: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, size = _unpack(shared), [], 0
        for batch in batches:
            doc, text = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b, words in _chunks(batch, 2):
                start = _candidates(words, window, table, table_bits)
                if not len(start):
                    continue
                own = np.searchsorted(words.first, start, "right") - 1
                part = np.empty(len(start), ENTRY)
                part["h"], part["h2"], part["at"] = words.grams(window)[0][start], words.grams(window, 1)[0][start], start - words.first[own]
                part["doc"], part["text"] = doc[a:b][own], text[a:b][own]
                held.append(part)
                size += len(part)
                if size >= FLUSH // 4:
                    first = _earliest(np.concatenate(held))
                    yield _deal(first, (first["h"] >> U(64 - bits)).astype(np.int64))
                    held, size = [], 0
        if size:
            first = _earliest(np.concatenate(held))
            yield _deal(first, (first["h"] >> U(64 - bits)).astype(np.int64))

    return run


def _firsts(parts: int):
    """The earliest place of each window of a bucket, dealt to the documents' buckets."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = _earliest(_gather(pdf))
        first["h"] = first["h2"] = 0
        # by a hash, so that neither regular doc_ids nor many rows without one meet in few buckets
        own = mix(first["doc"].astype(U) ^ mix(first["text"].astype(U))) % U(parts)
        return _deal(first, own.astype(np.int64)).to_pandas()

    return run


def _by_document(pdf: pd.DataFrame) -> pd.DataFrame:
    entries = _gather(pdf)
    entries = entries[np.lexsort([entries["at"], entries["text"], entries["doc"]])]
    new = np.flatnonzero(np.concatenate([[True], (entries["doc"][1:] != entries["doc"][:-1]) | (entries["text"][1:] != entries["text"][:-1])]))
    at = entries["at"].astype(np.uint32)
    return pd.DataFrame({"doc": entries["doc"][new], "text_hash": entries["text"][new], "firsts": [at[a:b].tobytes() for a, b in zip(new.tolist(), [*new[1:].tolist(), len(at)], strict=True)]})


def _remove(window: int, table_bits: int, shared):
    """(doc_id, text, firsts) -> the words that stay, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _unpack(shared)
        for batch in batches:
            firsts = batch.column(2)
            for a, b, words in _chunks(batch, 1):
                start = _candidates(words, window, table, table_bits)
                repeat = np.zeros(len(words.h) + 1, bool)
                repeat[start] = True
                for d, blob in enumerate(firsts.slice(a, b - a).to_pylist()):
                    if blob:
                        repeat[from_blob(blob, np.uint32).astype(np.int64) + words.first[d]] = False
                at = np.flatnonzero(repeat)
                depth = np.zeros(len(words.h) + 1, np.int64)
                np.add.at(depth, at, 1)
                np.add.at(depth, at + window, -1)
                kept = np.cumsum(depth)[:-1] == 0
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(words.counts, pa.int64()), *_join(words, kept)], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def _join(words: Words, kept: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """How many words of each text go, and those that stay, joined by one space."""
    n = len(words.buf)
    owner = np.repeat(np.arange(len(words.first) - 1), words.counts)
    change = np.zeros(n + 1, np.int64)
    change[words.start[kept]] += 1
    np.add.at(change, words.end[kept], -1)
    inside = np.cumsum(change)[:-1] > 0
    out = words.buf.copy()
    stay = np.flatnonzero(kept)
    gap = words.end[stay[:-1]][owner[stay[:-1]] == owner[stay[1:]]] if len(stay) else stay
    out[gap] = 0x20
    inside[gap] = True
    total = np.concatenate([[0], np.cumsum(inside)])
    # where each text begins in the buffer: its first word's start is enough, as bytes between are left out
    begin = np.append(words.start, n)[words.first[:-1]] if len(words.first) > 1 else np.zeros(0, np.int64)
    offsets = np.append(total[begin], total[-1])
    if len(offsets) == 1:
        offsets = np.zeros(1, np.int64)
    text = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(out[inside].tobytes())).cast(pa.string())
    gone = np.concatenate([[0], np.cumsum(~kept)])
    return pa.array(gone[words.first[1:]] - gone[words.first[:-1]], pa.int64()), text


def remove_repeats(docs: DataFrame, *, window: int = 20, table_bits: int = 26) -> DataFrame:
    """Without the words that a window covers whose words also start earlier.

    Earlier: in a document of smaller doc_id, or before in the same one.
    Words are what white space (space, tab to carriage return) separates,
    unchanged.  docs has doc_id and text; other columns are ignored.  Returns
    a row for each row: doc_id, n_words, n_removed, kept (the words that stay,
    joined by one space).

    A null or empty text has no words; kept is then empty.  Texts shorter than
    the window lose nothing.  Rows without doc_id come after all others.  Rows
    of equal doc_id and text are one document, each with its result; those of
    equal doc_id and other text are ordered by the text's hash.

    window has to be even.  The table has 2**table_bits cells of two bits.
    """
    if window < 4 or window % 2:
        raise ValueError("window has to be even, and 4 or more")
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "substrings")
    source = docs.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    rows = docs.count()
    shared = spark.sparkContext.broadcast(_anchor_table(source.select("text"), window, table_bits, rows))
    parts = shards_for(rows, 2000)
    bits = (parts - 1).bit_length()
    dealt = source.select("doc", "text_hash", "text").mapInArrow(_deal_windows(window, table_bits, bits, shared), DEALT)
    first = dealt.groupBy("bucket").applyInPandas(_firsts(parts), DEALT)
    first = scratch.keep(first.groupBy("bucket").applyInPandas(_by_document, "doc long, text_hash long, firsts binary"), "firsts")
    joined = source.join(first, ["doc", "text_hash"], "left").select("doc_id", "text", "firsts")
    return joined.mapInArrow(_remove(window, table_bits, shared), "doc_id long, n_words long, n_removed long, kept string")
