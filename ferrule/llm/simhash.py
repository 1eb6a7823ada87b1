"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint's bits are cut into segments, and the bits set in each are
counted.  The Manhattan distance of two such count vectors is a lower bound of
the fingerprints' Hamming distance, so all links lie within that radius.  The
vectors are points of a grid of unit cells; a point is entered in its own cell
and in those one step away, so two points within a distance of two meet in the
cell between them.  Fingerprints that meet are then compared bit by bit.

Equal texts are one fingerprint before anything is entered, so the grid has at
most 1 + 2 * segments rows for each distinct fingerprint.  Cells of two are
verified where they are counted.  Larger ones are opened in tasks, which give
the links of a spanning forest and never all pairs.  The fingerprints of a
cell that is too large to be opened are entered again with a segment a bit:
there a cell is a ball of radius one, and has 65 members at most.  So no task
ever holds more than `most` members of a cell, and work grows linearly with the
number of fingerprints, however dense they lie.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import Scratch, ship, spread_join

BITS, SEED, RADIUS = 64, 42, 2
PIECE = 1 << 20  # bytes of a text that are cut into words at a time
BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces that end between words."""
    start = 0
    while len(text) - start > PIECE:
        end = BLANK.search(text, start + PIECE)
        if end is None:
            break
        yield text[start : end.start()]
        start = end.start()
    yield text[start:]


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """The SimHash of a text in UTF-8 as a signed number of 64 bits; 0 without words."""
    ones, n, last = np.zeros(BITS, np.int64), 0, []

    def add(shingles, many: int) -> None:
        nonlocal n
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.dtype("<u8"), many)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[:] += bits.sum(axis=0, dtype=np.int64)
        n += many

    for piece in _pieces(text or b""):
        own = last + piece.lower().split()  # of bytes: A-Z only, and white space of ASCII only
        if len(own) >= words:
            add(map(b" ".join, zip(*(own[i:] for i in range(words)), strict=False)), len(own) - words + 1)
            own = own[len(own) - words + 1 :]
        last = own
    if n == 0 and last:
        add([b" ".join(last)], 1)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.array([fingerprint(x.as_py(), words) for x in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), own], ["doc_id", "fp"])

    return run


def _counts(fps: np.ndarray, segments: int) -> np.ndarray:
    bits = np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.reshape(len(fps), segments, BITS // segments).sum(axis=2, dtype=np.uint8)


def cells(fps: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell, fingerprint) of each fingerprint's own cell and of those one step away."""
    width = BITS // segments
    counts = _counts(fps, segments)
    steps = np.array([pow(width + 1, i, 1 << 64) for i in range(segments)], np.uint64)  # a cell's number: counts as digits
    home = (counts * steps).sum(axis=1, dtype=np.uint64)
    at, members = [home], [fps]
    for i in range(segments):
        up, down = counts[:, i] < width, counts[:, i] > 0
        at += [home[up] + steps[i], home[down] - steps[i]]
        members += [fps[up], fps[down]]
    return np.concatenate(at).view(np.int64), np.concatenate(members)


def _grid(fps: DataFrame, segments: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            for a in range(0, len(own), 4096):
                at, members = cells(own[a : a + 4096], segments)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(members)], ["cell", "fp"])

    return fps.select("fp").mapInArrow(run, "cell long, fp long")


def forest(members: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect all members which links of the distance connect."""
    out, left = [], members
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            one = todo.pop()
            near = np.bitwise_count((left ^ one).view(np.uint64)) <= distance
            found, left = left[near], left[~near]
            todo.extend(found)
            out.extend((int(one), int(x)) for x in found)
    return out


def _open(found: DataFrame, distance: int) -> DataFrame:
    """The members of cells -> (a, b), verified links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [x for members in batch.column(0) for x in forest(members.values.to_numpy(), distance)]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in own], pa.int64()), pa.array([b for _, b in own], pa.int64())], ["a", "b"])

    return found.groupBy("cell").agg(F.collect_list("fp").alias("members")).select("members").mapInArrow(run, "a long, b long")


def links(fps: DataFrame, scratch: Scratch, *, distance: int = RADIUS, segments: int = 16, most: int = 512) -> DataFrame:
    """(fp), distinct and written -> (a, b): verified links that connect what links of up to `distance` bits connect."""
    sizes = _grid(fps, segments).groupBy("cell").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
    sizes = scratch.keep(sizes.where("n > 1"), "sizes")
    pairs = sizes.where((F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)).select("a", "b")
    grid = _grid(fps, segments)
    opened = _open(grid.join(sizes.where(F.col("n").between(3, most)).select("cell"), "cell", "left_semi"), distance)
    dense = grid.join(sizes.where(F.col("n") > most).select("cell"), "cell", "left_semi").select("fp").distinct()
    finest = _open(_grid(scratch.keep(dense, "dense"), BITS), distance)  # cells are balls of radius one: 65 members at most
    return scratch.keep(pairs.union(opened).union(finest).distinct(), "links")


def near_copies(docs: DataFrame, *, words: int = 3, distance: int = RADIUS, segments: int = 16, most: int = 512) -> DataFrame:
    """Fingerprints of whole texts, and the components that links of up to `distance` differing bits form.

    docs has doc_id and text; other columns are ignored.  Returns a row for
    each row: doc_id, fingerprint (16 lower-case hex digits), component_id (the
    smallest doc_id that links reach, itself included).

    A fingerprint is taken of all word shingles of the text, repeats included,
    after lower-casing A-Z; a bit is 1 if set in over half their XXH64 hashes
    (seed 42).  A text of fewer words is one shingle.  Null, empty and blank
    texts have fingerprint zero and are linked like any other.  A row without
    doc_id counts in its component but can't name it; component_id is null
    where no row of a component has a doc_id.  Repeated rows are rows each.
    `distance` is 0, 1 or 2; `segments` divides 64, and changes the work only.
    """
    if distance not in range(RADIUS + 1) or BITS % segments:
        raise ValueError("distance is 0 to 2, and segments divides 64")
    ship(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "simhash")
    own = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    own = own.mapInArrow(_fingerprints(words), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")
    own = scratch.keep(own.withColumn("_row", F.monotonically_increasing_id()), "fingerprints")
    fps = scratch.keep(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    label = components(links(fps, scratch, distance=distance, segments=segments, most=most), scratch).withColumnRenamed("vertex", "fp")
    named = scratch.keep(fps.join(label, "fp", "left").withColumn("label", F.coalesce("label", "fp")), "labels")
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = scratch.keep(spread_join(named, least, ["label"], ["fp"]).select("fp", "component_id"), "components")
    out = spread_join(own, named, ["fp"], ["_row"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
