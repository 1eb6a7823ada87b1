"""Benchmark decontamination: which words of a text lie in a window of a benchmark item.

A prefix-filtered containment join.  An item's windows are sets of overlapping
three-word shingles; a text contains a window only if it contains all of them,
so the necessary prefix is one shingle, the window's rarest over all texts.
Texts are probed with those shingles alone; each hit fixes where the window
would lie, which must be within the text (length bound) at the shingle's offset
(positional bound), and is then verified word for word over the window.

1. Windows are cut out of items on the executors.  How many texts have each of
   their shingles is counted in a table of fixed size, which orders shingles;
   a window with a shingle that no text has is left out.
2. Texts are probed through a bit table of the prefix shingles.  A hit goes on
   with the words around it, equal surroundings once, and meets the windows of
   its shingle in a join.
3. What is found goes back to texts by 128 bits of hashes.  Only texts whose
   cell of a bit table is set take part in that join, so others aren't shuffled.

The plan is the same at any size of the benchmark, of which nothing passes
through the driver; tables are of at most 2**30 bits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import U, Words, ascii_lower, buffers, mix, multiplier, pieces, plain_words
from .store import Scratch, ship, spread_join
from .tables import Bits, bit_table, bits_for, level_table

GRAM = 3
LEVEL_BITS = 22
SPANS = "array<struct<start:long,end:long>>"
ADDED = ["n_words", "spans", "items"]
TEXT = ["t0", "t1"]
PLACE = ["c0", "c1"]


def _words(buf: np.ndarray, offsets: np.ndarray) -> Words:
    return Words(buf, offsets, plain_words(), ascii_lower())


def _chunks(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    buf, offsets = buffers(column)
    for a, b in pieces(offsets):
        yield a, b, _words(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _grams(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word grams within one text, and where they begin."""
    n = len(words.h)
    if n < k:
        return np.zeros(0, U), np.zeros(0, np.int64)
    last = np.repeat(words.first[1:], words.counts)[: n - k + 1]
    at = np.flatnonzero(np.arange(n - k + 1) + k <= last)
    out = np.zeros(len(at), U)
    for j in range(k):
        out += words.h[at + j] * multiplier(j)
    return mix(out + U(k)), at


def _owner(words: Words, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(words.first, at, "right") - 1


def _cut(window: int):
    """(item_id, text) -> the item's windows as words joined by a space, and their lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b, words in _chunks(batch.column(1)):
                for d in range(b - a):
                    first, n = int(words.first[d]), int(words.counts[d])
                    keys = {words.text(first + i, first + min(i + window, n)).decode(): min(window, n) for i in range(max(n - window + 1, 1) if n else 0)}
                    yield pa.RecordBatch.from_arrays([pa.array([ids[a + d]] * len(keys), pa.string()), pa.array(list(keys), pa.string()), pa.array(list(keys.values()), pa.int32())], ["item", "key", "n"])

    return run


def _window_shingles(words: Words) -> tuple[np.ndarray, ...]:
    """All shingles of texts that are a window each: hash, offset, window, words of the shingle."""
    out = []
    for k in range(1, GRAM + 1):
        grams, at = _grams(words, k)
        own = _owner(words, at)
        some = np.minimum(words.counts[own], GRAM) == k
        out.append((grams[some], at[some] - words.first[own[some]], own[some], np.full(some.sum(), k)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _all_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, words in _chunks(batch.column(0)):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_window_shingles(words)[0]).view(np.int64))], ["shingle"])


def _frequencies(marked, bits: int, sizes: list[int]):
    """In how many texts the marked cells' shingles occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = Bits(marked.value, bits)
        for batch in batches:
            some = [np.zeros(0, np.int64)]
            for _, _, words in _chunks(batch.column(0)):
                for k in sizes:
                    grams, at = _grams(words, k)
                    hit = wanted(grams)
                    some.append(np.unique((_owner(words, at[hit]) << bits) + wanted.cells(grams[hit])) & ((1 << bits) - 1))
            cell, n = np.unique(np.concatenate(some), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(n, pa.int64())], ["cell", "n"])

    return run


def _prefixes(levels, bits: int):
    """Windows with their rarest shingle; those with a shingle that no text has are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(zlib.decompress(levels.value), np.uint8)
        for batch in batches:
            for a, b, words in _chunks(batch.column(0)):
                shingle, offset, own, size = _window_shingles(words)
                level = table[(shingle >> U(64 - bits)).astype(np.int64)]
                order = np.lexsort([offset, shingle, level, own])
                first = order[np.concatenate([[True], np.diff(own[order]) > 0])] if len(order) else order
                first = first[level[first] > 0]
                keys = batch.column(0).slice(a, b - a).take(pa.array(own[first]))
                columns = [pa.array(shingle[first].view(np.int64)), pa.array(offset[first], pa.int32()), pa.array(size[first], pa.int32()), pa.array(words.counts[own[first]], pa.int32()), keys]
                yield pa.RecordBatch.from_arrays(columns, ["shingle", "offset", "size", "n", "key"])

    return run


def _probe(prefixes, bits: int, sizes: list[int], window: int):
    """(t0, t1, text) -> where a prefix shingle may be, with the words around it that a window could cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = Bits(prefixes.value, bits)
        for batch in batches:
            for a, _, words in _chunks(batch.column(2)):
                for k in sizes:
                    grams, at = _grams(words, k)
                    hit = np.flatnonzero(wanted(grams))
                    at = at[hit]
                    own = _owner(words, at)
                    low, high = np.maximum(at - (window - k), words.first[own]), np.minimum(at + window, words.first[own + 1])
                    around = [words.text(x, y).decode() for x, y in zip(low.tolist(), high.tolist(), strict=True)]
                    rows = pa.array(a + own)
                    columns = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at - words.first[own], pa.int64()), pa.array(grams[hit].view(np.int64)), pa.array(np.full(len(at), k), pa.int32())]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(at - low, pa.int32()), pa.array(around, pa.string())], [*TEXT, "at", "shingle", "size", "lead", "around"])

    return run


def _merge(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [{"start": s, "end": e} for s, e in out]


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.names.index("spans")
        spans = pa.array([_merge([(s["start"], s["end"]) for s in row]) for row in batch.column(at).to_pylist()], batch.column(at).type)
        yield pa.RecordBatch.from_arrays([spans if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)


def _mark(prefixes, bits: int):
    """Adds n_words, and whether a text's cell is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Bits(prefixes.value, bits)
        for batch in batches:
            names = batch.schema.names
            counts = [words.counts for _, _, words in _chunks(batch.column(names.index("text")))]
            maybe = found(batch.column(names.index("_t0")).to_numpy().view(U))
            new = {"n_words": pa.array(np.concatenate(counts) if counts else [], pa.int64()), "_maybe": pa.array(maybe)}
            yield pa.RecordBatch.from_arrays([new.get(x, batch.column(i)) for i, x in enumerate(names)], names)

    return run


def _text_key(prefix: str = "") -> dict:
    return {f"{prefix}t0": F.xxhash64("text"), f"{prefix}t1": F.xxhash64(F.lit("second"), "text")}


def find_windows(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, window: int) -> DataFrame:
    """(t0, t1, spans, items) of each distinct text that has a window of an item."""
    spark = docs.sparkSession
    cut = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string"), "text")
    owned = scratch.keep(cut.mapInArrow(_cut(window), "item string, key string, n int").distinct(), "windows")
    windows = owned.select("key").distinct()
    about = owned.agg(F.count("*").alias("n"), F.collect_set(F.least("n", F.lit(GRAM))).alias("sizes")).first()
    sizes = sorted(about["sizes"])  # at most GRAM of them
    marked = spark.sparkContext.broadcast(bit_table(windows.mapInArrow(_all_shingles, "shingle long"), "shingle", LEVEL_BITS))
    counts = docs.select("text").mapInArrow(_frequencies(marked, LEVEL_BITS, sizes), "cell long, n long")
    levels = spark.sparkContext.broadcast(level_table(counts, LEVEL_BITS))
    index = scratch.keep(windows.mapInArrow(_prefixes(levels, LEVEL_BITS), "shingle long, offset int, size int, n int, key string"), "index")

    bits = bits_for(about["n"])
    prefixes = spark.sparkContext.broadcast(bit_table(index, "shingle", bits))
    probed = docs.select(*[c.alias(x) for x, c in _text_key().items()], "text").mapInArrow(_probe(prefixes, bits, sizes, window), "t0 long, t1 long, at long, shingle long, size int, lead int, around string")
    around = [F.col("shingle"), F.col("lead"), F.col("around")]
    hits = scratch.keep(probed.distinct().withColumns({"c0": F.xxhash64(*around), "c1": F.xxhash64(F.lit("second"), *around)}), "hits")
    places = scratch.keep(hits.select(*PLACE, "shingle", "size", "lead", "around").dropDuplicates(PLACE), "places")
    met = spread_join(places, index, ["shingle", "size"], PLACE).withColumn("around", F.split("around", " "))
    inside = (F.col("lead") >= F.col("offset")) & (F.col("lead") - F.col("offset") + F.col("n") <= F.size("around"))
    same = F.array_join(F.slice("around", F.greatest(F.col("lead") - F.col("offset") + 1, F.lit(1)), F.col("n")), " ") == F.col("key")
    verified = scratch.keep(met.where(inside & same).select(*PLACE, "offset", "n", "key"), "verified")

    cover = verified.groupBy(*PLACE).agg(F.collect_set(F.struct("offset", "n")).alias("covers"))  # a place has no more than `window` offsets
    spans = spread_join(hits.select(*TEXT, "at", *PLACE), cover, PLACE, [*TEXT, "at"]).select(*TEXT, "at", F.explode("covers").alias("c"))
    spans = spans.select(*TEXT, F.struct((F.col("at") - F.col("c.offset")).alias("start"), (F.col("at") - F.col("c.offset") + F.col("c.n")).alias("end")).alias("span")).distinct()
    spans = spans.groupBy(*TEXT).agg(F.collect_list("span").alias("spans")).mapInArrow(_merged, f"t0 long, t1 long, spans {SPANS}")
    named = verified.select(*PLACE, "key").join(owned.select("key", "item"), "key").select(*PLACE, "item").distinct()
    items = spread_join(hits.select(*TEXT, *PLACE), named, PLACE, TEXT).select(*TEXT, "item").distinct().groupBy(*TEXT).agg(F.array_sort(F.collect_list("item")).alias("items"))
    return scratch.keep(spans.join(items, TEXT), "found")


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = 10) -> DataFrame:
    """Where texts contain windows of `window` consecutive words of benchmark items.

    Words are runs of digits, letters and non-ASCII characters, after
    lower-casing A-Z.  An item of fewer words, but not none, is one window.
    docs has text, benchmark item_id and text.  Returns docs with n_words, spans
    (merged word ranges [start, end) that windows cover) and items (ids, as
    strings, sorted, of items with a window in the text; of an item that
    occurs under several rows once); columns of these names are replaced, all
    others pass.

    A null or empty text has no words, no spans and no items.  Items without
    id or text are ignored, and with an empty benchmark nothing is hit.
    Repeated rows are returned each.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "decontaminate")
    found = find_windows(docs, benchmark, scratch, window)
    for name in ("windows", "index", "hits", "places", "verified"):
        scratch.drop(name)
    bits = bits_for(found.count())
    cells = spark.sparkContext.broadcast(bit_table(found, "t0", bits))
    out = docs.drop(*ADDED)
    keyed = out.withColumns({"n_words": F.lit(0).cast("long"), "_maybe": F.lit(False), **_text_key("_")})
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema.fields)
    marked = keyed.mapInArrow(_mark(cells, bits), kind)
    names = [*out.columns, *ADDED]
    clean = marked.where("not _maybe").withColumns({"spans": F.array().cast(SPANS), "items": F.array().cast("array<string>")}).select(*names)
    some = scratch.keep(marked.where("_maybe").withColumn("_row", F.monotonically_increasing_id()), "maybe")
    spans = found.select(F.col("t0").alias("_t0"), F.col("t1").alias("_t1"), "spans", "items")
    hit = spread_join(some, spans, ["_t0", "_t1"], ["_row"], "left").withColumns({"spans": F.coalesce("spans", F.array().cast(SPANS)), "items": F.coalesce("items", F.array().cast("array<string>"))})
    return clean.union(hit.select(*names))


def digest(found: DataFrame) -> DataFrame:
    """Counts and a digest in place of text, spans and items."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated")
    )
