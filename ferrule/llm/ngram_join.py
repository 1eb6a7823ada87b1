"""N-gram Jaccard self-join with a token-group matrix.

Sets are the distinct word shingles of whole texts.  Similar sets are
partitioned into groups of bounded size and of one class of sizes; each group
stores the union of all its members' tokens, once.  The matrix (token ->
groups) is kept sparse: only a set's necessary prefix, in a global order from
rare to common, is entered, since a partner must share at least one of those
tokens.  Groups that meet in the matrix are bounded twice before any member is
fetched for comparison: the overlap of the two unions has to reach what the
smallest members need, and then that of a query set with the other group's
union has to reach what this set needs.  Only for sets that pass is the other
group opened, and its members compared exactly.

A token's groups are dealt into tiles of bounded size and pairs of tiles are
what tasks work on, so no row, list or task holds all groups of a token.
Tokens that lead to the same groups are looked up once.

Rarity comes from counts over all texts.  They are folded into a table of
fixed size (a level for each of 2**table_bits cells of the token space), the
only thing that is broadcast but for lists of hot keys of at most 1,000 rows.
Any table gives right results: it only orders tokens.  A token that is alone
in its cell and text is known to be unshared; a set with more such tokens than
its prefix is long can have no partner.  As data grow the cells fill and less
is pruned, but memory stays as it is.

A set is identified by two sums of 64 bits over its tokens.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .kernel import U, Words, ascii_lower, buffers, from_blob, pieces, shingle_sets, signatures, space_words
from .store import Scratch, shards_for, ship, small_batches, spread_join

FLUSH = 1 << 22  # tokens that a counting task holds before it deals them out
SEEN = 1 << 18  # sets that a task remembers, not to hand their tokens on again
TILE = 64  # groups of a token that are dealt out together
MEMBERS = "array<struct<v:binary,copies:long,tokens:binary>>"


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    buf, offsets = buffers(batch.column(1))
    table, lower = space_words(), ascii_lower()
    for a, b in pieces(offsets):
        words = Words(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], table, lower)
        yield a, b, *shingle_sets(words, k)


def packed(x: np.ndarray) -> bytes:
    """Numbers of 32 bits in ascending order, as steps byte by byte: of high bytes, which are mostly alike, little is left."""
    steps = np.diff(x, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4)
    coder = zlib.compressobj(1, zlib.DEFLATED, -15, 9, zlib.Z_HUFFMAN_ONLY)
    return coder.compress(np.ascontiguousarray(steps.T).tobytes()) + coder.flush()


def unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(bytes(blob), -15), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4")[:, 0], dtype=np.uint32)


def _count_tokens(k: int, bits: int):
    """Tokens of the texts, dealt by their leading bits: 32 further bits of each, and how often those repeat."""

    def deal(held: list[np.ndarray]) -> pa.RecordBatch:
        tokens = np.concatenate(held)
        tokens.sort()
        short = tokens >> U(32 - bits)
        first = np.flatnonzero(np.concatenate([[True], short[1:] != short[:-1]]))
        times = np.diff(np.append(first, len(short)))
        short = short[first]
        bucket = (short >> U(32)).astype(np.int64)
        rest = short.astype(np.uint32)
        cuts = np.searchsorted(bucket, np.arange((1 << bits) + 1))
        rows = [(i, rest[a:b], times[a:b]) for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if b > a]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([i for i, _, _ in rows], pa.int32()),
                pa.array([packed(r) for _, r, _ in rows], pa.binary()),
                pa.array([packed(r[t > 1]) for _, r, t in rows], pa.binary()),
                pa.array([(t[t > 1] - 1).astype(np.uint32).tobytes() for _, _, t in rows], pa.binary()),
            ],
            ["bucket", "rest", "again", "more"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()
        for batch in batches:
            for a, b, tokens, first in _sets(batch, k):
                for d, s in enumerate(zip(*(x.tolist() for x in signatures(tokens, first)), strict=True)):
                    if first[d + 1] > first[d] and s not in seen:
                        seen.add(s)
                        held.append(tokens[first[d] : first[d + 1]])
                        size += len(held[-1])
                if size >= FLUSH:
                    yield deal(held)
                    held, size, seen = [], 0, set()
        if size:
            yield deal(held)

    return run


def _levels(bits: int, table_bits: int):
    """Counts of a bucket's tokens -> its slice of the table: log2 of the largest count in each cell, 0 for counts of one."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        once = np.concatenate([unpacked(x) for x in pdf["rest"]])
        rest = np.concatenate([once, *[unpacked(x) for x in pdf["again"]]])
        weight = np.concatenate([np.ones(len(once), np.int64), *[from_blob(x, np.uint32).astype(np.int64) for x in pdf["more"]]])
        order = np.argsort(rest, kind="stable")
        rest, weight = rest[order], weight[order]
        first = np.flatnonzero(np.concatenate([[True], rest[1:] != rest[:-1]]))
        count = np.add.reduceat(weight, first)
        cell = (rest[first] >> np.uint32(32 - (table_bits - bits))).astype(np.int64)
        many = count > 1
        out = np.zeros(1 << (table_bits - bits), np.uint8)
        np.maximum.at(out, cell[many], np.log2(count[many]).astype(np.uint8))
        return pd.DataFrame({"bucket": [int(pdf["bucket"].iloc[0])], "cells": [zlib.compress(out.tobytes(), 1)]})

    return run


def rarity_table(docs: DataFrame, k: int, table_bits: int, rows: int) -> bytes:
    """Levels of 2**table_bits cells, compressed.  Its size doesn't depend on the data."""
    bits = min(max(4, (shards_for(rows, 2000) - 1).bit_length()), table_bits - 4)
    counted = docs.mapInArrow(_count_tokens(k, bits), "bucket int, rest binary, again binary, more binary")
    with small_batches(docs.sparkSession):
        slices = counted.groupBy("bucket").applyInPandas(_levels(bits, table_bits), "bucket int, cells binary").collect()
    table = np.zeros((1 << bits, 1 << (table_bits - bits)), np.uint8)
    for row in slices:
        table[row["bucket"]] = np.frombuffer(zlib.decompress(bytes(row["cells"])), np.uint8)
    return zlib.compress(table.tobytes(), 1)


def size_classes(n: np.ndarray, percent: int) -> np.ndarray:
    """Classes of set sizes such that linked sets are in one class or in neighbouring ones."""
    # a little wider than the greatest ratio of linked sets, so that rounding can't part them
    return np.floor(np.log(np.maximum(n, 1)) / (np.log(100 / percent) + 1e-4)).astype(np.int32)


def _prefixes(k: int, percent: int, table_bits: int, shared):
    """Each text's set size and identity; the prefix, group key, size class and tokens of those that may have a partner.

    Of equal sets that a task meets one after another, the first has these, the others not.  Columns after the text pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, done = np.frombuffer(zlib.decompress(shared.value), np.uint8), set()
        for batch in batches:
            for a, b, tokens, first in _sets(batch, k):
                n = np.diff(first)
                one, two = signatures(tokens, first)
                names = np.stack([one, two], axis=1).tobytes()
                v = [names[16 * d : 16 * d + 16] if n[d] else None for d in range(b - a)]
                level = table[(tokens >> U(64 - table_bits)).astype(np.int64)]
                alone = np.concatenate([[0], np.cumsum(level == 0)])
                alone = alone[first[1:]] - alone[first[:-1]]
                length = n - (-(-percent * n // 100)) + 1
                prefix, key, sets = [None] * (b - a), [None] * (b - a), [None] * (b - a)
                if len(done) > SEEN:
                    done = set()
                for d in np.flatnonzero((n > 0) & (alone < length)).tolist():
                    if v[d] in done:
                        continue
                    done.add(v[d])
                    own, lv = tokens[first[d] : first[d + 1]], level[first[d] : first[d + 1]]
                    order = np.argsort(lv, kind="stable")  # tokens are sorted, so ties stay in token order
                    prefix[d] = own[order[alone[d] : length[d]]].view(np.int64)
                    key[d] = int(own[lv > 0][0].view(np.int64))
                    sets[d] = own.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        *[batch.column(i).slice(a, b - a) for i in range(2, batch.num_columns)],
                        pa.array(n, pa.int64()),
                        pa.array(v, pa.binary()),
                        pa.array(prefix, pa.list_(pa.int64())),
                        pa.array(key, pa.int64()),
                        pa.array(size_classes(n, percent)),
                        pa.array(sets, pa.binary()),
                    ],
                    [*[x for x in batch.schema.names if x != "text"], "n", "v", "prefix", "key", "class", "tokens"],
                )

    return run


def _unions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the union of its members' tokens to each group."""
    for batch in batches:
        at = batch.schema.names.index("members")
        unions = []
        for i in range(batch.num_rows):
            tokens = [from_blob(x) for x in batch.column(at)[i].values.field("tokens").to_pylist()]
            unions.append(np.unique(np.concatenate(tokens)).view(np.int64))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(unions, pa.list_(pa.int64()))], [*batch.schema.names, "tokens"])


def _qualifies(tokens: np.ndarray, first: np.ndarray, union: np.ndarray, percent: int, least: int = 0) -> np.ndarray:
    """Of which sets the overlap with a group's union reaches what a partner of at least `least` tokens needs."""
    at = np.searchsorted(union, tokens)
    at[at == len(union)] = 0
    hit = np.concatenate([[0], np.cumsum(union[at] == tokens)])
    hit, n = hit[first[1:]] - hit[first[:-1]], np.diff(first)
    return (100 * hit >= percent * n) & ((100 + percent) * hit >= percent * (n + least))


def _compare(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each query set with the positions of all sets that it is linked with, right's after left's; within one group, itself included."""
    sets = left + (right or [])
    sizes = np.array([len(x) for x in sets])
    first = np.concatenate([[0], np.cumsum(sizes)])
    tokens = np.concatenate(sets)
    cut = len(left) if right is not None else 0
    mine, theirs = (np.arange(cut), np.arange(cut, len(sets))) if right is not None else (np.arange(len(sets)),) * 2
    if right is not None:
        base = first[cut]
        mine = mine[_qualifies(tokens[:base], first[: cut + 1], np.unique(tokens[base:]), percent)]
        theirs = theirs[_qualifies(tokens[base:], first[cut:] - base, np.unique(tokens[:base]), percent)]
    if not len(mine) or not len(theirs):
        return
    # the opened sets, over the tokens of the queries
    opened = np.concatenate([tokens[first[t] : first[t + 1]] for t in theirs.tolist()])
    begin = np.concatenate([[0], np.cumsum(sizes[theirs])])[:-1]
    names = np.unique(np.concatenate([tokens[first[m] : first[m + 1]] for m in mine.tolist()]))
    at = np.searchsorted(names, opened)
    at[at == len(names)] = 0
    at = np.where(names[at] == opened, at, len(names))
    mark = np.zeros(len(names) + 1, np.int32)
    for m in mine.tolist():
        own = np.searchsorted(names, tokens[first[m] : first[m + 1]])
        mark[own] = 1
        common = np.add.reduceat(mark[at], begin)
        mark[own] = 0
        yield m, theirs[100 * common >= percent * (sizes[m] + sizes[theirs] - common)]


class _Forest:
    """Union-find over positions; join() says whether its ends were apart."""

    def __init__(self, n: int):
        self.root = list(range(n))

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.root[x] = y
        return x != y


def links_between(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int, every: bool = False) -> list[tuple[int, int]]:
    """A spanning forest of the links between two groups (or within one), or every link once: pairs of positions, right's after left's."""
    forest = _Forest(len(left) + len(right or []))
    return [(m, t) for m, linked in _compare(left, right, percent) for t in linked.tolist() if (m < t if every else m != t and forest.join(m, t))]


def _parts(got: pa.Scalar) -> tuple[list[bytes], np.ndarray, list[np.ndarray]]:
    members = got.values
    return members.field("v").to_pylist(), members.field("copies").to_numpy(zero_copy_only=False), [from_blob(x) for x in members.field("tokens").to_pylist()]


def _bound(percent: int):
    """Rows of a group's union and another group's members -> the members that may have a partner in the first, if any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, queries = [], []
            for i in range(batch.num_rows):
                union = batch.column(1)[i].values.to_numpy(zero_copy_only=False).view(U)
                v, copies, sets = _parts(batch.column(3)[i])
                first = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
                passed = np.flatnonzero(_qualifies(np.concatenate(sets), first, union, percent, batch.column(2)[i].as_py())).tolist()
                if passed:
                    groups.append(batch.column(0)[i].as_py())
                    queries.append([{"v": v[d], "copies": int(copies[d]), "tokens": sets[d].tobytes()} for d in passed])
            kind = pa.list_(pa.struct([("v", pa.binary()), ("copies", pa.int64()), ("tokens", pa.binary())]))
            yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array(queries, kind)], ["g", "queries"])

    return run


def _open(percent: int, every: bool):
    """Opens groups: (members) for links within, (queries, members) for links with qualifying sets of another group.

    Returns links (a, b), a spanning forest of each opened pair or every one,
    and rows (a, null, n): that set a is linked with sets of n documents there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[bytes, bytes | None, int | None]] = []
            for i in range(batch.num_rows):
                v, copies, left = _parts(batch.column(0)[i])
                right = None
                if batch.num_columns > 1:
                    more, weights, right = _parts(batch.column(1)[i])
                    v, copies = v + more, np.concatenate([copies, weights])
                forest, count = _Forest(len(v)), np.zeros(len(v), np.int64)
                for m, linked in _compare(left, right, percent):
                    linked = linked[linked != m]
                    count[m] += copies[linked].sum()
                    if right is not None:
                        count[linked] += copies[m]
                    found += [(v[m], v[t], None) for t in linked.tolist() if ((right is not None or m < t) if every else forest.join(m, t))]
                found += [(v[d], None, int(count[d])) for d in np.flatnonzero(count).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.binary()), pa.array([x[2] for x in found], pa.int64())], ["a", "b", "n"])

    return run


def _meetings(found: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs g1 < g2 of groups of near sizes that a token of the matrix leads to, once each."""
    matrix = scratch.keep(found.select("g", "class", F.explode("prefix").alias("token")).distinct(), "matrix")
    cells = matrix.groupBy("token", "class").agg(F.count("*").alias("n"), *[F.bit_xor(F.xxhash64(F.lit(x), "g")).alias(x) for x in ("x", "y")])
    # one of the tokens that lead to the same groups is enough; a token has few classes
    tiles = F.collect_list(F.struct("class", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))).alias("tiles")
    columns = cells.groupBy("token").agg(F.sum("n").alias("n"), *[F.bit_xor(F.xxhash64(F.lit(x), "class", x)).alias(x) for x in ("x", "y")], tiles).where("n > 1")
    columns = columns.groupBy("n", "x", "y").agg(F.min(F.struct("token", "tiles")).alias("one")).select("one.token", F.map_from_entries("one.tiles").alias("tiles"))
    placed = spread_join(matrix, columns, ["token"], ["g"]).select("token", "class", "g", *[F.coalesce(F.element_at("tiles", F.col("class") + i), F.lit(0)).alias(name) for i, name in ((-1, "below"), (0, "same"), (1, "above"))])
    placed = placed.withColumn("tile", F.pmod(F.xxhash64(F.lit("tile"), "g"), "same").cast("int"))

    def upto(n: str):
        return F.sequence(F.lit(0), F.col(n) - 1)

    def cell(base, across: bool, one, two, side):
        return F.struct(base.alias("base"), F.lit(across).alias("across"), one.alias("one"), two.alias("two"), side.alias("side"))

    own, none = F.col("class"), F.array()
    within = F.transform(upto("same"), lambda j: cell(own, False, F.least("tile", j), F.greatest("tile", j), F.when(F.col("tile") <= j, 0).otherwise(1)))
    lower = F.when(F.col("below") > 0, F.transform(upto("below"), lambda j: cell(own - 1, True, j, F.col("tile"), F.lit(1)))).otherwise(none)
    upper = F.when(F.col("above") > 0, F.transform(upto("above"), lambda j: cell(own, True, F.col("tile"), j, F.lit(0)))).otherwise(none)
    dealt = placed.select("token", "g", F.explode(F.concat(within, lower, upper)).alias("cell")).select("token", "g", "cell.*")
    sides = [F.collect_list(F.when(F.col("side") == i, F.col("g"))).alias(f"side{i}") for i in (0, 1)]
    met = dealt.groupBy("token", "base", "across", "one", "two").agg(*sides).withColumn("alone", ~F.col("across") & (F.col("one") == F.col("two")))
    met = met.where("size(side0) > 1 or size(side1) > 0").withColumn("g1", F.explode("side0")).select("alone", "g1", F.explode(F.when(F.col("alone"), F.col("side0")).otherwise(F.col("side1"))).alias("g2"))
    return met.where("not alone or g1 < g2").select(F.least("g1", "g2").alias("g1"), F.greatest("g1", "g2").alias("g2")).distinct()


def _links(docs: DataFrame, scratch: Scratch, every: bool, words: int, percent: int, table_bits: int, group_members: int, group_tokens: int) -> tuple[DataFrame, DataFrame]:
    """Each row's set; links between sets (enough of them to connect what is linked, or every one) and their numbers, as _open() gives them."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("t0"), F.xxhash64(F.lit("second"), "text").alias("t1"))
    shared = spark.sparkContext.broadcast(rarity_table(docs.select("doc_id", "text"), words, table_bits, docs.count()))
    kept = docs.mapInArrow(_prefixes(words, percent, table_bits, shared), "doc_id long, t0 long, t1 long, n long, v binary, prefix array<long>, key long, class int, tokens binary")
    kept = scratch.keep(kept, "sets")

    # groups: sets of one class with the same smallest shared token, split to a bounded size by their own hash
    light = kept.where("v is not null").groupBy("v").agg(F.count("*").alias("copies"), F.max("n").alias("n"), F.max("key").alias("key"), F.max("class").alias("class"))
    light = scratch.keep(light.where("key is not null"), "candidates")
    # only groups that are split have a row here, so tokens stay where they are until they meet in their group
    width = light.groupBy("key", "class").agg(F.greatest(F.ceil(F.count("*") / group_members), F.ceil(F.sum("n") / group_tokens)).alias("parts"))
    width = scratch.keep(width.where("parts > 1"), "width")

    def grouped(sets: DataFrame) -> DataFrame:
        return sets.join(width, ["key", "class"], "left").withColumn("g", F.xxhash64("key", "class", F.pmod(F.xxhash64("v"), F.coalesce("parts", F.lit(1)))))

    found = grouped(kept.where("tokens is not null"))
    none = F.lit(None).cast("binary").alias("tokens")
    member = found.select("g", "v", F.lit(0).cast("long").alias("copies"), "n", "tokens").union(grouped(light).select("g", "v", "copies", "n", none))
    pairs = scratch.keep(_meetings(found, scratch), "pairs")
    scratch.drop("matrix")
    # a group that meets no other, or has no second member, is never opened: it isn't written, nor dealt out below
    side = lambda i: pairs.select(F.col(f"g{i}").alias("g"), F.lit(i == 1).alias("first"), F.lit(i == 2).alias("second"))
    met = side(1).union(side(2)).groupBy("g").agg(F.max("first").alias("first"), F.max("second").alias("second"))
    member = member.repartition("g").groupBy("g", "v").agg(F.sum("copies").alias("copies"), F.max("n").alias("n"), F.max("tokens").alias("tokens")).join(met, "g", "left")
    group = member.groupBy("g").agg(F.min("n").alias("least"), F.max("first").alias("first"), F.max("second").alias("second"), F.collect_list(F.struct("v", "copies", "tokens")).alias("members"))
    group = group.where(F.col("first").isNotNull() | (F.size("members") > 1))
    group = scratch.keep(group.mapInArrow(_unions, f"g long, least long, first boolean, second boolean, members {MEMBERS}, tokens array<long>"), "groups")
    kept = scratch.keep(kept.select("doc_id", "t0", "t1", "n", "v"), "rows")
    for name in ("sets", "candidates", "width"):
        scratch.drop(name)

    sides = ((1, "first", []), (2, "second", ["members"]))
    one, two = (group.where(side).select(F.col("g").alias(f"g{i}"), F.col("least").alias(f"least{i}"), F.col("tokens").alias(f"tokens{i}"), *extra) for i, side, extra in sides)
    common = F.size(F.array_intersect("tokens1", "tokens2"))
    enough = (100 * common >= percent * F.greatest("least1", "least2")) & ((100 + percent) * common >= percent * (F.col("least1") + F.col("least2")))
    bounded = pairs.join(one, "g1").join(two, "g2").where(enough).select("g1", "tokens1", "least1", "members")
    queries = scratch.keep(bounded.mapInArrow(_bound(percent), f"g long, queries {MEMBERS}"), "queries")
    opened = queries.join(group.where("first").select("g", "members"), "g").select("queries", "members")
    links, within = "a binary, b binary, n long", group.where(F.size("members") > 1).select("members")
    edges = scratch.keep(opened.mapInArrow(_open(percent, every), links).union(within.mapInArrow(_open(percent, every), links)), "links")
    for name in ("groups", "pairs", "queries"):
        scratch.drop(name)
    return kept, edges


def _linked(docs: DataFrame, scratch: Scratch, words: int, percent: int, table_bits: int, group_members: int, group_tokens: int) -> DataFrame:
    """Each row's doc_id, hashes of its text, set, and of each set its component's label, smallest doc_id and number of linked rows."""
    kept, edges = _links(docs, scratch, False, words, percent, table_bits, group_members, group_tokens)
    label = components(edges.where("b is not null").select("a", "b"), scratch)
    count = edges.where("b is null").groupBy("a").agg(F.sum("n").alias("links")).withColumnRenamed("a", "v")
    named = kept.where("v is not null").groupBy("v").agg(F.min("doc_id").alias("own"), F.count("*").alias("copies"))
    named = named.join(label, named["v"] == label["vertex"], "left").join(count, "v", "left")
    named = scratch.keep(named.select("v", "own", F.coalesce("label", "v").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "named")
    least = named.groupBy("label").agg(F.min("own").alias("component_id"))
    reached = scratch.keep(spread_join(named, least, ["label"], ["v"]), "reached")
    scratch.drop("named")
    return spread_join(kept, reached.drop("own"), ["v"], ["doc_id", "t0"], "left")


def ngram_jaccard_components(
    docs: DataFrame, *, words: int = 5, percent: int = 80, table_bits: int = 24, group_members: int = 128, group_tokens: int = 1 << 16
) -> DataFrame:
    """Which texts are linked, directly or through others, by shingle sets of a Jaccard similarity of percent/100 or more.

    docs has doc_id and text; other columns are ignored.  Returns a row for
    each row: doc_id, n_shingles, component_id (the smallest doc_id that links
    reach), n_links (how many other rows it is linked with directly, copies
    included), set_id (equal for equal sets; null for an empty one).

    A null or empty text, or one of white space, has no shingles and is linked
    with nothing.  A text of fewer words than a shingle has is one shingle.  A
    row without doc_id keeps its n_shingles; where all rows of its component
    lack one, component_id is null.  Repeated rows are returned each.

    group_members and group_tokens bound a group, and so what a task that
    opens two of them holds (one text's own set may exceed group_tokens).
    """
    linked = _linked(docs, Scratch(docs.sparkSession, "ngram-join"), words, percent, table_bits, group_members, group_tokens)
    alone = F.col("v").isNull()
    return linked.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("v").alias("set_id")
    )


def drop_near_copies(docs: DataFrame, *, words: int = 5, percent: int = 80, table_bits: int = 24, group_members: int = 128, group_tokens: int = 1 << 16) -> DataFrame:
    """One row of each component of linked texts: the one of the smallest doc_id, and of its texts the one of the smallest hash.

    Columns are unchanged.  Rows without doc_id come after all others; where
    doc_ids repeat, their texts count separately.  Of rows that are equal in
    doc_id and text, and have shingles, one stays.  Rows without shingles are
    linked with nothing and all stay.
    """
    linked = _linked(docs, Scratch(docs.sparkSession, "near-copies"), words, percent, table_bits, group_members, group_tokens)
    row = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "t0", "t1")
    stays = linked.where("v is not null").groupBy("label").agg(F.min(row).alias("row")).select("row.*")
    keyed = docs.withColumns({"_id": F.coalesce("doc_id", F.lit(0)), "unknown_": F.col("doc_id").isNull(), "_t0": F.xxhash64("text"), "_t1": F.xxhash64(F.lit("second"), "text"), "_words": F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")})
    stays = stays.select(F.col("unknown").alias("unknown_"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("t0").alias("_t0"), F.col("t1").alias("_t1"))
    ids = ["unknown_", "_id", "_t0", "_t1"]
    chosen = keyed.where("_words").join(stays, ids, "left_semi").dropDuplicates(ids)
    return chosen.select(*docs.columns).union(keyed.where("not _words").select(*docs.columns))


def ngram_jaccard_links(
    docs: DataFrame, *, words: int = 5, percent: int = 80, table_bits: int = 24, group_members: int = 128, group_tokens: int = 1 << 16
) -> DataFrame:
    """Every pair of different shingle sets of a Jaccard similarity of percent/100 or more, once: a < b.

    Arguments as for ngram_jaccard_components(), whose set_id tells a text's
    set; texts with equal sets are linked too, but aren't pairs here.  A family
    of n different near copies has up to n * (n - 1) / 2 rows.
    """
    _, edges = _links(docs, Scratch(docs.sparkSession, "ngram-links"), True, words, percent, table_bits, group_members, group_tokens)
    return edges.where("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
