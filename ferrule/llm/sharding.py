"""Sharding by a hierarchical weighted hash tree.

A row descends from the root through regions and racks to a shard.  At every
level each child draws, from a hash of the row's key and the child's name, an
exponential variate divided by the child's weight; the smallest draw wins.  A
child's draw depends on nothing else, so a change of a child's weight moves
rows only to it or from it, and moves below it stay below it.

A shard that is added later opens a region of its own: no existing subtree's
weight changes, so it takes rows only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import Scratch, shards_for


@dataclass(frozen=True)
class Node:
    """A region, a rack or a shard.  A shard has a number and no children."""

    name: str
    weight: float = 1.0
    children: tuple[Node, ...] = field(default=())
    shard: int | None = None

    @property
    def total(self) -> float:
        return sum(c.total for c in self.children) if self.children else self.weight

    def leaves(self) -> list[Node]:
        return [x for c in self.children for x in c.leaves()] if self.children else [self]


def layout(shards: int, founded: int = 8, per_rack: int = 2, racks: int = 2) -> Node:
    """The tree of `shards` shards: the founded ones fill racks and regions, each later one opens a region.

    `founded` has to stay the same while shards are added.
    """

    def leaf(i: int) -> Node:
        return Node(f"shard-{i}", shard=i)

    first = min(shards, founded)
    filled = [Node(f"rack-{a // per_rack}", children=tuple(leaf(i) for i in range(a, min(a + per_rack, first)))) for a in range(0, first, per_rack)]
    regions = [Node(f"region-{a // racks}", children=tuple(filled[a : a + racks])) for a in range(0, len(filled), racks)]
    regions += [Node(f"region-of-{i}", children=(Node(f"rack-of-{i}", children=(leaf(i),)),)) for i in range(founded, shards)]
    return Node("root", children=tuple(regions))


def _draw(key: Column, node: Node) -> Column:
    """An exponential variate of the node's total weight; a uniform of 53 bits, never 0."""
    uniform = (F.shiftrightunsigned(F.xxhash64(key, F.lit(node.name)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(uniform) / F.lit(float(node.total))


def place(key: Column, tree: Node) -> Column:
    """The number of the shard that the key descends to."""
    if not tree.children:
        return F.lit(tree.shard)
    live = [c for c in tree.children if c.total > 0]
    if len(live) == 1:
        return place(key, live[0])
    draws = F.array(*[F.struct(_draw(key, c).alias("draw"), F.lit(i).alias("child")) for i, c in enumerate(live)])
    won = F.array_min(draws)["child"]
    out = place(key, live[-1])
    for i in range(len(live) - 2, -1, -1):
        out = F.when(won == i, place(key, live[i])).otherwise(out)
    return out


#: A column that tells equal rows apart.  It isn't the same when a task is repeated, so it has to be written before it is used.
TIE = "_tie"


def tied(rows: DataFrame) -> DataFrame:
    return rows.withColumn(TIE, F.monotonically_increasing_id())


def numbered(rows: DataFrame, by: list[str], order: list[str], parts: int = 256) -> DataFrame:
    """Adds `slot`: gapless numbers from 0 within each value of `by`.

    Rows are numbered within `parts` slices of each value, dealt by a hash of
    `order`, and slices are offset by the sizes of those before them, so no
    value's rows meet in one task, if `order` tells rows apart: TIE does.  rows
    is read twice; pass a written table.
    """
    rows = rows.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    sizes = rows.groupBy(*by, "_slice").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_slice").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    same = rows["_slice"] == sizes["_at"]
    for c in by:
        same &= rows[c].eqNullSafe(sizes[f"_by_{c}"])
    joined = rows.join(sizes, same)
    return joined.withColumn("slot", F.col("_base") + F.row_number().over(W.partitionBy(*by, "_slice").orderBy(*order)) - 1).drop("_slice", "_at", "_base", *[f"_by_{c}" for c in by])


def assign(docs: DataFrame, *, shards: int = 8, grown: int | None = None, tree: Node | None = None, slice_rows: int = 100_000) -> DataFrame:
    """Which shard each row is in, and its place there.

    docs has doc_id and text; other columns are ignored.  Returns a row for
    each row: doc_id, size (UTF-8 bytes of the text, none for null, plus 1),
    text_crc32 (of the text in UTF-8; of nothing for null), shard, slot
    (gapless from 0 in each shard), grown_shard (the shard with `grown` shards,
    by default one more).

    doc_id and the tree decide alone: equal doc_ids are in one shard, and rows
    without doc_id in that of the null key.  A tree of one's own sets weights;
    grown_shard is then that of layout(grown) only if it is given.
    """
    more = layout(shards + 1 if grown is None else grown) if tree is None or grown is not None else tree
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    placed = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        place(key, tree or layout(shards)).cast("int").alias("shard"),
        place(key, more).cast("int").alias("grown_shard"),
    )
    placed = Scratch(docs.sparkSession, "shards").keep(tied(placed), "placed")
    return numbered(placed, ["shard"], ["doc_id", "size", "text_crc32", TIE], shards_for(placed.count(), slice_rows, 32)).drop(TIE)
