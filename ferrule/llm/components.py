"""Connected components of an edge table, by alternating stars.

Each round hangs every vertex's larger neighbours on its smallest one
(large star), then its smaller neighbours (small star); a forest of stars is
left after a number of rounds that grows with the logarithm of the longest
path.  Only two-column tables are shuffled, and each round is written to the
shared folder, so neither edges nor components reach the driver.  Vertices may
be of any type with an order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch, spread_join


def _star(edges: DataFrame, large: bool, scratch: Scratch, name: str) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    # the centre of a large star has a large share of the rows
    joined = spread_join(both, least, ["a"], ["b"])
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return scratch.keep(out.where("a <> b").distinct(), name)


def _settled(edges: DataFrame) -> bool:
    """Whether all edges are rays of stars: each vertex hangs on one centre, and no centre hangs on another."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("v").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where("hangs > 1 or (hangs = 1 and holds = 1)").isEmpty()


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 64) -> DataFrame:
    """(a, b) links between vertices -> (vertex, label): label is the component's smallest vertex.

    Vertices without a link are absent.  An empty table gives an empty one.
    """
    now = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges-0")
    for k in range(most_rounds + 1):
        if _settled(now):
            break
        if k == most_rounds:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
        large = _star(now, True, scratch, f"large-{k}")
        now = _star(large, False, scratch, f"edges-{k + 1}")
        scratch.drop(f"large-{k}")
        scratch.drop(f"edges-{k}")
    return now.select(F.col("a").alias("vertex"), F.col("b").alias("label")).union(now.select(F.col("b").alias("vertex"), F.col("b").alias("label"))).distinct()
