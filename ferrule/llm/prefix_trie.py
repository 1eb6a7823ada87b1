"""A trie of conversation prefixes, built level by level.

Level by level, the live conversations are grouped by (node, next turn): each
group is a node of the next depth, named by its smallest conv_id.  Then the
levels are joined from the deepest to the root, and leaves and savings are
summed up.

Equal conversations are one row with a weight before the first level, and a
conversation that is left alone in its node is closed: what follows of it is a
chain without branches, which is written down at once.  So there are as many
levels as turns that different conversations share, not as many as the longest
one has, and a group of copies costs one row a level.

Turns are numbered in ranges of their order, so a conversation that holds a
large share of all turns is dealt to many tasks.  Each level reads its depth of
a table that is sorted by depth.  Lists of members are hashed as sorted pieces
of bounded size, one after another; none is held as a whole.  A turn is
identified by 128 bits of hashes of its role and text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import Scratch, ship, spread_join

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 10_000  # turns of a chain that are written down together
PIECE = 1 << 18  # bytes of a piece of a list of members
NONE = hashlib.sha256(b"").hexdigest()
SHARE = 20  # conversations that start with the same one


def _numbered(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, pos from 1, a, b, words): the turns of each conversation in order."""
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    own = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    dealt = own.repartitionByRange(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("part", F.spark_partition_id())
    here = F.row_number().over(W.partitionBy("part", "conv_id").orderBy(*order[1:]))
    hashed = [F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit("second"), "role", "text").alias("b"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")]
    ranges = scratch.keep(dealt.select("conv_id", "part", here.cast("long").alias("pos"), *hashed), "ranges")
    sizes = ranges.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    base = sizes.select("conv_id", "part", before.alias("base")).where("base > 0")  # of conversations that cross a range
    out = ranges.join(base, ["conv_id", "part"], "left").withColumn("pos", F.col("pos") + F.coalesce("base", F.lit(0)))
    return scratch.keep(out.select("conv_id", "pos", "a", "b", "words"), "numbered")


def _rebuilt(own: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth from 1, a, b, words) and conversations (conv_id, length) with their first turns taken from another."""
    first = F.col("conv_id") - F.col("conv_id") % SHARE
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    convs = own.groupBy("conv_id").agg(F.max("pos").alias("n"))
    heads = own.where("pos < 4").select(F.col("conv_id").alias("base"), "pos", "a", "b", "words")
    there = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = convs.select("conv_id", "n", first.alias("base"), taken.alias("h")).join(there, "base", "left")
    convs = convs.withColumn("head", F.least("h", F.coalesce("n_base", F.lit(0)))).withColumn("length", F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = scratch.keep(convs.select("conv_id", "base", "h", "head", "length"), "convs")
    lead = convs.join(heads, "base").where(F.col("pos") <= F.col("h")).select("conv_id", F.col("pos").alias("depth"), "a", "b", "words")
    rest = spread_join(own, convs, ["conv_id"], ["pos"]).where(F.col("pos") > F.col("h")).select("conv_id", (F.col("pos") - F.col("h") + F.col("head")).alias("depth"), "a", "b", "words")
    return scratch.keep(lead.union(rest), "rebuilt"), convs.select("conv_id", "length")


def _classes(turns: DataFrame, convs: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, length, class, weight): which conversations are equal; class is the smallest conv_id of them."""
    sums = turns.groupBy("conv_id").agg(F.bit_xor(F.xxhash64("depth", "a", "b")).alias("x"), F.bit_xor(F.xxhash64("b", "a", "depth")).alias("y"))
    signed = scratch.keep(convs.join(sums, "conv_id", "left").na.fill(0, ["x", "y"]), "signed")
    groups = signed.groupBy("length", "x", "y").agg(F.min("conv_id").alias("class"), F.count("*").alias("weight"))
    return scratch.keep(spread_join(signed, groups, ["length", "x", "y"], ["conv_id"]).select("conv_id", "length", "class", "weight"), "classes")


def _ends(members: DataFrame, scratch: Scratch) -> DataFrame:
    """(depth, node, conv_id) -> (depth, node, ends_sha256): the hash of each node's sorted, comma-joined list."""
    key = ["depth", "node"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows to pieces of lists: key, first id, text."""
        now, first, held, size, out = None, None, [], 0, []

        def close() -> None:
            nonlocal held, size
            if held:
                out.append((*now, first, ",".join(held).encode()))
            held, size = [], 0

        for batch in batches:
            for depth, node, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (depth, node) != now or size > PIECE:
                    close()
                    now, first = (depth, node), conv
                held.append(str(conv))
                size += len(held[-1]) + 1
            yield table(out)
            out = []
        close()
        yield table(out)

    def table(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["depth", "node", "first", "list"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted pieces to hashes."""
        now, sha = None, None
        for batch in batches:
            out = []
            for depth, node, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (depth, node) == now:
                    sha.update(b",")
                else:
                    out += [(*now, sha.hexdigest())] if now else []
                    now, sha = (depth, node), hashlib.sha256()
                sha.update(piece)
            yield hashes(out)
        yield hashes([(*now, sha.hexdigest())] if now else [])

    def hashes(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], [*key, "ends_sha256"])

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = members.select(*key, "conv_id").repartitionByRange(parts, *key, "conv_id").sortWithinPartitions(*key, "conv_id")
    pieces = scratch.keep(ordered.mapInArrow(pack, "depth long, node long, first long, list binary"), "pieces")
    dealt = pieces.repartition(parts, *key).sortWithinPartitions(*key, "first").select(*key, "list")
    return dealt.mapInArrow(digest, "depth long, node long, ends_sha256 string")


def _levels(turns: DataFrame, live: DataFrame, scratch: Scratch) -> tuple[list[DataFrame], list[DataFrame], list[DataFrame]]:
    """The shared nodes of each depth from 1, the classes that are alone from there on, and those that end in them.

    live has class, length, weight and node.  A shared node has conv_id,
    parent, n_convs and the words of its last turn.
    """
    nodes, closed, ended, depth = [], [], [], 0
    while not live.isEmpty():
        depth += 1
        step = turns.where(F.col("depth") == depth).select(F.col("conv_id").alias("class"), "a", "b", "words")
        ahead = scratch.keep(live.join(step, "class"), f"ahead-{depth}")
        groups = ahead.groupBy("node", "a", "b").agg(F.min("class").alias("child"), F.sum("weight").alias("n_convs"), F.count("*").alias("n"), F.max("words").alias("words"))
        groups = scratch.keep(groups.withColumn("shared", F.col("n") > 1), f"groups-{depth}")
        moved = spread_join(ahead, groups.select("node", "a", "b", "child", "shared"), ["node", "a", "b"], ["class"])
        moved = scratch.keep(moved.select("class", "length", "weight", "node", "child", "shared"), f"moved-{depth}")
        scratch.drop(f"ahead-{depth}")
        nodes.append(groups.where("shared").select(F.col("child").alias("conv_id"), F.col("node").alias("parent"), "n_convs", "words"))
        closed.append(moved.where(~F.col("shared")).select("class", "length", "weight", F.lit(depth).cast("long").alias("from"), F.col("node").alias("parent")))
        ended.append(moved.where(F.col("shared") & (F.col("length") == depth)).select("class", F.col("child").alias("node")))
        live = moved.where(F.col("shared") & (F.col("length") > depth)).select("class", "length", "weight", F.col("child").alias("node"))
    return nodes, closed, ended


def _chains(closed: DataFrame, turns: DataFrame, scratch: Scratch) -> DataFrame:
    """The nodes of closed classes, with what is saved there and below: closed's columns, depth, saved."""
    block = F.explode(F.sequence(F.floor(F.col("from") / BLOCK), F.floor(F.col("length") / BLOCK)))
    depth = F.explode(F.sequence(F.greatest("from", F.col("block") * BLOCK), F.least("length", F.col("block") * BLOCK + BLOCK - 1)))
    single = closed.where("weight = 1").withColumn("block", block).repartition("class", "block").withColumn("depth", depth)
    single = single.select(*closed.columns, "depth", F.lit(0).cast("long").alias("saved"))
    # copies save every turn but once: sums from the end, within blocks and over them
    many = closed.where("weight > 1")
    own = spread_join(turns.select(F.col("conv_id").alias("class"), "depth", "words"), many, ["class"], ["depth"]).where(F.col("depth") >= F.col("from"))
    own = scratch.keep(own.withColumn("block", F.floor(F.col("depth") / BLOCK)), "copied")
    after = F.sum("w").over(W.partitionBy("class").orderBy(F.col("block").desc()).rowsBetween(W.unboundedPreceding, -1))
    blocks = own.groupBy("class", "block").agg(F.sum("words").alias("w")).select("class", "block", F.coalesce(after, F.lit(0)).alias("after"))
    inner = F.sum("words").over(W.partitionBy("class", "block").orderBy(F.col("depth").desc()).rowsBetween(W.unboundedPreceding, 0))
    own = own.withColumn("inner", inner).join(blocks, ["class", "block"])
    return single.union(own.select(*closed.columns, "depth", (F.col("weight") - 1) * (F.col("inner") + F.col("after"))))


def _rolled(nodes: list[DataFrame], chains: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """The shared nodes of each depth from 0 with n_children, n_leaves and saved_tokens, level by level from the deepest."""
    tops = scratch.keep(chains.where(F.col("depth") == F.col("from")).select("depth", "parent", F.lit(1).cast("long").alias("n_leaves"), "saved"), "tops")
    out, below = [], None
    for depth in range(len(nodes) - 1, -1, -1):
        parts = tops.where(F.col("depth") == depth + 1).select("parent", "n_leaves", "saved")
        if below is not None:
            parts = parts.union(below.select("parent", "n_leaves", "saved_tokens"))
        sums = parts.groupBy(F.col("parent").alias("conv_id")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
        saved = (F.col("n_convs") - 1) * F.col("words") + F.coalesce("saved", F.lit(0))
        below = nodes[depth].join(sums, "conv_id", "left").select(
            "conv_id", F.lit(depth).cast("long").alias("depth"), "parent", "n_convs",
            F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), saved.alias("saved_tokens"),
        )  # fmt: skip
        below = scratch.keep(below, f"rolled-{depth}")
        out.append(below)
    return out


def build(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of rebuilt conversations.

    conversations has conv_id, turn, role and text; other columns are ignored.
    Turns are in order of turn (null first, then role and text); null roles and
    texts are empty.  Conversation c is rebuilt from the first h turns of
    conversation c - c % 20 (fewer if it has fewer) and c's own turns after its
    first h, with h = crc32(c in decimal) % 4.  Rows without conv_id are of no
    conversation and are left out; repeated rows are turns each; an empty table
    gives no nodes.

    Returns, all long but the hash: conv_id (the node's smallest member),
    depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves and
    saved_tokens of the subtree, ends_sha256 of the members that end there.
    """
    spark = conversations.sparkSession
    ship(spark)
    scratch = Scratch(spark, "trie")
    turns, convs = _rebuilt(_numbered(conversations, scratch), scratch)
    classes = _classes(turns, convs, scratch)
    # of equal conversations one goes on, in a table sorted by depth
    chosen = classes.select("conv_id", (F.col("conv_id") == F.col("class")).alias("chosen"))
    chosen = spread_join(turns, chosen, ["conv_id"], ["depth"]).where("chosen").select(*turns.columns)
    turns = scratch.keep(chosen.repartitionByRange("depth", "conv_id").sortWithinPartitions("depth"), "turns")
    first = classes.where("conv_id = class")
    top = first.agg(F.min("class").alias("conv_id"), F.lit(None).cast("long").alias("parent"), F.sum("weight").alias("n_convs"), F.lit(0).cast("long").alias("words"))
    top = scratch.keep(top.where("conv_id is not null"), "top")
    root = top.first()
    start = first.select("class", "length", "weight", F.lit(root.conv_id if root else 0).cast("long").alias("node"))
    nodes, closed, ended = _levels(turns, start.where("length > 0"), scratch)

    alone = start.where("false").select("class", "length", "weight", F.col("length").alias("from"), F.col("node").alias("parent"))
    for x in closed:
        alone = alone.union(x)
    alone = scratch.keep(alone, "alone")
    chains = scratch.keep(_chains(alone, turns, scratch), "chains")
    rolled = _rolled([top, *nodes], chains, scratch)

    # a class ends in a shared node, or its copies at the end of their chain
    place = start.where("length = 0").select("class", "node").union(alone.where("weight > 1").select("class", F.col("class").alias("node")))
    for x in ended:
        place = place.union(x)
    ends = spread_join(classes, scratch.keep(place, "places"), ["class"], ["conv_id"]).select(F.col("length").alias("depth"), "node", "conv_id")
    ends = scratch.keep(_ends(ends, scratch), "ends").withColumnRenamed("node", "conv_id")

    at_end = F.col("depth") == F.col("length")
    out = chains.select(
        F.col("class").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("from"), F.col("parent")).otherwise(F.col("class")).alias("parent_conv_id"), F.col("weight").alias("n_convs"),
        F.when(at_end, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.when(at_end & (F.col("weight") == 1), F.sha2(F.col("class").cast("string"), 256)).alias("own"),
    )  # fmt: skip
    for x in rolled:
        out = out.union(x.withColumn("own", F.lit(None).cast("string")))
    out = out.join(ends, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("own", "ends_sha256", F.lit(NONE)))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


SQL = r"""
with recursive turned as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos
  from conversations where conv_id is not null
),
own as materialized (select conv_id, list({'r': role, 't': text} order by pos) as turns from turned group by 1),
crc as materialized (
  -- a byte is xored in, then eight bits are shifted out
  select conv_id, turns, conv_id - conv_id % 20 as base, xor(4294967295, list_reduce(steps, lambda a, x: case when x >= 0 then xor(a, x) else xor(a // 2, 3988292384 * (a % 2)) end)) % 4 as h
  from (
    select conv_id, turns, list_prepend(4294967295, flatten(list_transform(string_split(cast(conv_id as varchar), ''), lambda c: list_prepend(cast(ord(c) as bigint), [cast(-1 as bigint) for i in range(8)])))) as steps from own
  )
),
full_turns as materialized (select c.conv_id, coalesce(b.turns, [])[1:c.h] || c.turns[c.h + 1:] as turns from crc c left join own b on c.base = b.conv_id),
step as materialized (
  select conv_id, d as depth, len(turns) as length, turns[1:d] as path, case when d > 0 then len(regexp_extract_all(turns[d].t, '[^ 	-]+')) else 0 end as words
  from (select conv_id, turns, unnest(range(len(turns) + 1)) as d from full_turns)
),
node as materialized (
  select depth, path, min(conv_id) as conv_id, count(*) as n_convs, max(words) as words,
    sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where length = depth), '')) as ends_sha256
  from step group by 1, 2
),
linked as materialized (select n.*, p.conv_id as parent_conv_id from node n left join node p on p.depth = n.depth - 1 and p.path = n.path[1:n.depth - 1]),
kids as (select depth - 1 as depth, parent_conv_id as conv_id, count(*) as n from linked where depth > 0 group by 1, 2),
told as materialized (select l.*, coalesce(k.n, 0) as n_children from linked l left join kids k on k.depth = l.depth and k.conv_id = l.conv_id),
up as (
  select depth as d, conv_id as c, depth, conv_id, parent_conv_id, cast(n_children = 0 as bigint) as leaf, (n_convs - 1) * words as saved from told
  union all select u.d, u.c, t.depth, t.conv_id, t.parent_conv_id, u.leaf, u.saved from up u join told t on t.depth = u.depth - 1 and t.conv_id = u.parent_conv_id
),
sums as (select depth, conv_id, sum(leaf) as n_leaves, sum(saved) as saved_tokens from up group by 1, 2)
select t.conv_id, t.depth, t.parent_conv_id, t.n_convs, t.n_children, cast(s.n_leaves as bigint) as n_leaves, cast(s.saved_tokens as bigint) as saved_tokens, t.ends_sha256
from told t join sums s on s.depth = t.depth and s.conv_id = t.conv_id
"""
