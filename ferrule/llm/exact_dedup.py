"""Exact dedup by a tree-merge of sorted digest runs, in DataFrame operations only.

Rows are dealt to 2**depth runs by doc_id and digest (`run_rows` rows a run,
about), so rows without doc_id don't meet in one.  A run holds a sorted entry for each digest: the identifier to keep and how many rows it stands for.  In binomial
rounds, runs that differ in `fan` bits of their number exchange entries: each
takes over those whose digest has its own bits there, merges what it receives
in digest order (Spark sorts what a run has received again, as it has no
operator that merges sorted ones) and keeps the best identifier of each digest.  After the last
round every run holds, complete, one range of the digests.  A round moves each
entry once, and copies shrink to an entry a run before the first exchange, so a
group of copies of any size costs a task one entry a run.

A digest is verified by two further hashes of the text and its length: entries
are merged only if all of these agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch, ascii_lower, shards_for, spread_join

VERIFIED = ["text_sha256", "n_bytes", "check"]


def _entries(docs: DataFrame) -> DataFrame:
    text = ascii_lower(F.coalesce("text", F.lit("")))
    return docs.select("doc_id", text.alias("text")).select(
        "doc_id", F.sha2("text", 256).alias("text_sha256"), F.octet_length("text").cast("long").alias("n_bytes"), F.xxhash64("text").alias("check")
    )


def _merge(runs: DataFrame, keep: str, rows) -> DataFrame:
    """One entry of each digest of a run.  The struct makes this a sort aggregate: sorted runs are merged."""
    known = F.col("keep_id").isNull() if keep == "smallest" else F.col("keep_id").isNotNull()
    best = (F.min if keep == "smallest" else F.max)(F.struct(known.alias("known"), "keep_id"))
    merged = runs.groupBy("run", *VERIFIED).agg(best.alias("best"), rows.alias("group_size"))
    return merged.select("run", *VERIFIED, F.col("best.keep_id").alias("keep_id"), "group_size")


def _round(runs: DataFrame, low: int, width: int, keep: str) -> DataFrame:
    """Runs exchange entries over bits low .. low+width-1 of their number."""
    mask = ((1 << width) - 1) << low
    digest = F.conv(F.substring("text_sha256", 1, 7), 16, 10).cast("int")
    target = F.col("run").bitwiseAND(F.lit(~mask)).bitwiseOR(digest.bitwiseAND(F.lit(mask))).cast("int")
    return _merge(runs.withColumn("run", target).repartition("run"), keep, F.sum("group_size"))


def exact_groups(docs: DataFrame, *, keep: str = "smallest", run_rows: int = 100_000, fan: int = 3) -> DataFrame:
    """Groups of texts that are equal after lower-casing A-Z, and which row of each stays.

    docs has doc_id and text; other columns are ignored.  Returns a row for
    each row: doc_id, keep_id (the smallest or largest doc_id of the group, by
    `keep`), group_size, kept (doc_id = keep_id), text_sha256.

    A null text counts as empty, so null and empty texts are one group.  A row
    without doc_id is counted in group_size, and stays only if no row of its
    group has one: keep_id is then null.  Rows of equal doc_id and text are all
    marked kept where theirs is the doc_id that stays.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    entries = scratch.keep(_entries(docs).withColumn("_row", F.monotonically_increasing_id()), "entries")
    depth = (shards_for(entries.count(), run_rows, 64) - 1).bit_length()
    runs = entries.select(F.pmod(F.xxhash64("doc_id", "text_sha256"), F.lit(1 << depth)).cast("int").alias("run"), *VERIFIED, F.col("doc_id").alias("keep_id"))
    runs = _merge(runs, keep, F.count("*"))
    for low in range(0, depth, fan):
        runs = _round(runs, low, min(fan, depth - low), keep)
    # the commonest text has a large share of the rows
    return spread_join(entries, runs.drop("run"), VERIFIED, ["doc_id", "_row"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, *, keep: str = "smallest", run_rows: int = 100_000, fan: int = 3) -> DataFrame:
    """One row of each group: docs without the rows that exact_groups doesn't keep.

    Its columns are unchanged.  Of repeated rows of the doc_id that stays, the
    first that is met stays.
    """
    groups = exact_groups(docs, keep=keep, run_rows=run_rows, fan=fan).where("kept")
    marks = groups.select(_id("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    text = ascii_lower(F.coalesce("text", F.lit("")))
    keyed = docs.withColumns({"_id": _id("doc_id"), "_sha": F.sha2(text, 256)})
    # rows are dealt by doc_id and digest together, so copies don't meet in one task
    return keyed.join(marks, ["_id", "_sha"], "left_semi").dropDuplicates(["_id", "_sha"]).select(*docs.columns)


def _id(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit("none"))
