"""Bounded samples of labelled rows, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WANTED = 1.0


def remainder(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo `modulus`: which fold a row is in.  Null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def training_rows(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, most: int, most_of_class: int) -> DataFrame:
    """(doc_id, text, y, natural) of at most most + 2 * most_of_class labelled doc_ids for which `allowed` holds, a row each.

    `natural` rows are the first `most` in an order by hash, whatever their
    label; the others fill each class up to its first most_of_class.  Of rows
    with several labels the largest counts, of documents that share a doc_id
    the smallest text; null labels are ignored.
    """
    some = labels.where(allowed & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    order = [F.xxhash64("doc_id", F.lit("sample")), F.col("doc_id")]
    parts = [some.orderBy(*order).limit(most).withColumn("natural", F.lit(True))]
    parts += [some.where(F.col("y") == y).orderBy(*order).limit(most_of_class).withColumn("natural", F.lit(False)) for y in (0, 1)]
    chosen = parts[0].union(parts[1]).union(parts[2]).groupBy("doc_id").agg(F.max("y").alias("y"), F.max("natural").alias("natural"))
    # bounded by the two parameters, so it is sent to where the texts are
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"), F.first("natural").alias("natural"))
