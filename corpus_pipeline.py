"""A training corpus in five stages: quality, exact copies, near copies, benchmark leaks, packing.

Null texts count as empty.  Rows without doc_id pass all stages like others;
of copies and near copies, a row with a doc_id is kept before one without.
Rows that share a doc_id are judged each by its own text.  Of rows that repeat
in doc_id and text, one stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm import decontaminate, exact_dedup, ngram_join, packing, quality
from ferrule.llm.labelled import remainder
from ferrule.llm.queries import TOKENIZER
from ferrule.llm.store import Scratch, documents, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), "quality", remainder(3) != 1)
    return quality.score(docs, model).where(quality.predicted() == 1).select(*docs.columns)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document of the largest doc_id."""
    return exact_dedup.drop_copies(docs, keep="largest")


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of near copies connect, that of the smallest doc_id; all without words."""
    return ngram_join.drop_near_copies(docs)


def no_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).where(F.size("spans") == 0).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 4096."""
    return packing.pack_documents(docs, TOKENIZER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("exact_dedup", distinct_texts),
    ("ngram_join", no_near_copies),
    ("decontaminate", no_leaks),
    ("packing", packed),
]

#: Classification, components and packing aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each reads what the one before has written, which is then dropped."""
    scratch, docs, before = Scratch(spark, "pipeline"), documents(spark, sf_dir), None
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
