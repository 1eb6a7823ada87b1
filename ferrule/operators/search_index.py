"""Search through an index: trigrams of places, targets and machine names.

The index is two tables of postings, sorted by trigram so that a search reads
the row groups of its own trigrams: of item texts (rule, place, target) with
the items' numbers, and of machine names with the machines' places in order.
A search intersects the postings of its trigrams; what is left are candidates,
whose texts are then compared, so results are those of a search through all
occurrences.  Searches of fewer than three characters have no trigram and go
through the distinct texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from .assessment import Assessment

GRAM = 3


def grams(text: Column) -> Column:
    """The distinct trigrams of a text; none of shorter ones."""
    n = F.length(text)
    return F.when(n >= GRAM, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - GRAM + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class SearchIndex:
    """texts (number, text), hosts (load_idx, text) and their postings (gram, number or load_idx); all written."""

    texts: DataFrame
    hosts: DataFrame
    text_postings: DataFrame
    host_postings: DataFrame
    machines: DataFrame

    def numbers(self, search: str) -> DataFrame:
        """The numbers of items with the text (trimmed, whatever its case) in their rule, or a place, target or machine of an occurrence."""
        wanted = search.strip().lower()
        texts = _found(self.texts, self.text_postings, "number", wanted)
        hosts = _found(self.hosts, self.host_postings, "load_idx", wanted)
        return texts.union(self.machines.join(hosts, "load_idx", "left_semi").select("number")).distinct()


def _found(texts: DataFrame, postings: DataFrame, key: str, wanted: str) -> DataFrame:
    own = sorted({wanted[i : i + GRAM] for i in range(len(wanted) - GRAM + 1)})
    if own:
        hits = postings.where(F.col("gram").isin(own)).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") == len(own))
        texts = texts.join(hits.select(key), key, "left_semi")
    return texts.where(F.col("text").contains(wanted)).select(key).distinct()


def _postings(texts: DataFrame, key: str, name: str) -> DataFrame:
    each = texts.select(key, F.explode(grams(F.col("text"))).alias("gram")).distinct()
    return materialize(each.repartitionByRange("gram", key).sortWithinPartitions("gram", key), name)


def build(a: Assessment) -> SearchIndex:
    """Written with the assessment, once; a text that an item has in many places is indexed once."""
    occ = a.occurrences
    each = occ.select("number", F.explode(F.array("loc_path", "loc_item", "target")).alias("text")).union(a.items.select("number", "rule"))
    texts = materialize(each.where("text is not null").select("number", F.lower("text").alias("text")).distinct(), "texts")
    hosts = materialize(a.machines.select("load_idx", F.lower("hostname").alias("text")), "hosts")
    machines = materialize(occ.select("number", "load_idx").distinct(), "machines")
    return SearchIndex(texts, hosts, _postings(texts, "number", "text_postings"), _postings(hosts, "load_idx", "host_postings"), machines)
