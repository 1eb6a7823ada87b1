"""The thin queries opN_<name>: each applies an operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, exact_dedup, html_text, line_dedup, ngram_join, oracles, packing, prefix_trie, quality, sharding, simhash, substring_dedup, toxicity
from .labelled import remainder
from .store import documents, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "n_links")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "benchmark")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = documents(spark, sf_dir), remainder(3) == 1
    model = quality.train(docs, table(spark, sf_dir, "labels"), "quality", ~held_out)
    return quality.score(docs.select("doc_id", "text"), model, keep_text=False).select("doc_id", held_out.alias("held_out"), "score", quality.predicted().alias("predicted"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir), keep="largest")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = documents(spark, sf_dir), remainder(5) == 0
    network = toxicity.train(docs, table(spark, sf_dir, "labels"), "toxic", ~held_out)
    return toxicity.score(docs.select("doc_id", "text"), network, keep_text=False).select("doc_id", held_out.alias("held_out"), "score", quality.predicted().alias("predicted"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(documents(spark, sf_dir), shards=8).withColumn("law", F.lit("key"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate(table(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), TOKENIZER)


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(documents(spark, sf_dir))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.build(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_ngram_join, op2_html_text, op3_decontaminate, op4_quality, op5_exact_dedup, op6_toxicity, op7_sharding, op8_substring_dedup, op9_line_dedup, op10_packing,
        op11_simhash, op12_divergence, op13_prefix_trie,
    )
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
