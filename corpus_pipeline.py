"""Corpus preparation in stages.

Each stage is ``(name, function)``; a function takes ``(spark, docs, sf_dir)``
and returns a DataFrame, which is written and read again as the next stage's
``docs``.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixmill.llm import decontaminate, mixing, ngram_join, quality, token_shards
from helixmill.llm.common import Stash, read


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the fixed rules and are no outliers of their language and source."""
    return quality.keep_good(docs)


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near duplicates."""
    return ngram_join.keep_first(docs)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of ten words of the benchmark."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources draws them."""
    return mixing.drawn_documents(docs)


def training_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Raw token shards in training order; their manifest with the documents of each record."""
    return token_shards.build(docs).withColumnRenamed("keys", "doc_ids")


STAGES = [
    ("quality rules", good_quality),
    ("n-gram Jaccard join", one_per_group),
    ("benchmark decontamination", not_in_benchmark),
    ("mixing sources to target weights", mixed_sources),
    ("token-ID / binary output", training_shards),
]

#: Robust outliers and byte-pair IDs are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stash = Stash(spark)
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stash.put(docs)
            stash.drop(before)
    return docs
