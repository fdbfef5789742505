"""The queries of the corpus operators: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.llm import decontaminate, langid, line_dedup, mixing, ngram_join, quality, secrets, suffix_dedup, surrogates, token_shards
from helixmill.llm.common import read


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_deleted", "n_runs", F.sha2("kept", 256).alias("kept_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove(read(spark, sf_dir, "documents"), with_text=False)


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.digest(read(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(read(spark, sf_dir, "documents")))


def op6_secret_scan_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed patterns alone, which have a SQL twin."""
    return secrets.digest(secrets.scan(read(spark, sf_dir, "documents"), table=[0.0] * len(secrets.ALPHABET) ** 2)).drop("spans")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked_classes(read(spark, sf_dir, "documents"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).drop("pieces")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(read(spark, sf_dir, "documents"))


def op9_quality_rules_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed rules alone, which have a SQL twin."""
    return quality.with_statistics(read(spark, sf_dir, "documents")).select("doc_id", *quality.STATS, "base_failed")


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.build(read(spark, sf_dir, "documents")).withColumnRenamed("keys", "doc_ids")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.ORACLE, "op3_suffix_dedup": suffix_dedup.ORACLE, "op7_ngram_jaccard_join": ngram_join.ORACLE, "op5_decontaminate": decontaminate.ORACLE, "op6_secret_scan_base": secrets.BASE_ORACLE, "op8_mix_sources": mixing.ORACLE, "op9_quality_rules_base": quality.BASE_ORACLE}
