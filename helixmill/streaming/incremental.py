"""Structured Streaming: k-mer counts and windows over arriving rows (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.operators import kmers


def kmer_counts(stream: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """Running canonical counts of arriving sequences; for output mode update or complete."""
    return kmers.count(kmers.sequences(stream, key, text, F.lit(0)), [k]) if not stream.isStreaming else _streamed(stream, key, text, k)


def _streamed(stream: DataFrame, key: str, text: str, k: int) -> DataFrame:
    from helixmill.functions import seq

    w = kmers.windows(kmers.sequences(stream, key, text, F.lit(0)), [k])
    return w.groupBy(seq.canonical(F.col("kmer")).alias("kmer")).agg(F.count("*").alias("n"))


def event_windows(stream: DataFrame, ts: str, kind: str, value: str, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Counts and sums per kind and tumbling window; rows later than ``late`` are left out."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")


def append_sites(batch: DataFrame, path: str) -> None:
    """``foreachBatch`` sink of new sites: those already in the index are left out, so a replayed batch adds nothing."""
    spark = batch.sparkSession
    try:
        known = spark.read.parquet(path)
        batch = batch.join(known, ["genome", "primer", "strand", "pos"], "left_anti")
    except Exception as e:  # the index does not exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    batch.write.mode("append").parquet(path)
