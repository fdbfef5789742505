"""Roles of genomes: exclusion, blacklist, blended frequencies; reports of composition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.functions import scores, seq


def without(counts: DataFrame, excluded: DataFrame, most: int = 0) -> DataFrame:
    """Counts of k-mers that occur at most ``most`` times in the excluded genomes."""
    bad = excluded.groupBy("kmer").agg(F.sum("n").alias("hits")).where(F.col("hits") > most)
    return counts.join(bad, "kmer", "left_anti")


def blacklist(counts: DataFrame, listed: DataFrame, seqs: DataFrame, most: float) -> DataFrame:
    """``bl_freq`` over all blacklisted sequence, and whether it stays at or below ``most``."""
    hits = listed.groupBy("kmer").agg(F.sum("n").alias("hits"))
    total = seqs.agg(F.sum(F.length("seq")).alias("total"))
    j = counts.join(hits, "kmer", "left").join(F.broadcast(total))  # one row
    freq = F.coalesce(F.coalesce("hits", F.lit(0)) / F.col("total"), F.lit(0.0))
    return j.withColumn("bl_freq", freq).withColumn("passes", F.col("bl_freq") <= most)


def blended(counts: DataFrame, totals: DataFrame, roles: dict[str, object]) -> DataFrame:
    """Mean target, greatest background and greatest blacklist frequency per k-mer, and the weighted penalty."""
    f = counts.groupBy("kmer", "role").agg(F.sum("n").alias("n")).join(F.broadcast(totals), "role").select("kmer", "role", (F.col("n") / F.col("length")).alias("f"))
    of = lambda name: F.when(F.col("role") == roles[name], F.col("f"))
    g = f.groupBy("kmer").agg(*[F.coalesce(x, F.lit(0.0)).alias(c) for c, x in (("target_freq", F.avg(of("target"))), ("bg_freq", F.max(of("background"))), ("bl_freq", F.max(of("blacklist"))))])
    return g.withColumn("penalty", F.col("bg_freq") + 5 * F.col("bl_freq"))


def floor_filter(df: DataFrame, ratio: Column, tie: str, least: float, share: float) -> DataFrame:
    """Rows with a ratio of at least ``least``, but never fewer than the best ``share`` of all.

    Ranks are found from counts per ratio, which combine before the shuffle;
    only rows at the ratio of the cut are ranked by ``tie``.
    """
    d = df.withColumn("__ratio", ratio)
    per = d.groupBy("__ratio").agg(F.count("*").alias("c"))
    run = per.select("__ratio", F.sum("c").over(Window.orderBy(F.desc("__ratio")).rowsBetween(Window.unboundedPreceding, -1)).alias("__above"), F.floor(share * F.sum("c").over(Window.partitionBy(F.lit(1)))).alias("__quota"))
    j = d.join(run, "__ratio").withColumn("__above", F.coalesce("__above", F.lit(0)))
    at_cut = j.where((F.col("__ratio") < least) & (F.col("__above") < F.col("__quota")))
    ranked = at_cut.withColumn("__rn", F.row_number().over(Window.partitionBy("__ratio").orderBy(tie))).where(F.col("__above") + F.col("__rn") <= F.col("__quota"))
    return j.where(F.col("__ratio") >= least).drop("__ratio", "__above", "__quota").unionByName(ranked.drop("__ratio", "__above", "__quota", "__rn"))


def gc_windows(seqs: DataFrame, size: int) -> DataFrame:
    """GC share of tumbling windows; a window that ends at or beyond the sequence's end is left out."""
    starts = F.sequence(F.lit(0), F.greatest(F.length("seq") - size - 1, F.lit(0)), F.lit(size))
    w = seqs.where(F.length("seq") > size).select("genome", "seq", F.explode(starts).alias("start"))
    return w.select("genome", "start", seq.gc_content(F.substring(F.col("seq"), F.col("start") + 1, F.lit(size))).alias("gc"))


def n50(lengths: DataFrame, keys: list[str], length: str = "length") -> DataFrame:
    """Length at which the running sum from the longest reaches half of all."""
    w = Window.partitionBy(*keys)
    s = lengths.select(*keys, length, F.sum(length).over(w.orderBy(F.desc(length)).rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum(length).over(w).alias("total"))
    return s.where(F.col("upto") * 2 >= F.col("total")).groupBy(*keys).agg(F.max(length).alias("n50"), F.max("total").alias("total"))


def report(seqs: DataFrame, window: int) -> DataFrame:
    """Per genome: length, GC, class, spread of windowed GC."""
    base = seqs.select("genome", F.length("seq").alias("length"), seq.gc_content(F.col("seq")).alias("gc"))
    spread = gc_windows(seqs, window).groupBy("genome").agg(F.stddev_pop("gc").alias("gc_std"), F.count("*").alias("windows"))
    return base.join(spread, "genome", "left").select("genome", "length", "gc", scores.gc_class(F.col("gc")).alias("gc_class"), F.coalesce("gc_std", F.lit(0.0)).alias("gc_std"), F.coalesce("windows", F.lit(0)).alias("windows"))
