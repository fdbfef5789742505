"""K-mer counting, rates and candidate selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.functions import scores, seq, thermo

#: Bases that one row of work owns; long sequences are cut, with k - 1 bases of overlap.
CHUNK = 1 << 16


def sequences(df: DataFrame, key: str, text: str, role: Column) -> DataFrame:
    """``genome, role, seq`` of any table with a string column."""
    return df.select(F.col(key).alias("genome"), role.alias("role"), seq.clean(F.coalesce(F.col(text), F.lit(""))).alias("seq"))


def spread(df: DataFrame) -> DataFrame:
    """Deals rows out where they come from fewer files than there are cores; large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def chunks(seqs: DataFrame, overlap: int, size: int = CHUNK) -> DataFrame:
    """Pieces that own ``size`` starts each and reach ``overlap`` bases further; ``start`` is 0-based."""
    starts = F.sequence(F.lit(0), F.greatest(F.length("seq") - 1, F.lit(0)), F.lit(size))
    cut = seqs.withColumn("start", F.explode(starts))
    return cut.withColumn("seq", F.substring(F.col("seq"), F.col("start") + 1, F.lit(size + overlap)))


def windows(seqs: DataFrame, ks: list[int], deal: bool = False) -> DataFrame:
    """``genome, role, k, pos, kmer``: every k-mer with its place, all lengths in one pass over the sequences.

    ``deal`` shuffles the pieces of long sequences first, so that a contig of
    hundreds of megabases isn't one task's work; texts and reads don't need it.
    """
    pieces = chunks(seqs, max(ks) - 1, CHUNK)
    if deal:
        pieces = pieces.repartition("genome", "start")
    if len(ks) == 1:
        rows = pieces.select("genome", "role", F.lit(ks[0]).alias("k"), "start", F.posexplode(seq.kmers(F.col("seq"), ks[0])).alias("at", "kmer"))
    else:  # a piece reaches over by the longest k, and owns as many starts for each
        of = lambda k: F.transform(F.slice(seq.kmers(F.col("seq"), k), 1, CHUNK), lambda x, i: F.struct(F.lit(k).alias("k"), i.alias("at"), x.alias("kmer")))
        rows = pieces.select("genome", "role", "start", F.explode(F.flatten(F.array(*map(of, ks)))).alias("x")).select("genome", "role", "x.k", "start", "x.at", "x.kmer")
    return rows.select("genome", "role", "k", (F.col("start") + F.col("at")).cast("long").alias("pos"), "kmer")


def count(seqs: DataFrame, ks: list[int], keys: tuple[str, ...] = ("role",), both_strands: bool = True, deal: bool = False) -> DataFrame:
    """Counts per keys, k and k-mer; with both strands a k-mer and its reverse complement are one."""
    plain = windows(seqs, ks, deal).groupBy(*keys, "k", "kmer").agg(F.count("*").alias("n"))
    if not both_strands:
        return plain
    # strands are merged after the first sum: complements are built for kinds, not for occurrences
    return plain.select(*keys, "k", seq.canonical(F.col("kmer")).alias("kmer"), "n").groupBy(*keys, "k", "kmer").agg(F.sum("n").alias("n"))


def lengths(seqs: DataFrame, *keys: str) -> DataFrame:
    return seqs.groupBy(*keys).agg(F.sum(F.length("seq")).alias("length"))


def rates(counts: DataFrame, totals: DataFrame, fg: Column, bg: Column, min_fg: float, max_bg: float) -> DataFrame:
    """Foreground and background counts and frequencies per k-mer, with the scaled thresholds applied.

    One pass over the counts: roles are summed side by side, not joined.
    Both comparisons are strict; an absent count is 0; without background
    sequence every k-mer passes.
    """
    wide = counts.groupBy("k", "kmer").agg(F.sum(F.when(fg, F.col("n")).otherwise(0)).alias("fg_count"), F.sum(F.when(bg, F.col("n")).otherwise(0)).alias("bg_count")).where("fg_count > 0")
    size = totals.agg(F.sum(F.when(fg, F.col("length"))).alias("fg_len"), F.sum(F.when(bg, F.col("length"))).alias("bg_len"))
    out = wide.join(F.broadcast(size))  # one row
    fg_rate, bg_rate = F.col("fg_count") / F.col("fg_len"), F.col("bg_count") / F.col("bg_len")
    keep = (fg_rate > scores.scaled_threshold(min_fg, F.col("k"))) & F.coalesce(bg_rate < scores.scaled_threshold(max_bg, F.col("k")), F.lit(True))
    return out.select("k", "kmer", "fg_count", "bg_count", fg_rate.alias("fg_freq"), F.coalesce(bg_rate, F.lit(0.0)).alias("bg_freq"), keep.alias("passes"))


def rule_reasons(s: Column, tm: Column, min_tm: float, max_tm: float, gc_min: float, gc_max: float, self_dimer: int, genome_gc: float | None = None) -> Column:
    """First rule that a candidate breaks, null if none: Tm, run, GC, clamp, 3' end, repeat, self-dimer."""
    gc, five = seq.gc_content(s), seq.gc_last(s, 5)
    lo, hi = (0, 3) if genome_gc is not None and genome_gc < 0.30 else (1, 4) if genome_gc is not None and genome_gc > 0.70 else (1, 3)
    return (
        F.when(~tm.between(min_tm, max_tm), "tm")
        .when(seq.has_homopolymer(s, 5), "homopolymer")
        .when(~gc.between(gc_min, gc_max), "gc")
        .when(~five.between(lo, hi), "clamp")
        .when(seq.gc_last(s, 3) > 2, "three_prime")
        .when((F.length(s) >= 10) & seq.has_dinucleotide_repeat(s), "dinucleotide")
        .when(seq.is_dimer(s, s, self_dimer), "self_dimer")
    )


def wide_prefilter(s: Column, gc_min: float, gc_max: float, tm_min: float, tm_max: float) -> Column:
    """GC within the limits widened by 0.10, Tm strictly within the limits widened by 15 degrees."""
    tm = thermo.tm_salt(s)
    return seq.gc_content(s).between(max(0.10, gc_min - 0.10), min(0.90, gc_max + 0.10)) & (tm > tm_min - 15) & (tm < tm_max + 15)


def ranked(df: DataFrame, most: int) -> DataFrame:
    """Least background-to-foreground ratio first, ties by k-mer; a zero foreground counts as infinite."""
    ratio = F.when(F.col("fg_count") > 0, F.col("bg_count") / F.col("fg_count")).otherwise(F.lit(float("inf")))
    return df.withColumn("ratio", ratio).orderBy("ratio", "kmer").limit(most)


def lookup(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """``asked, n``: the count of each string under its canonical form; 0 if it is not there."""
    n = counts.groupBy("kmer").agg(F.sum("n").alias("n"))
    return asked.withColumn("kmer", seq.canonical(F.col("asked"))).join(n, "kmer", "left").select("asked", F.coalesce("n", F.lit(0)).alias("n"))
