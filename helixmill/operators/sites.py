"""Binding sites, gaps, coverage, strands and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.functions import seq
from helixmill.operators import kmers


def find_sites(seqs: DataFrame, primers: DataFrame, ks: list[int], circular: bool = False, at_most: int | None = None, most_broadcast: int = 100_000) -> DataFrame:
    """All occurrences of primers on both strands: ``genome, primer, strand, pos``; overlaps count.

    Patterns meet the k-mers of the sequences in a hash join, broadcast only
    behind a count (or ``at_most``, where the caller has limited them).  A hit of the reverse complement is the primer's site on
    strand ``-``; a palindrome is listed on both strands.
    """
    patterns = primers.select("primer", F.explode(F.array(F.struct(F.col("primer").alias("kmer"), F.lit("+").alias("strand")), F.struct(seq.reverse_complement(F.col("primer")).alias("kmer"), F.lit("-").alias("strand")))).alias("x")).select("primer", "x.kmer", "x.strand")
    if (2 * at_most if at_most else patterns.limit(most_broadcast + 1).count()) <= most_broadcast:
        patterns = F.broadcast(patterns)
    if circular:  # the first k - 1 bases follow the last
        out = None
        for k in ks:
            ring = seqs.where(F.length("seq") >= k).withColumn("seq", F.concat("seq", F.substring("seq", 1, k - 1)))
            one = kmers.windows(ring, [k])
            out = one if out is None else out.unionByName(one)
    else:
        out = kmers.windows(seqs, ks)
    return out.join(patterns, "kmer").select("genome", "primer", "strand", "pos")


def gaps(sites: DataFrame, keys: list[str], length: Column | None = None) -> DataFrame:
    """Distances of consecutive sites; with ``length`` (a column) also the one that closes the circle.

    Fewer than two sites give none.
    """
    w = Window.partitionBy(*keys).orderBy("pos")
    whole = Window.partitionBy(*keys)
    s = sites.select(*keys, "pos", *( [length.alias("__len")] if length is not None else []), F.lag("pos").over(w).alias("before"), F.count("*").over(whole).alias("n"), F.min("pos").over(whole).alias("first"))
    inner = s.where("before is not null").select(*keys, (F.col("pos") - F.col("before")).alias("gap"))
    if length is None:
        return inner
    last = s.withColumn("after", F.lead("pos").over(w)).where("after is null and n > 1")
    return inner.unionByName(last.select(*keys, (F.col("__len") - F.col("pos") + F.col("first")).alias("gap")))


def gini(df: DataFrame, keys: list[str], value: str, shift: float = 1e-7) -> DataFrame:
    """Gini coefficient of a column per group: sum((2i - n - 1) x) / (n sum(x)), every x raised by ``shift``."""
    w = Window.partitionBy(*keys)
    ranked = df.select(*keys, (F.col(value) + shift).alias("x"), F.row_number().over(w.orderBy(value)).alias("i"), F.count("*").over(w).alias("n"))
    top, bottom = F.sum((2 * F.col("i") - F.col("n") - 1) * F.col("x")), F.max("n") * F.sum("x")
    return ranked.groupBy(*keys).agg(F.when(bottom > 0, top / bottom).otherwise(0.0).alias("gini"), F.max("n").cast("long").alias("n"))


def histogram_entropy(df: DataFrame, keys: list[str], value: str, most: int = 50) -> DataFrame:
    """Entropy in bits of an equal-width histogram of min(most, n) bins from least to largest; one value or none: 0."""
    w = Window.partitionBy(*keys)
    b = df.select(*keys, F.col(value).cast("double").alias("v"), F.count("*").over(w).alias("n"), F.min(value).over(w).cast("double").alias("lo"), F.max(value).over(w).cast("double").alias("hi"))
    bins = F.least(F.lit(most), F.col("n"))
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), bins - 1))
    c = b.select(*keys, "n", at.alias("bin")).groupBy(*keys, "bin").agg(F.count("*").alias("c"), F.max("n").alias("n"))
    p = F.col("c") / F.col("n")
    return c.groupBy(*keys).agg(F.sum(-p * F.log2(p)).alias("entropy"))


def islands(intervals: DataFrame, keys: list[str], start: str = "s", end: str = "e", also: tuple[Column, ...] = ()) -> DataFrame:
    """Union of half-open intervals: ``keys, s, e``, touching ones joined; ``also``: aggregates of an island's rows."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    far = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.withColumn("new", F.when(far.isNull() | (F.col(start) > far), 1).otherwise(0))
    numbered = marked.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "island").agg(F.min(start).alias("s"), F.max(end).alias("e"), *also).drop("island")


def reach_windows(sites: DataFrame, keys: list[str], reach: int, length: Column, beyond: bool = False) -> DataFrame:
    """``[pos - reach, pos + reach)`` of each site, clipped to the sequence, never wrapped.

    Sites that don't reach the sequence have none.  With ``beyond`` each keeps
    a window of its own, as in plain SQL: it starts at ``pos - reach`` and ends
    at the end of the sequence before that, so its size is negative.
    """
    w = sites.select(*keys, length.alias("length"), F.greatest(F.lit(0), F.col("pos") - reach).alias("s"), F.least(length, F.col("pos") + reach).alias("e"))
    return w if beyond else w.where("e > s")


def coverage(sites: DataFrame, keys: list[str], reach: int, length: Column, beyond: bool = False) -> DataFrame:
    """Covered bases and share per group (``beyond``: see :func:`reach_windows`)."""
    isl = islands(reach_windows(sites, keys, reach, length, beyond), keys, also=(F.max("length").alias("length"),))
    c = isl.groupBy(*keys).agg(F.sum(F.col("e") - F.col("s")).alias("covered"), F.count("*").alias("islands"), F.max("length").alias("length"))
    return c.select(*keys, "covered", "islands", "length", (F.col("covered") / F.col("length")).alias("coverage"))


def holes(sites: DataFrame, keys: list[str], reach: int, length: Column, least: int, beyond: bool = False) -> DataFrame:
    """Uncovered runs longer than ``least``, both ends of the sequence included (``beyond``: see :func:`reach_windows`)."""
    isl = islands(reach_windows(sites, keys, reach, length, beyond), keys, also=(F.max("length").alias("length"),))
    w = Window.partitionBy(*keys).orderBy("s")
    inner = isl.select(*keys, F.coalesce(F.lag("e").over(w), F.lit(0)).alias("s"), F.col("s").alias("e"))
    tail = isl.groupBy(*keys).agg(F.max("e").alias("s"), F.max("length").alias("e"))
    return inner.unionByName(tail).select(*keys, "s", "e", (F.col("e") - F.col("s")).alias("size")).where(F.col("size") > least)


def strand_bias(sites: DataFrame, keys: list[str], max_ratio: float = 4.0, max_score: float = 0.7) -> DataFrame:
    plus, minus = F.count_if(F.col("strand") == "+"), F.count_if(F.col("strand") == "-")
    g = sites.groupBy(*keys).agg(plus.alias("forward_count"), minus.alias("reverse_count"))
    f, r = F.col("forward_count"), F.col("reverse_count")
    ratio = F.when(r == 0, F.lit(float("inf"))).when(f == 0, 0.0).otherwise(f / r)
    score = F.when((r == 0) | (f == 0), 1.0).otherwise(F.least(F.lit(1.0), F.abs(F.log2(f / r)) / F.log2(F.lit(max_ratio))))
    g = g.withColumn("bias_ratio", ratio).withColumn("bias_score", score)
    ok = (F.col("bias_ratio") <= max_ratio) & (F.col("bias_ratio") >= 1 / max_ratio) & (F.col("bias_score") <= max_score)
    return g.withColumn("passes", ok)


def alternation(sites: DataFrame, keys: list[str]) -> DataFrame:
    """Strand switches along the sequence, their distances, and the longest run on one strand."""
    w = Window.partitionBy(*keys).orderBy("pos", "strand", "site")
    s = sites.select(*keys, "pos", "strand", "site", F.lag("strand").over(w).alias("ls"), F.lag("pos").over(w).alias("lp"))
    switch = F.col("ls").isNotNull() & (F.col("ls") != F.col("strand"))
    s = s.withColumn("switch", switch).withColumn("run", F.sum(F.col("switch").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = s.groupBy(*keys, "run").agg(F.count("*").alias("len")).groupBy(*keys).agg(F.max("len").alias("longest_run"))
    g = s.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("switch").alias("switches"), F.avg(F.when(F.col("switch"), F.col("pos") - F.col("lp"))).alias("gap_mean"), F.max(F.when(F.col("switch"), F.col("pos") - F.col("lp"))).alias("gap_max"), F.count_if(F.col("strand") == "+").alias("f"), F.count_if(F.col("strand") == "-").alias("r"))
    balance = F.when((F.col("f") > 0) & (F.col("r") > 0), F.least("f", "r") / F.greatest("f", "r")).otherwise(0.0)
    return g.join(runs, keys).select(*keys, "n", "switches", "gap_mean", "gap_max", F.when(F.col("n") > 1, F.col("switches") / (F.col("n") - 1)).otherwise(0.0).alias("alternation"), balance.alias("balance"), "longest_run")


def nearest_opposite(sites: DataFrame, keys: list[str]) -> DataFrame:
    """Distance of each forward site to the nearest reverse site, in two sorts (forth and back) and no join.

    Both frames grow from their start, so each row is looked at once; a frame
    that ends at the last row would be gone through again for every row.
    """
    forth, back = (Window.partitionBy(*keys).orderBy(o).rangeBetween(Window.unboundedPreceding, 0) for o in (F.asc("pos"), F.desc("pos")))
    rev = F.when(F.col("strand") == "-", F.col("pos"))
    s = sites.select(*keys, "pos", "strand", "site", F.max(rev).over(forth).alias("left")).withColumn("right", F.min(rev).over(back))
    d = F.least(F.col("pos") - F.col("left"), F.col("right") - F.col("pos"))
    return s.where("strand = '+'").select(*keys, "site", "pos", d.alias("distance"))


def components(sites: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """Connected components of sites with edges between opposite strands within ``reach``.

    They are runs in order of position: a run ends where neither the last
    reverse site before and the first forward site after nor the other pair lie
    within reach.  So windows forth and back, whose frames grow from their
    start, replace the edges.
    """
    order = ("pos", "strand", "site")
    w = Window.partitionBy(*keys).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(*map(F.desc, order)).rowsBetween(Window.unboundedPreceding, 0)
    of = lambda strand: F.when(F.col("strand") == strand, F.col("pos"))
    s = sites.select(*keys, *order, F.min(of("+")).over(after).alias("next_f"), F.min(of("-")).over(after).alias("next_r"))
    s = s.select(*keys, *order, "next_f", "next_r", F.max(of("+")).over(before).alias("last_f"), F.max(of("-")).over(before).alias("last_r"))
    tied = ((F.col("next_f") - F.col("last_r")) <= reach) | ((F.col("next_r") - F.col("last_f")) <= reach)
    s = s.select(*keys, "site", "pos", "strand", F.when(F.coalesce(tied, F.lit(False)), 0).otherwise(1).alias("new"))
    return s.withColumn("component", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def band_join(a: DataFrame, b: DataFrame, keys: list[str], reach: int, least: int = 0, directed: bool = False) -> DataFrame:
    """Pairs of forward and reverse sites: ``least <= |distance| <= reach`` (directed: reverse after forward).

    Positions are cut into bins of ``reach``; a row meets its own and the
    neighbouring bins, so the join has an equality key.
    """
    x = a.select(*keys, F.col("site").alias("site_f"), F.col("pos").alias("pos_f"), F.explode(F.array(*[(F.floor(F.col("pos") / reach) + d) for d in ((0, 1) if directed else (-1, 0, 1))])).alias("bin"))
    y = b.select(*keys, F.col("site").alias("site_r"), F.col("pos").alias("pos_r"), F.floor(F.col("pos") / reach).alias("bin"))
    d = F.col("pos_r") - F.col("pos_f") if directed else F.abs(F.col("pos_r") - F.col("pos_f"))
    return x.join(y, [*keys, "bin"]).select(*keys, "site_f", "site_r", "pos_f", "pos_r", d.alias("distance")).where(F.col("distance").between(least, reach))


def bins_of(sites: DataFrame, keys: list[str], reach: int, size: int) -> DataFrame:
    """Distinct bins that a primer reaches: forward sites to the right, reverse sites to the left."""
    s = F.when(F.col("strand") == "+", F.col("pos")).otherwise(F.greatest(F.lit(0), F.col("pos") - reach))
    e = F.when(F.col("strand") == "+", F.col("pos") + reach).otherwise(F.col("pos"))
    return sites.select(*keys, F.explode(F.sequence(F.floor(s / size), F.floor(e / size))).alias("bin")).distinct()
