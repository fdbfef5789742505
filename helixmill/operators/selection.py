"""Selection of small sets: cover, beam, pruning, skyline, search.

Rows of sites are summed to (primer, bin) in Spark first.  Loops make one job a
round that judges all candidates at once and brings only the pick to the
driver; the incidence is written once, so a lost executor costs a re-read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def register(name: str):
    def add(f):
        REGISTRY[name] = f
        return f

    return add


def best_gain(incidence: DataFrame, covered: DataFrame | None, weight: Column | None = None) -> DataFrame:
    """Uncovered bins of every primer: ``primer, gain``."""
    left = incidence if covered is None else incidence.join(covered, "bin", "left_anti")
    g = left.groupBy("primer").agg(F.count("*").alias("gain"))
    return g if weight is None else g.withColumn("gain", F.col("gain") * weight)


@register("dominating-set")
def set_cover(incidence: DataFrame, rounds: int, quality: DataFrame | None = None) -> DataFrame:
    """Greedy cover of bins: ``step, primer, gain``; ties by primer.  ``quality`` has a factor per primer."""
    spark = incidence.sparkSession
    incidence = incidence.select("primer", "bin").distinct().persist()
    picks: list[tuple[int, str, float]] = []
    try:
        for step in range(1, rounds + 1):
            covered = incidence.where(F.col("primer").isin([p for _, p, _ in picks])).select("bin").distinct() if picks else None
            g = best_gain(incidence, covered)
            if quality is not None:
                g = g.join(quality, "primer").select("primer", (F.col("gain") * F.col("quality")).alias("gain"))
            top = g.where("gain > 0").orderBy(F.desc("gain"), "primer").limit(1).collect()
            if not top:
                break
            picks.append((step, top[0]["primer"], float(top[0]["gain"])))
    finally:
        incidence.unpersist()
    return spark.createDataFrame(picks, "step int, primer string, gain double")


@register("weighted-set-cover")
def weighted_cover(incidence: DataFrame, rounds: int, quality: DataFrame) -> DataFrame:
    return set_cover(incidence, rounds, quality)


def leave_one_out(incidence: DataFrame) -> DataFrame:
    """Bins that only one primer covers, per primer: what is lost without it."""
    alone = incidence.select("primer", "bin").distinct().withColumn("n", F.count("*").over(Window.partitionBy("bin")))
    return alone.groupBy("primer").agg(F.count_if(F.col("n") == 1).alias("loss"), F.count("*").alias("bins"))


@register("bg-prefilter")
def prune_order(incidence: DataFrame, background: DataFrame) -> DataFrame:
    """``primer, loss, bg_sites, cost``: background sites for each bin that would be lost; the greatest goes first."""
    loss = leave_one_out(incidence).join(background, "primer", "left")
    cost = F.coalesce("bg_sites", F.lit(0)) / F.greatest("loss", F.lit(1))
    return loss.select("primer", "loss", F.coalesce("bg_sites", F.lit(0)).alias("bg_sites"), cost.alias("cost"))


@register("greedy")
def beam(scored: DataFrame, pairs: DataFrame, size: int, width: int = 10, per_state: int = 2) -> DataFrame:
    """Beam search for dimer-free sets with the greatest sum of scores: ``members, score``.

    A level is one join of at most ``width`` states with the candidates.
    """
    bad = pairs.where("dimer").select(F.col("a").alias("x"), F.col("b").alias("y"))
    bad = bad.unionByName(bad.select(F.col("y").alias("x"), F.col("x").alias("y")))
    states = scored.orderBy(F.desc("score"), "primer").limit(width).select(F.array("primer").alias("members"), "score")
    banned = bad.groupBy("x").agg(F.collect_set("y").alias("not_with"))
    cand = scored.join(banned, scored["primer"] == banned["x"], "left").select("primer", F.col("score").alias("gain"), F.coalesce("not_with", F.array().cast("array<string>")).alias("not_with"))
    for _ in range(size - 1):
        w = Window.partitionBy("members").orderBy(F.desc("total"), "primer")
        nxt = states.join(F.broadcast(cand), ~F.array_contains("members", F.col("primer")) & ~F.arrays_overlap("members", "not_with")).withColumn("total", F.col("score") + F.col("gain")).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= per_state)
        states = nxt.select(F.array_sort(F.concat("members", F.array("primer"))).alias("members"), F.col("total").alias("score")).distinct().orderBy(F.desc("score"), F.col("members")).limit(width)
    return states


@register("clique")
def dimer_free_sets(primers: DataFrame, pairs: DataFrame, size: int, most: int = 1_000_000) -> DataFrame:
    """All sets of ``size`` primers without a dimer, grown level by level; more than ``most`` in a level are an error."""
    from helixmill.operators.lineage import cut

    own = cut(primers.select("primer").distinct())
    ok = cut(pairs.where("not dimer").join(own.withColumnRenamed("primer", "a"), "a", "left_semi").join(own.withColumnRenamed("primer", "b"), "b", "left_semi").select("a", "b"))
    level = own.select(F.array("primer").alias("members"))
    for _ in range(size - 1):
        grown = level.join(ok, F.element_at("members", -1) == F.col("a")).select("members", F.col("b").alias("next"))
        if _:
            others = grown.select("members", "next", F.explode("members").alias("m"))
            good = others.join(ok, (others["m"] == ok["a"]) & (others["next"] == ok["b"])).groupBy("members", "next").count()
            grown = good.where(F.col("count") == F.size("members")).select("members", "next")
        level = cut(grown.select(F.concat("members", F.array("next")).alias("members")))
        if level.limit(most + 1).count() > most:
            raise ValueError(f"more than {most} dimer-free sets; rank and limit the candidates first")
    return level


def best_ratio(sets: DataFrame, counts: DataFrame) -> DataFrame:
    """The set with most foreground sites for each background site (plus one): ``members``; ``counts`` has ``primer, fg_sites, bg_sites``."""
    each = sets.select("members", F.explode("members").alias("primer")).join(counts, "primer", "left")
    n = each.groupBy("members").agg(F.coalesce(F.sum("fg_sites"), F.lit(0)).alias("f"), F.coalesce(F.sum("bg_sites"), F.lit(0)).alias("b"))
    return n.orderBy(F.desc(F.col("f") / (F.col("b") + 1)), "members").limit(1).select("members")


def skyline(df: DataFrame, up: str, other_up: str) -> DataFrame:
    """Rows that no row beats in both columns (not worse in both, better in one); one sort, no pairs."""
    best = df.groupBy(up).agg(F.max(other_up).alias("__m"))
    above = best.withColumn("__best", F.max("__m").over(Window.orderBy(F.desc(up)).rowsBetween(Window.unboundedPreceding, -1)))
    return df.join(above.select(up, "__m", "__best"), up).where((F.col(other_up) == F.col("__m")) & (F.col("__best").isNull() | (F.col(other_up) > F.col("__best")))).drop("__m", "__best")


@register("genetic")
def genetic(scored: DataFrame, pairs: DataFrame, size: int, population: int = 40, generations: int = 12, seed: int = 42) -> DataFrame:
    """Sets by selection, crossover and mutation: ``members, fitness``; the candidate table is small by contract.

    Fitness is the sum of scores less a penalty for each dimer; every draw
    comes from the seed.
    """
    import numpy as np

    rows = scored.orderBy("primer").limit(5001).collect()
    if len(rows) > 5000:
        raise ValueError("more than 5000 candidates; rank and limit them first")
    names = [r["primer"] for r in rows]
    score = np.array([r["score"] for r in rows], float)
    index = {p: i for i, p in enumerate(names)}
    bad = np.zeros((len(names), len(names)), bool)
    for r in pairs.where("dimer").collect():
        if r["a"] in index and r["b"] in index:
            bad[index[r["a"]], index[r["b"]]] = bad[index[r["b"]], index[r["a"]]] = True
    size = min(size, len(names))
    rng = np.random.default_rng(seed)
    fitness = lambda s: score[s].sum() - 10 * bad[np.ix_(s, s)].sum() / 2
    pool = [np.sort(rng.choice(len(names), size, replace=False)) for _ in range(population)]
    for _ in range(generations):
        values = np.array([fitness(s) for s in pool])
        keep = [pool[i] for i in np.argsort(-values, kind="stable")[: population // 5]]
        while len(keep) < population:
            a, b = (pool[max(rng.integers(0, population, 3), key=lambda i: (values[i], -i))] for _ in range(2))
            union = np.union1d(a, b)
            child = rng.choice(union, size, replace=False)
            if rng.random() < 0.3:
                child[rng.integers(size)] = rng.integers(len(names))
                child = np.unique(child)
                while len(child) < size:
                    child = np.unique(np.append(child, rng.integers(len(names))))
            keep.append(np.sort(child))
        pool = keep
    best = sorted({tuple(names[i] for i in s): float(fitness(s)) for s in pool}.items(), key=lambda x: (-x[1], x[0]))
    return scored.sparkSession.createDataFrame([(list(k), v) for k, v in best], "members array<string>, fitness double")


@register("composite")
def best_of(results: DataFrame) -> DataFrame:
    """The best row of several methods' results: ``method, score, members``."""
    return results.agg(F.max_by(F.struct("method", "score", "members"), F.struct("score", "method")).alias("x")).select("x.*")


def interval_gain(sites: DataFrame, covered: DataFrame | None, reach: int, strand: str) -> DataFrame:
    """New bases of each primer on one strand: ``primer, gain``; windows ``[pos, pos + reach)``.

    The covered islands join every candidate's windows, so that one union over
    all candidates gives all gains.
    """
    from helixmill.operators.sites import islands

    own = sites.where(F.col("strand") == strand).select("primer", "genome", F.col("pos").alias("s"), (F.col("pos") + reach).alias("e"))
    if covered is None:
        return islands(own, ["primer", "genome"]).groupBy("primer").agg(F.sum(F.col("e") - F.col("s")).alias("gain"))
    names = own.select("primer").distinct()
    both = own.unionByName(covered.join(F.broadcast(names)).select("primer", "genome", "s", "e"))
    size = covered.agg(F.sum(F.col("e") - F.col("s")).alias("have"))
    total = islands(both, ["primer", "genome"]).groupBy("primer").agg(F.sum(F.col("e") - F.col("s")).alias("all"))
    return total.join(F.broadcast(size)).select("primer", (F.col("all") - F.col("have")).alias("gain"))


@register("tiling")
def tiling(sites: DataFrame, background: DataFrame, reach: int, rounds: int) -> DataFrame:
    """Per strand, the primer with the greatest ``gain / (1 + bg / (fg + 1))`` again and again: ``strand, step, primer, gain``."""
    from helixmill.operators.sites import islands

    fg = sites.groupBy("primer").agg(F.count("*").alias("fg"))
    weight = fg.join(background, "primer", "left").select("primer", (1 + F.coalesce("bg_sites", F.lit(0)) / (F.col("fg") + 1)).alias("w"))
    out = []
    for strand in ("+", "-"):
        picks: list[str] = []
        for step in range(1, rounds + 1):
            mine = sites.where((F.col("strand") == strand) & F.col("primer").isin(picks)).select("genome", F.col("pos").alias("s"), (F.col("pos") + reach).alias("e"))
            g = interval_gain(sites, islands(mine, ["genome"]) if picks else None, reach, strand)
            top = g.join(weight, "primer").where("gain > 0").withColumn("score", F.col("gain") / F.col("w")).where(~F.col("primer").isin(picks)).orderBy(F.desc("score"), "primer").limit(1).collect()
            if not top:
                break
            picks.append(top[0]["primer"])
            out.append((strand, step, top[0]["primer"], int(top[0]["gain"])))
    return sites.sparkSession.createDataFrame(out, "strand string, step int, primer string, gain long")


# Weights of coverage, connectivity, amplification and background by strategy.
STRATEGIES = {"clinical": (0.2, 0.2, 0.2, 0.4), "discovery": (0.4, 0.3, 0.2, 0.1), "fast": (0.5, 0.3, 0.2, 0.0), "balanced": (0.25, 0.25, 0.25, 0.25), "enrichment": (0.3, 0.25, 0.3, 0.15)}


@register("normalized")
def normalized(metrics: DataFrame, strategy: str = "balanced") -> DataFrame:
    """Weighted sum of four scores in [0, 1]; ``metrics`` has ``primer, coverage, connectivity, amplification, background``; the last two on a log scale to a million."""
    w = STRATEGIES[strategy]
    log_ = lambda c: F.least(F.lit(1.0), F.log10(1 + F.greatest(F.col(c), F.lit(0.0))) / 6)
    one = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c)))
    return metrics.withColumn("score", w[0] * one("coverage") + w[1] * one("connectivity") + w[2] * log_("amplification") + w[3] * (1 - log_("background")))


@register("moea")
def layers(df: DataFrame, up: str, other_up: str, most: int = 5) -> DataFrame:
    """Layers of rows that no row of the same or a later layer beats: ``layer`` from 1."""
    from helixmill.operators.lineage import cut

    out, rest = None, cut(df)
    for i in range(1, most + 1):
        front = skyline(rest, up, other_up).select(*df.columns)
        one = front.withColumn("layer", F.lit(i))
        out = one if out is None else out.unionByName(one)
        if i < most:
            rest = cut(rest.join(front, df.columns, "left_anti"))
    return out


def cascade(pool: DataFrame, stages: list[tuple[Callable[[DataFrame], DataFrame], int]]) -> DataFrame:
    """Each stage ranks the pool (``primer, score``) and keeps its best ``n``."""
    for rank, n in stages:
        best = rank(pool).orderBy(F.desc("score"), "primer").limit(n).select("primer")
        pool = pool.join(best, "primer", "left_semi")
    return pool


@register("hybrid")
def hybrid(incidence: DataFrame, background: DataFrame, size: int, wide: int = 2) -> DataFrame:
    """Cover with ``wide`` times the size, then drop what costs most background for its coverage."""
    picks = set_cover(incidence, size * wide).select("primer")
    cost = prune_order(incidence.join(picks, "primer", "left_semi"), background)
    return cost.orderBy("cost", F.desc("loss"), "primer").limit(size)


@register("background-aware")
def background_aware(incidence: DataFrame, background: DataFrame, size: int) -> DataFrame:
    """Cover weighted against background sites."""
    q = incidence.select("primer").distinct().join(background, "primer", "left").select("primer", (1 / (1 + F.coalesce("bg_sites", F.lit(0)))).alias("quality"))
    return set_cover(incidence, size, q)
