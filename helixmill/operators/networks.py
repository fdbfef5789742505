"""Selection by amplification networks, and edits of sets that exist.

A network's nodes are sites; edges join opposite strands within reach, so its
components are runs along the sequence (:func:`helixmill.operators.sites.components`).
A round of a greedy search judges all candidates in one plan: the sites of the
set so far are held beside those of each candidate, under the candidate's name,
and all components are found in the same windows.  Candidates are a pool that
the step before has cut (500 by default), which is checked; only the pick comes
to the driver.

Sites are rows ``genome, primer, strand, pos`` and a ``site`` that names them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.functions import scores
from helixmill.operators import pairs as pair_ops
from helixmill.operators import selection, sites
from helixmill.operators.lineage import cut

POOL = 500


def pool_names(candidates: DataFrame, most: int = POOL) -> list[str]:
    """The sorted names of a pool; more than ``most`` stop the search."""
    rows = candidates.select("primer").distinct().orderBy("primer").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} candidates; rank and limit them first")
    return [r["primer"] for r in rows]


def by_foreground(counts: DataFrame, most: int = POOL) -> DataFrame:
    """The ``most`` primers with most foreground sites; ties by name, the last first."""
    return counts.orderBy(F.desc("fg_sites"), F.desc("primer")).limit(most)


def by_selectivity(counts: DataFrame, most: int = POOL) -> DataFrame:
    """The ``most`` primers with the greatest ``fg / (bg + 1)``; ties by name, the last first."""
    return counts.withColumn("selectivity", F.col("fg_sites") / (F.col("bg_sites") + 1)).orderBy(F.desc("selectivity"), F.desc("primer")).limit(most)


def named(where: DataFrame) -> DataFrame:
    return where.withColumn("site", F.xxhash64("genome", "primer", "strand", "pos"))


def component_sizes(where: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """``keys, component, size, first, last`` per component."""
    c = sites.components(where, keys, reach)
    return c.groupBy(*keys, "component").agg(F.count("*").alias("size"), F.min("pos").alias("first"), F.max("pos").alias("last"))


def _beside(where: DataFrame, picks: list[str]) -> DataFrame:
    """Sites of each further candidate with those of the picks, under the candidate's name ``cand``."""
    rest = where.where(~F.col("primer").isin(picks)) if picks else where
    own = rest.withColumn("cand", F.col("primer"))
    if not picks:
        return own
    names = rest.select(F.col("primer").alias("cand")).distinct()
    chosen = where.where(F.col("primer").isin(picks))
    return own.unionByName(chosen.join(F.broadcast(names)).select(*where.columns, "cand"))  # names: the checked pool


def _best(scored: DataFrame) -> str | None:
    top = scored.orderBy(F.desc("score"), "cand").limit(1).collect()
    return top[0]["cand"] if top else None


@selection.register("network")
def network(fg: DataFrame, bg: DataFrame, rounds: int, reach: int, factor: DataFrame | None = None, fixed: tuple[str, ...] = ()) -> list[str]:
    """Picks, round by round, the primer with the greatest growth of the largest target component per growth of the mean background component, plus one.

    ``factor`` (``primer, factor``) weighs candidates, e.g. by Tm or by
    :func:`dimer_factor`; ``fixed`` primers are in the network from the start.
    """
    fg, bg = cut(named(fg)), cut(named(bg))
    pool_names(fg)
    picks, had_f, had_b = list(fixed), 0.0, 0.0
    while len(picks) - len(fixed) < rounds:
        f = component_sizes(_beside(fg, picks), ["cand", "genome"], reach).groupBy("cand").agg(F.max("size").alias("f"))
        b = component_sizes(_beside(bg, picks), ["cand", "genome"], reach).groupBy("cand").agg(F.avg("size").alias("b"))
        s = f.join(b, "cand", "left").withColumn("b", F.coalesce("b", F.lit(had_b)))
        score = (F.col("f") - had_f) / (F.col("b") - had_b + 1)
        if factor is not None:
            s, score = s.join(factor.withColumnRenamed("primer", "cand"), "cand", "left"), score * F.coalesce("factor", F.lit(1.0))
        best = s.select("cand", "f", "b", score.alias("score")).orderBy(F.desc("score"), "cand").limit(1).collect()
        if not best:
            break
        picks.append(best[0]["cand"])
        had_f, had_b = float(best[0]["f"]), float(best[0]["b"])
    return picks


def refine(fg: DataFrame, members: list[str], size: int, reach: int, fixed: tuple[str, ...] = ()) -> list[str]:
    """Drops, one after another, the primer without which the largest component predicts the greatest fold; ties by name.

    All drops of a round are judged in one plan, a copy of the sites for each.
    """
    fg, left = cut(named(fg.where(F.col("primer").isin(list(members))))), list(members)
    while len(left) > size and [p for p in left if p not in fixed]:
        out = F.explode(F.array(*[F.lit(p) for p in left if p not in fixed])).alias("cand")
        without = fg.where(F.col("primer").isin(left)).select("*", out).where(F.col("primer") != F.col("cand"))
        largest = component_sizes(without, ["cand", "genome"], reach).groupBy("cand").agg(F.max("size").alias("largest"))
        gone = _best(largest.select("cand", scores.fold(F.col("largest")).alias("score")))
        if gone is None:
            break
        left.remove(gone)
    return left


def prune(incidence: DataFrame, background: DataFrame, size: int, bins: int, least: float = 0.0) -> list[str]:
    """Drops again and again what has most background sites for the coverage lost without it, while the share of ``bins`` stays at ``least`` or more."""
    inc = cut(incidence.select("primer", "bin").distinct())
    left = pool_names(inc)
    while len(left) > size:
        now = inc.where(F.col("primer").isin(left))
        have = now.select("bin").distinct().count()
        loss = selection.leave_one_out(now).select("primer", "loss").join(background, "primer", "left")
        sites_ = F.coalesce("bg_sites", F.lit(0))
        cost = F.when(F.col("loss") > 0, sites_ / (F.col("loss") / bins)).otherwise(sites_ * 1000.0)
        top = loss.where((have - F.col("loss")) / bins >= least).select("primer", cost.alias("cost")).orderBy(F.desc("cost"), "primer").limit(1).collect()
        if not top:
            break
        left.remove(top[0]["primer"])
    return left


def minimal(where: DataFrame, quality: DataFrame, length: int, coverage: float = 0.7, most: int = 20, weight: float = 0.3) -> DataFrame:
    """Fewest primers up to a share of positions: ``step, primer, gain``; gain and ``quality`` (``primer, quality``) are weighed against each other."""
    inc = cut(where.select("primer", F.concat_ws(":", "genome", F.col("pos").cast("string")).alias("bin")).distinct())
    picks: list[tuple[int, str, int]] = []
    have = 0
    while len(picks) < most and have / length < coverage:
        covered = inc.where(F.col("primer").isin([p for _, p, _ in picks])).select("bin").distinct() if picks else None
        g = selection.best_gain(inc, covered).where("gain > 0").join(quality, "primer")
        top = g.select("primer", "gain", ((1 - weight) * F.col("gain") / length + weight * F.col("quality")).alias("score")).orderBy(F.desc("score"), "primer").limit(1).collect()
        if not top:
            break
        have += top[0]["gain"]
        picks.append((len(picks) + 1, top[0]["primer"], top[0]["gain"]))
    return where.sparkSession.createDataFrame(picks, "step int, primer string, gain long")


def amplicon_cover(where: DataFrame, rounds: int, reach: int) -> list[str]:
    """Picks, round by round, the primer with which components of two sites or more span most bases."""
    where = cut(named(where))
    pool_names(where)
    picks: list[str] = []
    while len(picks) < rounds:
        span = component_sizes(_beside(where, picks), ["cand", "genome"], reach).where("size > 1").groupBy("cand").agg(F.sum(F.col("last") - F.col("first") + 1).alias("score"))
        best = _best(span)
        if best is None:
            break
        picks.append(best)
    return picks


def expand(incidence: DataFrame, fixed: list[str], rounds: int, failed: list[str] = ()) -> DataFrame:
    """Greedy cover of what ``fixed`` primers leave open, without the ``failed``: ``step, primer, gain``."""
    covered = incidence.where(F.col("primer").isin(list(fixed))).select("bin").distinct()
    left = incidence.join(covered, "bin", "left_anti").where(~F.col("primer").isin([*fixed, *failed]))
    return selection.set_cover(cut(left), rounds)


def coverage_of(incidence: DataFrame, members: list[str]) -> int:
    return incidence.where(F.col("primer").isin(list(members))).select("bin").distinct().count()


def swap(incidence: DataFrame, members: list[str], old: str) -> list[str]:
    """The set with ``old`` replaced by the candidate that covers most of what is open without it; unchanged if that covers less."""
    kept = [p for p in members if p != old]
    best = expand(incidence, kept, 1, failed=[old]).collect()
    new = [*kept, best[0]["primer"]] if best else list(members)
    return new if coverage_of(incidence, new) >= coverage_of(incidence, members) else list(members)


def contract(incidence: DataFrame, members: list[str], size: int) -> list[str]:
    """Drops what loses fewest bins, one after another, down to ``size``; ties by name."""
    left = list(members)
    while len(left) > size:
        loss = selection.leave_one_out(incidence.where(F.col("primer").isin(left))).select("primer", "loss")
        known = {r["primer"]: r["loss"] for r in loss.collect()}  # one row per member
        left.remove(min(left, key=lambda p: (known.get(p, 0), p)))
    return left


def mean_severity() -> Column:
    return F.coalesce(F.avg("severity"), F.lit(0.0))


def replace_dimers(members: list[str], pool: DataFrame, rounds: int = 5, hub: int = 3, threshold: float = 0.3) -> tuple[list[str], float]:
    """Swaps the worst primer of a set for the candidate with the least mean severity to the others, while that lowers the mean severity.

    Returns the set and its mean severity.
    """
    spark = pool.sparkSession
    pool_names(pool)
    table = lambda ps: pair_ops.dimer_table(spark.createDataFrame([(p,) for p in ps], "primer string"))
    now = list(members)
    score = table(now).agg(mean_severity().alias("m")).first()["m"]
    for _ in range(rounds):
        p = pair_ops.profiles(table(now), threshold, hub)
        worst = p.where("degree > 0").orderBy(F.desc(pair_ops.replacement_rank(p)), "primer").limit(1).collect()
        if not worst:
            break
        others = [x for x in now if x != worst[0]["primer"]]
        other = F.explode(F.array(*map(F.lit, others))).alias("other")
        cand = pool.select("primer").distinct().where(~F.col("primer").isin(now)).select("primer", other)
        s = cand.groupBy("primer").agg(F.avg(pair_ops.severity(F.col("primer"), F.col("other"))).alias("s"))
        best = s.orderBy("s", "primer").limit(1).collect()
        if not best:
            break
        new = [*others, best[0]["primer"]]
        after = table(new).agg(mean_severity().alias("m")).first()["m"]
        if after >= score - 1e-9:
            break
        now, score = new, after
    return now, score


def best_k(candidates: DataFrame) -> DataFrame:
    """One row per length of ``primer, ratio, fg_count, bg_count, tm, gc``: size, means, and a score; the best first."""
    g = candidates.groupBy(F.length("primer").alias("k")).agg(F.count("*").alias("n"), F.avg("ratio").alias("mean_ratio"), F.avg("tm").alias("mean_tm"), F.avg("gc").alias("mean_gc"), F.sum("fg_count").alias("fg_sites"))
    return g.withColumn("score", F.log1p("mean_ratio") * F.log1p("n")).orderBy(F.desc("score"), "k")


def enrichment(where: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """Per set (``keys``): largest target and mean background component, predicted folds with their intervals, and the enrichment with its own.

    ``where`` has ``role`` (``target`` or ``background``); evenness is that of the gaps of each role.
    """
    where = named(where)
    by = [*keys, "role", "genome"]
    comp = component_sizes(where, by, reach).groupBy(*keys, "role").agg(F.max("size").alias("largest"), F.avg("size").alias("mean"), F.sum("size").alias("n"))
    even = sites.gini(sites.gaps(where.select(*by, "pos").distinct(), by), by, "gap").groupBy(*keys, "role").agg(F.avg("gini").alias("gini"))
    c = comp.join(even, [*keys, "role"], "left").withColumn("i", scores.fold_interval(F.col("n"), F.col("largest"), F.coalesce("gini", F.lit(0.0))))
    of = lambda role, x: F.max(F.when(F.col("role") == role, x))
    g = c.groupBy(*keys).agg(
        of("target", F.col("largest")).alias("target_largest"), of("background", F.col("mean")).alias("background_mean"),
        *[of("target", F.col(f"i.{x}")).alias(f"target_{x}") for x in ("fold", "lower", "upper")], *[of("background", F.col(f"i.{x}")).alias(f"background_{x}") for x in ("fold", "lower", "upper")],
    )
    low = lambda x: F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(1.0))
    ratio = lambda a, b: F.col(f"target_{a}") / low(F.col(f"background_{b}"))
    return g.select("*", ratio("fold", "fold").alias("enrichment"), ratio("lower", "upper").alias("enrichment_lower"), ratio("upper", "lower").alias("enrichment_upper"))


def new_pairs(old: DataFrame, new: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """Band join of only the pairs that new sites bring: new with all, and old forward with new reverse."""
    f, r = F.col("strand") == "+", F.col("strand") == "-"
    both = old.unionByName(new)
    return sites.band_join(new.where(f), both.where(r), keys, reach).unionByName(sites.band_join(old.where(f), new.where(r), keys, reach))
