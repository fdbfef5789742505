"""The design pipeline: counts, candidates, scores, sets, each a DataFrame; and one call that runs a method by name."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.config import Config
from helixmill.functions import scores, thermo
from helixmill.operators import genomes, kmers, networks, pairs, selection, sites


@dataclass(frozen=True)
class Inputs:
    """Sequences ``genome, seq`` by role; all but the targets may be missing."""

    target: DataFrame
    background: DataFrame | None = None
    blacklist: DataFrame | None = None
    exclusion: DataFrame | None = None

    def all(self) -> DataFrame:
        out = None
        for role, name in enumerate(("target", "background", "blacklist", "exclusion")):
            one = getattr(self, name)
            if one is not None:
                one = one.select(F.col("genome").cast("string").alias("genome"), F.lit(role).alias("role"), "seq")
                out = one if out is None else out.unionByName(one)
        return out


def step1(inputs: Inputs, cfg: Config) -> DataFrame:
    """``role, k, kmer, n``."""
    return kmers.count(inputs.all(), list(range(cfg.min_k, cfg.max_k + 1)), deal=True)


def step2(counts: DataFrame, inputs: Inputs, cfg: Config) -> DataFrame:
    """The ``max_primer`` best candidates: ``primer, fg_count, bg_count, gini, ratio``."""
    seqs = inputs.all()
    role = lambda i: F.col("role") == i
    c = kmers.rates(counts, kmers.lengths(seqs, "role"), role(0), role(1), cfg.min_fg_freq, cfg.max_bg_freq).where("passes")
    if inputs.exclusion is not None:
        c = genomes.without(c, counts.where(role(3)))
    if inputs.blacklist is not None:
        c = genomes.blacklist(c, counts.where(role(2)), inputs.blacklist, 0.0).where("passes").drop("hits", "total")
    p = F.when(F.col("fg_count") > 0, F.col("kmer"))
    tm = thermo.effective_tm(p, cfg.na_conc, cfg.mg_conc, cfg.temperature)
    c = c.withColumn("primer", F.col("kmer")).withColumn("tm", tm).where(kmers.rule_reasons(p, F.col("tm"), cfg.min_tm, cfg.max_tm, cfg.gc_min, cfg.gc_max, cfg.max_self_dimer_bp).isNull())
    best = kmers.ranked(c, cfg.max_primer).select("primer", "fg_count", "bg_count", "ratio", "tm")
    where = sites.find_sites(inputs.target.select(F.col("genome").cast("string").alias("genome"), F.lit(0).alias("role"), "seq"), best, list(range(cfg.min_k, cfg.max_k + 1)), at_most=cfg.max_primer)
    g = sites.gini(sites.gaps(where, ["genome", "primer", "strand"]), ["genome", "primer", "strand"], "gap")
    strands = where.select("genome", "primer").distinct().join(g, ["genome", "primer"], "left").groupBy("genome", "primer").agg((F.coalesce(F.sum("gini"), F.lit(0.0)) / 2).alias("gini"))
    even = strands.groupBy("primer").agg(F.avg("gini").alias("gini"))
    return best.join(even, "primer", "left").withColumn("gini", F.coalesce("gini", F.lit(0.0))).where(F.col("gini") <= cfg.max_gini)


def step3(candidates: DataFrame) -> DataFrame:
    """Adds ``score``, the heuristic amplification score."""
    p = F.col("primer")
    return candidates.withColumn("score", scores.heuristic_score(p, thermo.vendored_tm(p)))


def all_sites(candidates: DataFrame, inputs: Inputs, cfg: Config) -> DataFrame:
    """Sites of the candidates in target and background: ``role, genome, primer, strand, pos``."""
    ks = list(range(cfg.min_k, cfg.max_k + 1))
    out = None
    for role, df in (("target", inputs.target), ("background", inputs.background)):
        if df is not None:
            one = sites.find_sites(df.select(F.col("genome").cast("string").alias("genome"), F.lit(0).alias("role"), "seq"), candidates, ks, at_most=cfg.max_primer).withColumn("role", F.lit(role))
            out = one if out is None else out.unionByName(one)
    return out


METHODS = (
    "dominating-set", "weighted-set-cover", "greedy", "network", "hybrid", "bg-prefilter", "background-aware", "tiling", "clique", "milp", "genetic", "moea", "normalized",
    "equiphi29", "coverage-then-dimerfree", "dimerfree-scored", "bg-prefilter-hybrid", "multi-agent",
)


def _names(where: DataFrame, names: list[str]) -> DataFrame:
    return where.sparkSession.createDataFrame([(p,) for p in names], "primer string")


def hybrid(inc: DataFrame, fg: DataFrame, bg: DataFrame, n: int, reach: int) -> DataFrame:
    """Cover with twice the primers, prune half of the surplus by background, refine the rest by its network."""
    wide = inc.join(selection.set_cover(inc, 2 * n).select("primer"), "primer", "left_semi")
    bins = max(1, inc.select("bin").distinct().count())
    pruned = networks.prune(wide, bg, n + n // 2, bins)
    return _names(inc, networks.refine(fg, pruned, n, reach))


def step4(method: str, scored: DataFrame, where: DataFrame, cfg: Config) -> DataFrame:
    """``primer`` of the chosen set, by the method's name."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}; known: {', '.join(METHODS)}")
    n = cfg.target_set_size
    reach = thermo.POLYMERASES[cfg.polymerase][1]
    fg = where.where("role = 'target'")
    bg = where.where("role = 'background'").groupBy("primer").agg(F.count("*").alias("bg_sites"))
    inc = sites.bins_of(fg, ["primer", "genome"], reach, cfg.bin_size).select("primer", F.concat_ws(":", "genome", F.col("bin").cast("string")).alias("bin"))
    table = lambda pool: pairs.dimer_table(pool.select("primer"), cfg.max_dimer_bp)
    first = lambda sets: sets.limit(1).select(F.explode("members").alias("primer"))
    counts = where.groupBy("primer").agg(F.count_if(F.col("role") == "target").alias("fg_sites"), F.count_if(F.col("role") == "background").alias("bg_sites"))
    clean = lambda pool: first(selection.best_ratio(selection.dimer_free_sets(pool.select("primer"), table(pool), n), counts))
    by_score = lambda pool: pool.select("primer").join(scored.select("primer", "score"), "primer")
    gain = lambda pool: selection.best_gain(inc.join(pool.select("primer"), "primer", "left_semi"), None).withColumnRenamed("gain", "score")
    if method == "dominating-set":
        return selection.set_cover(inc, n).select("primer")
    if method == "weighted-set-cover":
        return selection.set_cover(inc, n, scored.select("primer", (F.col("score") / 20).alias("quality"))).select("primer")
    if method == "greedy":
        return first(selection.beam(scored.select("primer", "score"), table(scored), n))
    if method == "equiphi29" and cfg.polymerase != "equiphi29":  # the preset of that enzyme, then as hybrid
        return step4("hybrid", scored, where, Config.for_polymerase("equiphi29", target_set_size=n, bin_size=cfg.bin_size))
    if method in ("hybrid", "equiphi29"):
        return hybrid(inc, fg, bg, n, reach)
    if method == "bg-prefilter":
        return _names(inc, networks.prune(inc, bg, n, max(1, inc.select("bin").distinct().count())))
    if method == "background-aware":
        return selection.background_aware(inc, bg, n).select("primer")
    if method == "tiling":
        picks = selection.tiling(fg, bg, reach, -(-n // 2)).groupBy("primer").agg(F.min("step").alias("step"), F.max("gain").alias("gain"))
        return picks.orderBy("step", F.desc("gain"), "primer").limit(n).select("primer")
    if method == "network":
        own = where.select("genome", "primer", "strand", "pos", "role")
        return _names(where, networks.network(own.where("role = 'target'").drop("role"), own.where("role = 'background'").drop("role"), n, reach))
    if method in ("clique", "coverage-then-dimerfree"):
        pool = selection.cascade(scored, [(gain, 4 * n)])
        return clean(pool)
    if method == "dimerfree-scored":
        pool = selection.cascade(scored, [(by_score, 4 * n)])
        return clean(pool)
    if method == "bg-prefilter-hybrid":
        pool = networks.prune(inc, bg, 4 * n, max(1, inc.select("bin").distinct().count()))
        keep = F.col("primer").isin(pool)
        return hybrid(inc.where(keep), fg.where(keep), bg, n, reach)
    if method == "milp":
        if len(networks.pool_names(inc, 10 * networks.POOL)) > networks.POOL:  # too many for an exact search
            return step4("network", scored, where, cfg)
        return exact_cover(inc, n, table(inc.select("primer").distinct()))
    if method == "genetic":
        return first(selection.genetic(scored.select("primer", "score"), table(scored), n, seed=cfg.seed))
    if method == "moea":
        c = scored.select("primer", "score").join(bg, "primer", "left").select("primer", "score", (-F.coalesce("bg_sites", F.lit(0))).alias("clean"))
        return selection.layers(c, "score", "clean", 5).orderBy("layer", F.desc("score"), "primer").limit(n).select("primer")
    if method == "normalized":
        size = networks.component_sizes(networks.named(fg), ["primer", "genome"], reach).groupBy("primer").agg(F.max("size").alias("largest"), F.sum("size").alias("sites"))
        m = selection.best_gain(inc, None).join(size, "primer", "left").join(bg, "primer", "left").join(inc.agg(F.countDistinct("bin").alias("bins")).hint("broadcast")).select("primer", (F.col("gain") / F.col("bins")).alias("coverage"), F.coalesce(F.col("largest") / F.col("sites"), F.lit(0.0)).alias("connectivity"), F.col("gain").alias("amplification"), F.coalesce("bg_sites", F.lit(0)).alias("background"))
        return selection.normalized(m).orderBy(F.desc("score"), "primer").limit(n).select("primer")
    # multi-agent: several methods, the set that covers most bins
    best, most = None, -1
    for name in ("dominating-set", "hybrid", "background-aware"):
        got = step4(name, scored, where, cfg)
        n_bins = inc.join(got, "primer", "left_semi").select("bin").distinct().count()
        if n_bins > most:
            best, most = got, n_bins
    return best


def exact_cover(incidence: DataFrame, n: int, dimers: DataFrame | None = None, most_steps: int = 2_000_000) -> DataFrame:
    """The set of ``n`` candidates without a dimer that covers most bins, by branch and bound at the driver.

    The pool is checked (:data:`networks.POOL`); a search that is stopped after
    ``most_steps`` warns that its set is good but not proven best.
    """
    networks.pool_names(incidence)
    rows = incidence.groupBy("primer").agg(F.collect_set("bin").alias("bins")).collect()
    place = {b: i for i, b in enumerate(sorted({b for r in rows for b in r["bins"]}))}
    masks = sorted(((sum(1 << place[b] for b in r["bins"]), r["primer"]) for r in rows), key=lambda x: (-x[0].bit_count(), x[1]))
    bad: dict[str, set[str]] = {}
    for r in dimers.where("dimer").collect() if dimers is not None else []:  # pairs of the checked pool
        bad.setdefault(r["a"], set()).add(r["b"])
        bad.setdefault(r["b"], set()).add(r["a"])
    best: tuple[int, list[str]] = (0, [])
    stack: list[tuple[int, int, tuple[str, ...]]] = [(0, 0, ())]
    steps = 0
    while stack and steps < most_steps:
        i, covered, chosen = stack.pop()
        steps += 1
        if covered.bit_count() > best[0]:
            best = (covered.bit_count(), list(chosen))
        left = n - len(chosen)
        if not left or i == len(masks):
            continue
        # masks fall in size, so the next ``left`` of them bound what can still be won
        if covered.bit_count() + sum(m.bit_count() for m, _ in masks[i : i + left]) <= best[0]:
            continue
        m, p = masks[i]
        stack.append((i + 1, covered, chosen))
        if not bad.get(p, set()) & set(chosen):
            stack.append((i + 1, covered | m, (*chosen, p)))
    if stack:
        warnings.warn(f"stopped after {most_steps} steps: the set is not proven best", stacklevel=2)
    return incidence.sparkSession.createDataFrame([(p,) for p in best[1]], "primer string")


def set_report(chosen: DataFrame, where: DataFrame, lengths: DataFrame, cfg: Config) -> DataFrame:
    """One row: coverage by processivity and by reach, selectivity, evenness, dimer risk, Tm range, composite score.

    ``lengths`` has ``genome, length`` of the targets.  Positions stay in their genomes.
    """
    process, reach = thermo.POLYMERASES[cfg.polymerase][:2]
    own = where.join(F.broadcast(chosen.select("primer").distinct()), "primer", "left_semi")
    fg = own.where("role = 'target'").join(F.broadcast(lengths), "genome")
    share = lambda by, name: sites.coverage(fg, ["genome"], by, F.col("length")).agg(F.sum("covered").alias("c")).join(lengths.agg(F.sum("length").alias("l"))).select((F.coalesce(F.col("c"), F.lit(0)) / F.col("l")).alias(name))
    place = F.struct("genome", "pos")
    sel = own.agg((F.countDistinct(F.when(F.col("role") == "target", place)) / F.greatest(F.countDistinct(F.when(F.col("role") == "background", place)), F.lit(1))).alias("selectivity"))
    even = sites.gini(sites.gaps(fg.select("genome", "pos").distinct(), ["genome"]), ["genome"], "gap").agg(F.coalesce(F.avg("gini"), F.lit(1.0)).alias("gap_gini"))
    risk = pairs.dimer_table(chosen, cfg.max_dimer_bp).agg(F.coalesce(F.avg(F.col("dimer").cast("int")), F.lit(0.0)).alias("dimer_risk"))
    tm = chosen.select(thermo.tm_salt(F.col("primer")).alias("t")).agg(F.min("t").alias("tm_min"), F.max("t").alias("tm_max"), F.count("*").alias("size"))
    one = share(process, "coverage").join(share(reach, "reach_coverage")).join(sel).join(even).join(risk).join(tm)  # one row each
    return one.withColumn("score", scores.set_score(F.col("coverage"), F.col("selectivity"), F.col("dimer_risk"), F.col("gap_gini"), F.col("tm_max") - F.col("tm_min")))


def run_optimization(method: str, inputs: Inputs, cfg: Config | None = None) -> tuple[DataFrame, DataFrame]:
    """Steps one to four: the chosen set and its report."""
    cfg = cfg or Config()
    found = step3(step2(step1(inputs, cfg), inputs, cfg)).persist()
    where = all_sites(found, inputs, cfg)
    chosen = step4(method, found, where, cfg)
    lengths = inputs.target.groupBy(F.col("genome").cast("string").alias("genome")).agg(F.sum(F.length("seq")).alias("length"))
    return chosen, set_report(chosen, where, lengths, cfg)
