"""Wide feature table of candidates, and a forest trained on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.functions import conditions, seq, thermo
from helixmill.functions.conditions import Conditions
from helixmill.operators import quality, sites

# Motifs whose share among a primer's k-mers is a feature.
MOTIFS = "AA TT GG CC AT TA GC CG AAA TTT GGG CCC ATC TAG GCA CGT AAAA TTTT ATCG CGAT".split()


def _share(top: Column, bottom: Column, none: float = 0.0) -> Column:
    return F.when(bottom != 0, top / bottom).otherwise(none)


def composition(s: Column) -> dict[str, Column]:
    n = F.length(s)
    count = {b: seq.count_base(s, b) for b in seq.BASES}
    run = {b: seq.longest_run(s, b) for b in seq.BASES}
    gc = count["G"] + count["C"]
    quarter = F.floor(n / 4).cast("int")
    middle = F.substring(s, quarter + 1, F.floor(3 * n / 4).cast("int") - quarter)
    window = lambda part: F.when(n >= 5, seq.gc_count(part) / 5).otherwise(0.0)
    return {
        "length": n.cast("double"), **{f"{b.lower()}_count": count[b] for b in seq.BASES}, "gc_content": gc / n, "at_content": 1 - gc / n, "purine_content": (count["A"] + count["G"]) / n, "pyrimidine_content": (count["C"] + count["T"]) / n,
        "longest_homopolymer": F.greatest(*run.values()), "longest_a_run": run["A"], "longest_g_run": run["G"], "gc_content_5prime": window(F.substring(s, 1, 5)), "gc_content_3prime": window(F.right(s, F.lit(5))),
        "gc_content_middle": F.when(n >= 8, seq.gc_count(middle) / F.floor(n / 2)).otherwise(0.0), "gc_skew": _share(count["G"] - count["C"], gc), "at_skew": _share(count["A"] - count["T"], count["A"] + count["T"]),
        "gc_clamp": seq.gc_last(s, 5), "purine_pyrimidine_ratio": _share(count["A"] + count["G"], count["C"] + count["T"], float("inf")),
    }


def thermodynamics(s: Column, c: Conditions) -> dict[str, Column]:
    n, dg = F.length(s), thermo.free_energy(s, c.celsius)
    tm = conditions.effective_tm(s, c)
    h, e = thermo.enthalpy(s), thermo.entropy(s)
    bound = lambda t: thermo.binding_probability(thermo.free_energy(s, t), t)
    return {
        "tm_base": thermo.tm_salt(s, c.na, c.mg), "tm_effective": tm, "tm_margin": tm - c.celsius, "dg_37c": thermo.free_energy(s, 37.0), "dg_reaction_temp": dg, "enthalpy": h, "entropy": e,
        "binding_prob_reaction": bound(c.celsius), "binding_prob_room": bound(25.0), "binding_prob_cold": bound(4.0), "tm_sensitivity": -e / 1000, "enthalpy_per_bp": h / n, "entropy_per_bp": e / n, "dg_per_bp": dg / n,
    }


def complexity(s: Column) -> dict[str, Column]:
    entropy, variety = seq.base_entropy(s), seq.linguistic_complexity(s)
    return {"shannon_entropy": entropy, "linguistic_complexity": variety, "dinucleotide_diversity": seq.kmer_diversity(s, 2), "normalized_entropy": entropy / 2, "complexity_score": (entropy + variety) / 2}


def motifs(s: Column) -> dict[str, Column]:
    """Share of each motif among the k-mers of its length."""
    return {f"freq_{len(m)}mer_{m}": F.when(F.length(s) >= len(m), F.size(F.filter(seq.kmers(s, len(m)), lambda x: x == m)) / (F.length(s) - len(m) + 1)).otherwise(0.0) for m in MOTIFS}


def of_sequence(candidates: DataFrame, c: Conditions = Conditions()) -> DataFrame:
    """``primer`` with 58 features that follow from its bases and the conditions."""
    s = F.col("primer")
    every = composition(s) | thermodynamics(s, c) | complexity(s) | motifs(s)
    return candidates.select("primer", *[v.cast("double").alias(k) for k, v in every.items()])


def of_sites(where: DataFrame, length: int, reach: int = 3000) -> DataFrame:
    """``primer`` with features of its sites in one genome of ``length``: counts, gaps on the forward strand, evenness, coverage."""
    fwd = where.where("strand = '+'")
    gap = sites.gaps(fwd, ["primer"])
    g = gap.groupBy("primer").agg(F.avg("gap").alias("mean_forward_gap"), F.stddev_pop("gap").alias("std_forward_gap"), F.min("gap").alias("min_forward_gap"), F.max("gap").alias("max_forward_gap"), F.median("gap").alias("median_forward_gap"), F.skewness("gap").alias("gap_skewness"))
    small = gap.withColumn("mean", F.avg("gap").over(Window.partitionBy("primer"))).groupBy("primer").agg(F.avg((F.col("gap") < F.col("mean") / 2).cast("int")).alias("clustering_coefficient"))
    n = where.groupBy("primer").agg(F.count("*").alias("total_binding_sites"), F.count_if(F.col("strand") == "+").alias("forward_site_count"), F.count_if(F.col("strand") == "-").alias("reverse_site_count"))
    even = sites.gini(gap, ["primer"], "gap", 0.0).select("primer", F.col("gini").alias("gini_index"))
    near = sites.nearest_opposite(where.withColumn("site", F.xxhash64("primer", "strand", "pos")), ["primer"]).groupBy("primer").agg(F.avg("distance").alias("mean_nearest_opposite_distance"))
    cover = sites.coverage(where, ["primer"], reach, F.lit(length)).select("primer", F.col("coverage").alias("coverage_fraction"))
    spread = quality.positional_entropy(where, ["primer"], length).select("primer", F.col("entropy").alias("positional_entropy"))
    out = n
    for other in (g, small, even, near, cover, spread):
        out = out.join(other, "primer", "left")
    total = F.col("total_binding_sites")
    out = out.withColumn("binding_frequency", total / length).withColumn("sites_per_100kb", total / length * 100_000).withColumn("gap_cv", _share(F.col("std_forward_gap"), F.col("mean_forward_gap")))
    return out.withColumn("mean_nearest_opposite_distance", F.coalesce("mean_nearest_opposite_distance", F.lit(float(length)))).fillna(0)


def forest(rows: DataFrame, label: str, trees: int = 100, depth: int = 8, seed: int = 42):
    """A random forest on all numeric columns but ``label``: the fitted pipeline, to be saved and loaded by its own means."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import SQLTransformer, VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    names = [c for c, t in rows.dtypes if c != label and t in ("int", "bigint", "double", "float")]
    # trees take finite numbers only: what is missing is 0, what is infinite the bound
    finite = ", ".join(f"greatest(-1e9D, least(1e9D, coalesce(nanvl(cast(`{c}` as double), 0D), 0D))) AS `x_{c}`" for c in names)
    stages = [SQLTransformer(statement=f"SELECT *, {finite} FROM __THIS__"), VectorAssembler(inputCols=[f"x_{c}" for c in names], outputCol="features"), RandomForestRegressor(labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)]
    return Pipeline(stages=stages).fit(rows)


def held_out_error(rows: DataFrame, label: str, key: str = "primer", **kw) -> dict[str, float]:
    """Root mean square error on the fifth of rows that a hash of the key holds out, of a forest and of the mean."""
    out = F.pmod(F.xxhash64(key), F.lit(5)) == 0
    train, test = rows.where(~out), rows.where(out)
    mean = train.agg(F.avg(label).alias("m")).first()["m"]
    e = forest(train, label, **kw).transform(test).agg(F.sqrt(F.avg(F.pow(F.col("prediction") - F.col(label), 2))).alias("forest"), F.sqrt(F.avg(F.pow(F.col(label) - mean, 2))).alias("mean")).first()
    return e.asDict()
