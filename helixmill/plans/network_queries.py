"""Queries on conditions, structure, networks and edits of sets."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.functions import conditions, scores, seq, thermo
from helixmill.functions.conditions import Conditions
from helixmill.operators import features, kmers, networks, pairs, quality, selection, sites
from helixmill.plans.queries import POOL, SEQ, SITES, can, cand, candidates, cnt, gc_sql, is_background, line_sites, nn_sql, query, r, rc, sequences, tm_salt_sql, top_candidates, top_sql, win
from helixmill.plans.set_queries import REACH, run_sql

MIX = Conditions(celsius=34.0, mg=2.0, dmso=5.0, betaine=1.0, trehalose=0.3)
GC = 0.58


# --- conditions ------------------------------------------------------------
def _equalised_sql(p: str, c: Conditions) -> str:
    share = sum(1 / (1 + math.exp(-1.5 * (getattr(c, k) - v / 3))) for k, v in thermo.EQUALISED.items() if getattr(c, k) > 0)
    return f"(-2.0 * len({p}) * ({gc_sql(p)} - 0.5) * {share!r})"


def _tm_sql(p: str, c: Conditions) -> str:
    na = thermo.monovalent(c.na, c.mg)
    return tm_salt_sql(p).replace(repr(math.log(0.05)), repr(math.log(na)))


def _effects_sql() -> str:
    open_, e = conditions.accessibility(MIX, GC), conditions.enzyme(MIX, GC)
    boost = (1 + 0.10 * MIX.betaine) * (1 + 0.02 * MIX.dmso) * conditions.interaction(MIX, "kon", GC)
    release = (1 + 0.05 * MIX.betaine) * (1 + 0.03 * MIX.dmso) * conditions.interaction(MIX, "koff", GC)
    tm = f"({_tm_sql('primer', MIX)} + ({thermo.additive_term(MIX.celsius, **MIX.additives())!r} + {_equalised_sql('primer', MIX)}) * {conditions.interaction(MIX, 'tm', GC)!r})"
    return f"""{cand(8)}, t AS (SELECT primer, {tm} AS tm FROM c), d AS (SELECT *, tm - {MIX.celsius!r} AS delta, exp(-0.5 * ((tm - {MIX.celsius!r} - 7.0) / 5.0) ** 2) AS bell FROM t),
b AS (SELECT *, greatest(0.0, least(1.0, bell * bell * {boost * open_!r})) AS binding FROM d)
SELECT primer, round(tm, 6) AS effective_tm, round(bell * {boost!r}, 6) AS kon, round(exp(CASE WHEN delta > 0 THEN -0.1 ELSE -0.2 END * delta) * {release!r}, 4) AS koff, round(binding, 6) AS binding,
round(greatest(0.0, least(1.0, binding * {e['speed'] * e['processivity'] * open_!r})), 6) AS amplification FROM b"""


@query(_effects_sql())
def mechanistic_effects(spark, d):
    e = candidates(spark, d).select("primer", conditions.effects(F.col("primer"), MIX, GC).alias("e"))
    return e.select("primer", r(F.col("e.effective_tm")).alias("effective_tm"), r(F.col("e.kon")).alias("kon"), r(F.col("e.koff"), 4).alias("koff"), r(F.col("e.binding")).alias("binding"), r(F.col("e.amplification")).alias("amplification"))


_FIXED = sum(thermo.ADDITIVES[k][0] * v for k, v in MIX.additives().items())
_H, _E = nn_sql("primer")
_LENGTHS = [("> 0.7", 0.75), ("> 0.6", 0.65), ("< 0.3", 0.25), ("< 0.4", 0.35)]


@query(f"""{cand(8)}, t AS (SELECT primer, {gc_sql('primer')} AS gc, {_H} - 310.15 * {_E} / 1000 AS dg, {tm_salt_sql('primer')} AS tm FROM c)
SELECT primer, round({_FIXED!r} + {_equalised_sql('primer', MIX)}, 6) AS legacy, len(primer) BETWEEN 6 AND CASE {' '.join(f'WHEN gc {k} THEN {conditions.max_length(MIX, v)}' for k, v in _LENGTHS)} ELSE {conditions.max_length(MIX, 0.5)} END AS safe,
round((1000 * dg + 310.15 * -22.0 * len(primer)) / (-22.0 * len(primer) + {thermo.R * math.log(0.5e-6 / 4)!r}) - 273.15 + {thermo.salt_term()!r}, 6) AS rough_tm, round(tm - 2, 6) AS tm_low, round(tm + 2, 6) AS tm_high FROM t""")
def condition_columns(spark, d):
    p = F.col("primer")
    span = conditions.tm_range(p)
    return candidates(spark, d).select("primer", r(conditions.legacy_correction(p, MIX)).alias("legacy"), conditions.length_is_safe(p, MIX).alias("safe"), r(conditions.energy_to_tm(thermo.free_energy(p), F.length(p))).alias("rough_tm"), r(span["low"]).alias("tm_low"), r(span["high"]).alias("tm_high"))


# --- structure and quality -------------------------------------------------
def _pool_pairs(spark, d) -> DataFrame:
    return pairs.candidate_pairs(top_candidates(spark, d, POOL))


PAIRS = f"{top_sql(POOL)}, p AS (SELECT x.primer AS a, y.primer AS b FROM top x JOIN top y ON x.primer < y.primer)"
_X, _Y = "right(a, 5)", rc("right(b, 5)")
_PAIRED = f"list_filter(range(1, 6), lambda i: ({_X})[i] = translate(({_Y})[i], 'ACGT', 'TGCA'))"
_FROM_END = f"coalesce(list_min(list_filter(range(1, 6), lambda i: ({_X})[6 - i] <> translate(({_Y})[6 - i], 'ACGT', 'TGCA'))), 6)"


@query(f"{PAIRS}, e AS (SELECT a, b, len({_PAIRED}) AS n, {_FROM_END} AS gap FROM p) SELECT a, b, greatest([0.0, 0.1, 0.3, 0.6, 1.0, 1.0][n + 1], CASE WHEN gap > 3 THEN 0.9 WHEN gap > 2 THEN 0.5 ELSE 0 END)::DOUBLE AS risk FROM e")
def extension_risk(spark, d):
    return _pool_pairs(spark, d).select("a", "b", quality.extension_risk(F.col("a"), F.col("b")).alias("risk"))


_RUNS = f"list_filter(flatten(list_transform(range(1, len(a) + 1), lambda i: list_transform(range(1, len(a) - i + 2), lambda k: {{'k': -k, 'i': i, 's': a[i:i + k - 1]}}))), lambda x: contains({rc('b')}, x.s))"
_RH, _RE = nn_sql("run")


@query(f"{PAIRS}, e AS (SELECT a, b, coalesce(list_min({_RUNS}).s, '') AS run FROM p) SELECT a, b, CASE WHEN len(run) < 2 THEN false ELSE {_RH} - 310.15 * {_RE} / 1000 <= -3.0 END AS dimer FROM e")
def thermodynamic_dimers(spark, d):
    """Candidates of eight bases: a limit that fits their energies."""
    return _pool_pairs(spark, d).select("a", "b", quality.thermodynamic_dimer(F.col("a"), F.col("b"), -3.0).alias("dimer"))


@query(f"{cand(8)}, t AS (SELECT primer, {tm_salt_sql('primer')} AS tm FROM c) SELECT primer, round(CASE WHEN tm < 45 THEN greatest(0.0, tm / 45) WHEN tm > 60 THEN greatest(0.0, 1 - (tm - 60) / 20) ELSE 1 END, 6) AS thermal, round(len(list_distinct(list_transform(range(1, len(primer) - 2), lambda i: primer[i:i + 3])))::DOUBLE / (len(primer) - 3), 6) AS complexity FROM t")
def quality_dimensions(spark, d):
    p = F.col("primer")
    return candidates(spark, d).select("primer", r(quality.thermal_score(thermo.tm_salt(p))).alias("thermal"), r(seq.kmer_diversity(p, 4)).alias("complexity"))


@query()
def overall_quality(spark, d):
    """Candidates through the quality filter, with the weighted quality of those that stay and the default of the rest."""
    p = F.col("primer")
    c = quality.quality_filter(candidates(spark, d))
    good = c.where("reason is null").select("primer", quality.overall_quality(p, thermo.tm_salt(p)).alias("qa_score"))
    return quality.with_quality(c.drop("qa_score"), good).select("primer", "reason", r(F.col("qa_score")).alias("qa_score"))


_HP = f"""{cand(12)}, s AS (SELECT primer, unnest(flatten(list_transform(range(3, 9), lambda l: flatten(list_transform(range(3, (len(primer) - l) // 2 + 1), lambda k: list_transform(range(0, len(primer) - 2 * k - l + 1), lambda i: {{'i': i, 'k': k, 'l': l}})))))) AS x FROM c),
f AS (SELECT primer, x.i AS i, x.k AS k, x.l AS l, primer[x.i + 1:x.i + x.k] AS five, {rc('primer[x.i + x.k + x.l + 1:x.i + 2 * x.k + x.l]')} AS three FROM s),
m AS (SELECT *, k - len(list_filter(range(1, k + 1), lambda j: five[j] = three[j])) AS miss, five || three AS stem_seq FROM f)"""
_SH, _SE = nn_sql("stem_seq")


@query(f"{_HP} SELECT primer, i::INT AS start, k::INT AS stem, l::INT AS loop, miss::INT AS mismatches, round({_SH} - 310.15 * {_SE} / 1000 + CASE l WHEN 3 THEN 5.6 WHEN 4 THEN 5.0 WHEN 5 THEN 5.2 WHEN 6 THEN 5.4 ELSE 5.4 + {1.75 * thermo.R / 1000 * 310.15!r} * ln(l / 6.0) END, 6) AS energy FROM m WHERE (k - miss)::DOUBLE / k >= 0.7")
def imperfect_hairpins(spark, d):
    return quality.imperfect_hairpins(candidates(spark, d, 12)).withColumn("energy", r(F.col("energy")))


@query(f"{cand(8)} SELECT primer, round(len(list_filter(range(1, 9), lambda i: primer[i] = ({rc('primer')})[i])) / 8.0, 6) AS likeness FROM c")
def one_hot_cosine(spark, d):
    """Cosine of the one-hot embeddings of a candidate and its reverse complement."""
    p = F.col("primer")
    return candidates(spark, d).select("primer", r(quality.cosine(quality.embedding(p, 8), quality.embedding(seq.reverse_complement(p), 8))).alias("likeness"))


@query(f"WITH {SITES}, n AS (SELECT genome, count_if(strand = '+') / 100.0 AS f, count_if(strand = '-') / 100.0 AS m FROM sites GROUP BY genome) SELECT genome, round(exp(f) / (exp(f) + exp(m)), 6) AS f, round(exp(m) / (exp(f) + exp(m)), 6) AS m, [round(f / (count_ / 6200.0), 6), round(m / (count_ / 6200.0), 6)][1] AS scaled FROM n, (SELECT count(*) AS count_ FROM sites)")
def softmax_shares(spark, d):
    s = line_sites(spark, d)
    n = s.groupBy("genome").agg((F.count_if(F.col("strand") == "+") / 100).alias("f"), (F.count_if(F.col("strand") == "-") / 100).alias("m"))
    j = n.join(F.broadcast(s.agg(F.count("*").alias("length"))))  # one row
    soft = scores.softmax(F.array("f", "m"))
    return j.select("genome", r(soft[0]).alias("f"), r(soft[1]).alias("m"), r(scores.scaled_histogram(F.array("f", "m"), F.col("length"))[0]).alias("scaled"))


# --- counts and pools ------------------------------------------------------
@query(f"{top_sql(POOL)}, q AS (SELECT {rc('primer')} AS asked FROM top), n AS (SELECT kmer, sum(n)::BIGINT AS n FROM cnt WHERE role = 1 GROUP BY kmer) SELECT asked, coalesce(n, 0)::BIGINT AS n FROM q LEFT JOIN n ON n.kmer = {can('asked')}")
def kmer_lookup(spark, d):
    """Background counts of given k-mers, on whichever strand they are asked for."""
    asked = top_candidates(spark, d, POOL).select(seq.reverse_complement(F.col("primer")).alias("asked"))
    return kmers.lookup(asked, kmers.count(sequences(spark, d).where(is_background()), [8]))


@query(f"WITH {SEQ}, {win(4, 'a')}, {win(6, 'b')}, c AS (SELECT role, k, {can('kmer')} AS kmer, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL) SELECT role, k, count(*) AS kinds, sum(n)::BIGINT AS total, grouping(role, k)::BIGINT AS level FROM c GROUP BY CUBE(role, k)")
def kmer_spectrum_cube(spark, d):
    return kmers.count(sequences(spark, d), [4, 6]).cube("role", "k").agg(F.count("*").alias("kinds"), F.sum("n").alias("total"), F.grouping_id("role", "k").cast("long").alias("level"))


_SITE_COUNTS = f"WITH {SITES}, n AS (SELECT genome::VARCHAR AS primer, count_if(primer <> 'R') AS fg_sites, count_if(primer = 'R') AS bg_sites FROM sites GROUP BY genome)"


def _site_counts(spark, d) -> DataFrame:
    flag = F.col("primer") == "R"
    return line_sites(spark, d).groupBy(F.col("genome").cast("string").alias("name")).agg(F.count_if(~flag).alias("fg_sites"), F.count_if(flag).alias("bg_sites")).withColumnRenamed("name", "primer")


@query(_SITE_COUNTS + f" SELECT primer, fg_sites FROM n ORDER BY fg_sites DESC, primer DESC LIMIT {POOL}")
def pool_by_foreground(spark, d):
    return networks.by_foreground(_site_counts(spark, d)).select("primer", "fg_sites")


@query(_SITE_COUNTS + f" SELECT primer, round(fg_sites::DOUBLE / (bg_sites + 1), 6) AS selectivity FROM n ORDER BY fg_sites::DOUBLE / (bg_sites + 1) DESC, primer DESC LIMIT {POOL}")
def pool_by_selectivity(spark, d):
    return networks.by_selectivity(_site_counts(spark, d)).select("primer", r(F.col("selectivity")).alias("selectivity"))


@query(f"""WITH {SEQ}, {win(6, 'a')}, {win(8, 'b')}, c AS (SELECT role, {can('kmer')} AS primer, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL),
g AS (SELECT primer, coalesce(sum(n) FILTER (role = 0), 0)::BIGINT AS f, coalesce(sum(n) FILTER (role = 1), 0)::BIGINT AS b FROM c GROUP BY primer HAVING f > 0)
SELECT len(primer)::INT AS k, count(*) AS n, round(avg(f::DOUBLE / (b + 1)), 6) AS mean_ratio, round(avg({gc_sql('primer')}), 6) AS mean_gc, sum(f)::BIGINT AS fg_sites, round(ln(1 + avg(f::DOUBLE / (b + 1))) * ln(1 + count(*)), 6) AS score FROM g GROUP BY ALL""")
def adaptive_k(spark, d):
    c = kmers.count(sequences(spark, d), [6, 8])
    of = lambda role: F.coalesce(F.sum(F.when(F.col("role") == role, F.col("n"))), F.lit(0))
    g = c.groupBy(F.col("kmer").alias("primer")).agg(of(0).alias("fg_count"), of(1).alias("bg_count")).where("fg_count > 0")
    g = g.select("primer", "fg_count", "bg_count", (F.col("fg_count") / (F.col("bg_count") + 1)).alias("ratio"), seq.gc_content(F.col("primer")).alias("gc"), F.lit(0.0).alias("tm"))
    return networks.best_k(g).select(F.col("k").cast("int").alias("k"), "n", r(F.col("mean_ratio")).alias("mean_ratio"), r(F.col("mean_gc")).alias("mean_gc"), F.col("fg_sites").cast("long").alias("fg_sites"), r(F.col("score")).alias("score"))


# --- networks --------------------------------------------------------------
@query(f"""WITH {SITES}, n AS (SELECT genome, count(*) AS n, count_if(strand = '+') // 8 AS big FROM sites GROUP BY genome), f AS (SELECT *, CASE WHEN big < 10 THEN 5.0 * big ELSE pow(2.0, least(big / 10.0, 20.0)) END AS fold, 1.96 * (0.2 + 1 / sqrt(n) + 0.15 + 0.3 * greatest(0.0, 1 - big / 100.0)) AS w FROM n)
SELECT genome, round(CASE WHEN fold <= 1 THEN 1 ELSE fold END, 6) AS fold, round(CASE WHEN fold <= 1 THEN 1 ELSE greatest(1.0, exp(ln(fold) * (1 - w))) END, 6) AS lower, round(CASE WHEN fold <= 1 THEN 1 ELSE least(1048576.0, exp(ln(fold) * (1 + w))) END, 4) AS upper FROM f""")
def fold_intervals(spark, d):
    n = line_sites(spark, d).groupBy("genome").agg(F.count("*").alias("n"), F.floor(F.count_if(F.col("strand") == "+") / 8).alias("big"))
    i = scores.fold_interval(F.col("n"), F.col("big"), F.lit(0.3))
    return n.select("genome", r(i["fold"]).alias("fold"), r(i["lower"]).alias("lower"), r(i["upper"], 4).alias("upper"))


@query(f"""WITH {SITES}, a AS (SELECT *, site % 10 = 5 AS fresh FROM sites) SELECT x.genome, x.primer, x.site AS site_f, y.site AS site_r, abs(y.pos - x.pos) AS distance FROM a x JOIN a y ON x.genome = y.genome AND x.primer = y.primer AND x.strand = '+' AND y.strand = '-' AND abs(y.pos - x.pos) <= {REACH} AND (x.fresh OR y.fresh)""")
def incremental_edges(spark, d):
    """Pairs within reach that fresh sites (fifth lines of orders) bring to the others."""
    s = line_sites(spark, d)
    fresh = F.col("site") % 10 == 5
    return networks.new_pairs(s.where(~fresh), s.where(fresh), ["genome", "primer"], REACH).select("genome", "primer", "site_f", "site_r", "distance")


def _role_sites(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Foreground and background sites of the pool (suppliers as primers), and its counts."""
    pool = networks.by_foreground(_site_counts(spark, d))
    s = line_sites(spark, d).select(F.lit("g").alias("genome"), F.col("genome").cast("string").alias("primer"), "strand", "pos", (F.col("primer") == "R").alias("bg"))
    s = s.join(F.broadcast(pool.select("primer")), "primer").select("genome", "primer", "strand", "pos", "bg")
    return s.where("not bg").drop("bg"), s.where("bg").drop("bg"), pool


def _rows(spark, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(i + 1, p) for i, p in enumerate(names)], "step int, primer string")


def _incidence(fg: DataFrame) -> DataFrame:
    return sites.bins_of(fg, ["primer"], 2000, 5000).select("primer", F.col("bin").cast("string").alias("bin"))


@query()
def network_selection(spark, d):
    fg, bg, _ = _role_sites(spark, d)
    return _rows(spark, networks.network(fg, bg, 3, REACH))


@query()
def refined_set(spark, d):
    fg, _, pool = _role_sites(spark, d)
    return _rows(spark, networks.refine(fg, [x["primer"] for x in pool.limit(8).collect()], 5, REACH))


@query()
def pruned_pool(spark, d):
    fg, bg, pool = _role_sites(spark, d)
    names = [x["primer"] for x in pool.limit(12).collect()]
    inc = _incidence(fg.where(F.col("primer").isin(names)))
    return _rows(spark, networks.prune(inc, pool.select("primer", "bg_sites"), 8, inc.select("bin").distinct().count(), 0.3))


@query()
def minimal_selection(spark, d):
    fg, _, pool = _role_sites(spark, d)
    q = pool.select("primer", (F.col("fg_sites") / (F.col("fg_sites") + F.col("bg_sites"))).alias("quality"))
    return networks.minimal(fg, q, 20000, 0.1, 5)


@query()
def amplicon_selection(spark, d):
    return _rows(spark, networks.amplicon_cover(_role_sites(spark, d)[0], 2, REACH))


@query()
def expanded_set(spark, d):
    """A set of three, expanded by three, one of them swapped, contracted to four."""
    fg, _, pool = _role_sites(spark, d)
    inc = networks.cut(_incidence(fg))
    fixed = [x["primer"] for x in pool.limit(3).collect()]
    more = [x["primer"] for x in networks.expand(inc, fixed, 3).collect()]
    return _rows(spark, networks.contract(inc, networks.swap(inc, [*fixed, *more], fixed[0]), 4))


@query()
def dimer_replacements(spark, d):
    top = networks.cut(top_candidates(spark, d, POOL).select("primer"))
    members = [x["primer"] for x in top.orderBy("primer").limit(6).collect()]
    return _rows(spark, networks.replace_dimers(members, top)[0])


@query()
def set_enrichment(spark, d):
    s = line_sites(spark, d).select(F.col("genome").cast("string").alias("primer"), F.lit("g").alias("genome"), "strand", "pos", F.when(F.col("primer") == "R", "background").otherwise("target").alias("role"))
    return networks.enrichment(s.withColumn("set", F.col("primer")), ["set"], REACH)


# --- wide features ---------------------------------------------------------
def _motif_sql(m: str) -> str:
    k = len(m)
    return f"round(len(list_filter(list_transform(range(1, len(primer) - {k - 2}), lambda i: primer[i:i + {k - 1}]), lambda x: x = '{m}'))::DOUBLE / (len(primer) - {k - 1}), 6) AS freq_{k}mer_{m}"


def _n(b: str) -> str:
    return f"(len(primer) - len(replace(primer, '{b}', '')))"


@query(f"""{cand(8)} SELECT primer, {', '.join(f'{_n(b)}::DOUBLE AS {b.lower()}_count' for b in 'ACGT')}, round(({_n('A')} + {_n('G')}) / len(primer), 6) AS purine_content, round(len(translate(left(primer, 5), 'AT', '')) / 5.0, 6) AS gc_content_5prime, round(len(translate(primer[3:6], 'AT', '')) / 4.0, 6) AS gc_content_middle,
round(CASE WHEN {_n('G')} + {_n('C')} = 0 THEN 0 ELSE ({_n('G')} - {_n('C')})::DOUBLE / ({_n('G')} + {_n('C')}) END, 6) AS gc_skew, round(CASE WHEN {_n('A')} + {_n('T')} = 0 THEN 0 ELSE ({_n('A')} - {_n('T')})::DOUBLE / ({_n('A')} + {_n('T')}) END, 6) AS at_skew, {', '.join(map(_motif_sql, features.MOTIFS))} FROM c""")
def wide_features(spark, d):
    """Candidates with composition and motif shares; the other columns of the table have queries of their own."""
    f = features.of_sequence(candidates(spark, d))
    names = ["a_count", "c_count", "g_count", "t_count", "purine_content", "gc_content_5prime", "gc_content_middle", "gc_skew", "at_skew", *[f"freq_{len(m)}mer_{m}" for m in features.MOTIFS]]
    return f.select("primer", *[r(F.col(n)).alias(n) for n in names])


@query(f"""WITH {SITES}, s AS (SELECT genome::VARCHAR AS primer, strand, pos FROM sites), l AS (SELECT primer, pos - lag(pos) OVER (PARTITION BY primer ORDER BY pos) AS gap FROM s WHERE strand = '+'), g AS (SELECT primer, avg(gap) AS m, stddev_pop(gap) AS sd, min(gap) AS lo, max(gap) AS hi, median(gap) AS md FROM l WHERE gap IS NOT NULL GROUP BY primer),
c AS (SELECT l.primer, avg((gap < m / 2)::INT) AS cl FROM l JOIN g USING (primer) WHERE gap IS NOT NULL GROUP BY l.primer), n AS (SELECT primer, count(*) AS total_binding_sites, count_if(strand = '+') AS forward_site_count FROM s GROUP BY primer)
SELECT primer, total_binding_sites, forward_site_count, round(m, 6) AS mean_forward_gap, round(sd, 6) AS std_forward_gap, lo AS min_forward_gap, hi AS max_forward_gap, round(md, 6) AS median_forward_gap, round(cl, 6) AS clustering_coefficient, round(sd / m, 6) AS gap_cv FROM n JOIN g USING (primer) JOIN c USING (primer)""")
def site_features(spark, d):
    s = line_sites(spark, d).select(F.col("genome").cast("string").alias("primer"), "strand", "pos")
    f = features.of_sites(s, 1_000_000, REACH)
    rounded = ("mean_forward_gap", "std_forward_gap", "median_forward_gap", "clustering_coefficient", "gap_cv")
    return f.select("primer", "total_binding_sites", "forward_site_count", "min_forward_gap", "max_forward_gap", *[r(F.col(c)).alias(c) for c in rounded])
