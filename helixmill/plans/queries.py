"""Named queries over whole tables, each with a SQL twin where SQL can express it.

Adapters: a document's letters A, C, G and T are a sequence, its role follows
from ``doc_id % 4`` (0 target, 1 background, 2 blacklist, 3 exclusion); an order
line is a site (supplier = genome, return flag = primer, parity of the line
number = strand, order key = position).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixmill.functions import scores, seq, thermo
from helixmill.operators import genomes, kmers, pairs, selection, simulation, sites

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.sequences(kmers.spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", (F.col("doc_id") % 4).cast("int"))


def line_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("genome"), F.col("l_returnflag").alias("primer"), F.when(F.col("l_linenumber") % 2 == 1, "+").otherwise("-").alias("strand"), F.col("l_orderkey").alias("pos"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("site"))


def r(c, digits: int = 6):
    return F.round(c, digits)


def r_scaled(c, digits: int = 6):
    """Round as DuckDB does: the scaled number to a whole one, halves away from zero.

    ``F.round`` goes by the decimal digits of the number; the two differ on
    halves that a double doesn't hold, which shows from some thousands on.
    """
    x = c * 10.0**digits
    low = F.floor(F.abs(x))
    near = F.signum(x) * (low + F.when(F.abs(x) - low >= 0.5, 1).otherwise(0))
    return F.when(F.abs(x) < 2.0**52, near).otherwise(x) / 10.0**digits  # whole from there on


MIN_FG, MAX_BG = 1e-5, 5e-4


def is_target():
    return F.col("role") == 0


def is_background():
    return F.col("role") == 1


def is_blacklist():
    return F.col("role") == 2


def is_exclusion():
    return F.col("role") == 3


# --- SQL fragments ---------------------------------------------------------
SEQ = "seqs AS (SELECT doc_id AS genome, (doc_id % 4)::INT AS role, regexp_replace(upper(coalesce(text, '')), '[^ACGT]', '', 'g') AS seq FROM documents)"
SITES = "sites AS (SELECT l_suppkey AS genome, l_returnflag AS primer, CASE WHEN l_linenumber % 2 = 1 THEN '+' ELSE '-' END AS strand, l_orderkey AS pos, l_orderkey * 10 + l_linenumber AS site FROM lineitem)"


def rc(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


def can(x: str) -> str:
    return f"least({x}, {rc(x)})"


def win(k: int, name: str = "w", of: str = "seqs") -> str:
    return f"{name} AS (SELECT genome, role, {k} AS k, (p - 1)::BIGINT AS pos, seq[p:p + {k - 1}] AS kmer FROM (SELECT *, unnest(range(1, len(seq) - {k} + 2)) AS p FROM {of} WHERE len(seq) >= {k}))"


def cand(k: int = 8) -> str:
    """Distinct canonical k-mers of the targets."""
    return f"WITH {SEQ}, {win(k)}, c AS (SELECT DISTINCT {can('kmer')} AS primer FROM w WHERE role = 0)"


def candidates(spark: SparkSession, sf_dir: str, k: int = 8) -> DataFrame:
    kinds = kmers.windows(sequences(spark, sf_dir).where(is_target()), [k]).select("kmer").distinct()
    return kinds.select(seq.canonical(F.col("kmer")).alias("primer")).distinct()


def wide(k: int = 8) -> str:
    return f"{cnt(k)}, wide AS (SELECT k, kmer, sum(CASE WHEN role = 0 THEN n ELSE 0 END)::BIGINT AS fg_count, sum(CASE WHEN role = 1 THEN n ELSE 0 END)::BIGINT AS bg_count FROM cnt GROUP BY k, kmer HAVING sum(CASE WHEN role = 0 THEN n ELSE 0 END) > 0)"


def cnt(k: int = 8) -> str:
    return f"{SEQ}, {win(k)}, cnt AS (SELECT role, k, {can('kmer')} AS kmer, count(*) AS n FROM w GROUP BY ALL)"


#: Candidates that the filter step hands on; tables of pairs and of sites are made of these.
POOL = 500


def all_candidates(spark: SparkSession, sf_dir: str, k: int = 8) -> DataFrame:
    """Every k-mer of the targets: ``primer, fg_count, bg_count``."""
    c = kmers.count(sequences(spark, sf_dir), [k])
    g = c.groupBy("kmer").agg(F.sum(F.when(is_target(), F.col("n")).otherwise(0)).alias("fg_count"), F.sum(F.when(is_background(), F.col("n")).otherwise(0)).alias("bg_count")).where("fg_count > 0")
    return g.select(F.col("kmer").alias("primer"), "fg_count", "bg_count")


def all_sql(k: int = 8) -> str:
    return f"WITH {wide(k)}, top AS (SELECT kmer AS primer, fg_count, bg_count FROM wide)"


def top_candidates(spark: SparkSession, sf_dir: str, n: int, k: int = 8) -> DataFrame:
    return all_candidates(spark, sf_dir, k).orderBy(F.desc(F.col("fg_count") - F.col("bg_count")), "primer").limit(n)


def top_sql(n: int, k: int = 8) -> str:
    return f"WITH {wide(k)}, top AS (SELECT kmer AS primer, fg_count, bg_count FROM wide ORDER BY fg_count - bg_count DESC, kmer LIMIT {n})"


# --- k-mers and rates ------------------------------------------------------
@query(f"WITH {SEQ}, {win(6, 'a')}, {win(8, 'b')} SELECT role, k, {can('kmer')} AS kmer, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL")
def canonical_kmer_counts(spark, d):
    return kmers.count(sequences(spark, d), [6, 8])


@query(f"WITH {SEQ}, {win(5)} SELECT role, k, kmer, count(*) AS n FROM w GROUP BY ALL")
def kmer_counts_plain(spark, d):
    return kmers.count(sequences(spark, d), [5], both_strands=False)


@query(f"WITH {SEQ}, {win(4, 'a')}, {win(6, 'b')}, c AS (SELECT role, k, {can('kmer')} AS kmer, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL) SELECT role, k, count(*) AS kinds, sum(n)::BIGINT AS total, max(n) AS most FROM c GROUP BY ROLLUP(role, k)")
def kmer_spectrum_rollup(spark, d):
    return kmers.count(sequences(spark, d), [4, 6]).rollup("role", "k").agg(F.count("*").alias("kinds"), F.sum("n").alias("total"), F.max("n").alias("most"))


RATES = f"""WITH {wide(8)}, size AS (SELECT sum(len(seq)) FILTER (role = 0) AS fg_len, sum(len(seq)) FILTER (role = 1) AS bg_len FROM seqs),
rates AS (SELECT k, kmer, fg_count, bg_count, fg_count / fg_len::DOUBLE AS fg_freq, bg_count / bg_len::DOUBLE AS bg_freq FROM wide, size)"""


@query(RATES + f" SELECT k, kmer, fg_count, bg_count, round(fg_freq, 9) AS fg_freq, round(bg_freq, 9) AS bg_freq, fg_freq > {MIN_FG} AND bg_freq < {MAX_BG} AS passes FROM rates")
def fg_bg_rates(spark, d):
    s = sequences(spark, d)
    out = kmers.rates(kmers.count(s, [8]), kmers.lengths(s, "role"), is_target(), is_background(), MIN_FG, MAX_BG)
    return out.withColumn("fg_freq", r(F.col("fg_freq"), 9)).withColumn("bg_freq", r(F.col("bg_freq"), 9))


def _map(table: dict) -> str:
    return "MAP {" + ", ".join(f"'{k}': {v}::DOUBLE" for k, v in table.items()) + "}"


def nn_sql(s: str) -> tuple[str, str]:
    """Enthalpy and entropy of a string column in SQL."""
    both = lambda t: f"list_sum(list_transform(range(1, len({s})), lambda i: {_map(t)}[{s}[i:i + 1]]))"
    ends = f"(({s}[1] IN ('A', 'T'))::INT + ({s}[-1] IN ('A', 'T'))::INT)"
    h = f"({thermo.INIT_H} + {both(thermo.ENTHALPY)} + {thermo.TERMINAL_AT_H} * {ends})"
    e = f"({thermo.INIT_S} + {both(thermo.ENTROPY)} + {thermo.TERMINAL_AT_S} * {ends} + CASE WHEN {s} = {rc(s)} THEN {thermo.SYMMETRY_S} ELSE 0 END)"
    return h, e


def tm_salt_sql(s: str) -> str:
    h, e = nn_sql(s)
    conc = f"CASE WHEN {s} = {rc(s)} THEN {thermo.R * math.log(0.5e-6 / 4)!r} ELSE {thermo.R * math.log(0.5e-6 / 2)!r} END"
    return f"(1000 * {h} / ({e} + 0.368 * (len({s}) - 1) * {math.log(0.05)!r} + {conc}) - 273.15)"


def gc_sql(s: str) -> str:
    return f"(len(translate({s}, 'AT', ''))::DOUBLE / len({s}))"


def shares_sql(a: str, b: str, t: int) -> str:
    cut = lambda x: f"list_transform(range(1, len({x}) - {t - 2}), lambda i: {x}[i:i + {t - 1}])"
    return f"(len({a}) >= {t} AND len({b}) >= {t} AND list_has_any({cut(a)}, {cut(b)}))"


REASON = f"""CASE WHEN NOT tm BETWEEN 15 AND 45 THEN 'tm' WHEN regexp_matches(primer, 'AAAAA|CCCCC|GGGGG|TTTTT') THEN 'homopolymer'
WHEN NOT {gc_sql('primer')} BETWEEN 0.375 AND 0.625 THEN 'gc' WHEN NOT len(translate(right(primer, 5), 'AT', '')) BETWEEN 1 AND 3 THEN 'clamp'
WHEN len(translate(right(primer, 3), 'AT', '')) > 2 THEN 'three_prime' WHEN len(primer) >= 10 AND regexp_matches(primer, '{seq.dinucleotide_pattern()}') THEN 'dinucleotide'
WHEN {shares_sql('primer', rc('primer'), 5)} THEN 'self_dimer' END"""


def _reasons(df: DataFrame, after=None) -> DataFrame:
    """``after``: a condition on sums, always true, that keeps the costly rules from sinking below a group-by to every occurrence."""
    p = F.col("primer") if after is None else F.when(after, F.col("primer"))
    df = df.withColumn("tm", thermo.tm_salt(p))
    return df.withColumn("reject_reason", kmers.rule_reasons(p, F.col("tm"), 15, 45, 0.375, 0.625, 4))


RULES = f"{cand(10)}, t AS (SELECT primer, {tm_salt_sql('primer')} AS tm FROM c), rules AS (SELECT primer, tm, {REASON} AS reject_reason FROM t)"


@query(RULES + " SELECT primer, round(tm, 6) AS tm, reject_reason FROM rules")
def candidate_rules(spark, d):
    return _reasons(candidates(spark, d, 10)).select("primer", r(F.col("tm")).alias("tm"), "reject_reason")


@query(RULES + " SELECT coalesce(reject_reason, 'kept') AS reason, count(*) AS n, round(avg(tm), 6) AS mean_tm FROM rules GROUP BY 1")
def filter_funnel(spark, d):
    return _reasons(candidates(spark, d, 10)).groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"), r(F.avg("tm")).alias("mean_tm"))


@query(f"""{RATES}, t AS (SELECT *, kmer AS primer, {tm_salt_sql('kmer')} AS tm FROM rates WHERE fg_freq > {MIN_FG} AND bg_freq < {MAX_BG}),
u AS (SELECT *, {REASON} AS reason FROM t) SELECT kmer, fg_count, bg_count, round(tm, 6) AS tm, round(bg_count::DOUBLE / fg_count, 9) AS ratio FROM u WHERE reason IS NULL ORDER BY bg_count::DOUBLE / fg_count, kmer LIMIT 500""")
def candidate_ranking(spark, d):
    """The whole of step two: counts, rates, rules, and the 500 best by ratio."""
    s = sequences(spark, d)
    ok = kmers.rates(kmers.count(s, [8]), kmers.lengths(s, "role"), is_target(), is_background(), MIN_FG, MAX_BG).where("passes").withColumn("primer", F.col("kmer"))
    kept = _reasons(ok, F.col("fg_count") > 0).where("reject_reason is null")
    return kmers.ranked(kept, 500).select("kmer", "fg_count", "bg_count", r(F.col("tm")).alias("tm"), r(F.col("ratio"), 9).alias("ratio"))


@query(f"{cand(8)} SELECT primer, {gc_sql('primer')} BETWEEN 0.275 AND 0.725 AND {tm_salt_sql('primer')} > 0 AND {tm_salt_sql('primer')} < 60 AS passes FROM c")
def wide_prefilter(spark, d):
    return candidates(spark, d).select("primer", kmers.wide_prefilter(F.col("primer"), 0.375, 0.625, 15, 45).alias("passes"))


@query(f"WITH {cnt(8)}, bad AS (SELECT kmer FROM cnt WHERE role = 3 GROUP BY kmer HAVING sum(n) > 0) SELECT kmer, sum(n)::BIGINT AS n FROM cnt WHERE role = 0 AND kmer NOT IN (SELECT kmer FROM bad) GROUP BY kmer")
def exclusion_anti_join(spark, d):
    c = kmers.count(sequences(spark, d), [8])
    return genomes.without(c.where(is_target()), c.where(is_exclusion()), 0).groupBy("kmer").agg(F.sum("n").alias("n"))


@query(f"WITH {cnt(8)}, len AS (SELECT sum(len(seq)) AS l FROM seqs WHERE role = 2), bl AS (SELECT kmer, sum(n) AS n FROM cnt WHERE role = 2 GROUP BY kmer) SELECT c.kmer, round(coalesce(bl.n, 0)::DOUBLE / l, 9) AS bl_freq, coalesce(bl.n, 0)::DOUBLE / l <= 1e-5 AS passes FROM (SELECT kmer FROM cnt WHERE role = 0) c LEFT JOIN bl USING (kmer), len")
def blacklist_freq(spark, d):
    s = sequences(spark, d)
    c = kmers.count(s, [8])
    return genomes.blacklist(c.where(is_target()), c.where(is_blacklist()), s.where(is_blacklist()), 1e-5).select("kmer", r(F.col("bl_freq"), 9).alias("bl_freq"), "passes")


MULTI = f"""WITH {cnt(8)}, len AS (SELECT role, sum(len(seq)) AS l FROM seqs GROUP BY role),
f AS (SELECT kmer, role, sum(n)::DOUBLE / max(l) AS f FROM cnt JOIN len USING (role) GROUP BY kmer, role),
m AS (SELECT kmer, coalesce(avg(f) FILTER (role = 0), 0) AS target_freq, coalesce(max(f) FILTER (role = 1), 0) AS bg_freq, coalesce(max(f) FILTER (role = 2), 0) AS bl_freq FROM f GROUP BY kmer)"""


@query(MULTI + " SELECT kmer, round(target_freq, 9) AS target_freq, round(bg_freq, 9) AS bg_freq, round(bl_freq, 9) AS bl_freq, round(bg_freq + 5 * bl_freq, 9) AS penalty, target_freq > 1e-5 AND bg_freq < 5e-5 AND bl_freq < 5e-5 AS passes FROM m WHERE target_freq > 0")
def multi_genome_score(spark, d):
    s = sequences(spark, d)
    m = genomes.blended(kmers.count(s, [8]), kmers.lengths(s, "role"), {"target": 0, "background": 1, "blacklist": 2}).where("target_freq > 0")
    passes = (F.col("target_freq") > 1e-5) & (F.col("bg_freq") < 5e-5) & (F.col("bl_freq") < 5e-5)
    return m.select("kmer", *[r(F.col(c), 9).alias(c) for c in ("target_freq", "bg_freq", "bl_freq", "penalty")], passes.alias("passes"))


@query(MULTI + " SELECT kmer, round(target_freq * target_freq / greatest(bg_freq, 1e-9) / (1 + bg_freq + 5 * bl_freq), 6) AS score FROM m WHERE target_freq > 0 ORDER BY target_freq * target_freq / greatest(bg_freq, 1e-9) / (1 + bg_freq + 5 * bl_freq) DESC, kmer LIMIT 200")
def multi_genome_rank(spark, d):
    s = sequences(spark, d)
    m = genomes.blended(kmers.count(s, [8]), kmers.lengths(s, "role"), {"target": 0, "background": 1, "blacklist": 2}).where("target_freq > 0")
    score = F.col("target_freq") * F.col("target_freq") / F.greatest("bg_freq", F.lit(1e-9)) / (1 + F.col("penalty"))
    return m.withColumn("s", score).orderBy(F.desc("s"), "kmer").limit(200).select("kmer", r(F.col("s")).alias("score"))


@query(f"WITH {cnt(8)} SELECT kmer, n FROM cnt WHERE role = 0 AND kmer IN (SELECT kmer FROM cnt WHERE role = 1)")
def bg_semi_join(spark, d):
    c = kmers.count(sequences(spark, d), [8])
    return c.where(is_target()).join(c.where(is_background()), "kmer", "left_semi").select("kmer", "n")


@query(f"WITH {SEQ}, {win(8)} SELECT {can('kmer')} AS kmer, count(*) * 100 AS estimate FROM w WHERE role = 1 AND pos % 100 = 0 GROUP BY 1")
def sampled_count_estimate(spark, d):
    """Every hundredth position, times a hundred: the sampled index is the operator."""
    w = kmers.windows(sequences(spark, d).where(is_background()), [8]).where(F.col("pos") % 100 == 0)
    kinds = w.groupBy("kmer").agg(F.count("*").alias("n"))
    return kinds.groupBy(seq.canonical(F.col("kmer")).alias("kmer")).agg((F.sum("n") * 100).alias("estimate"))


@query(f"WITH {wide(8)}, k AS (SELECT *, bg_count::DOUBLE / fg_count AS ratio FROM wide), n AS (SELECT *, row_number() OVER (ORDER BY fg_count::DOUBLE / (bg_count + 1) DESC, kmer) AS rn, count(*) OVER () AS n FROM k) SELECT kmer, fg_count, bg_count FROM n WHERE fg_count::DOUBLE / (bg_count + 1) >= 1 OR rn <= floor(0.8 * n)")
def bg_prefilter_floor(spark, d):
    c = kmers.count(sequences(spark, d), [8])
    g = c.groupBy("kmer").agg(F.sum(F.when(is_target(), F.col("n")).otherwise(0)).alias("fg_count"), F.sum(F.when(is_background(), F.col("n")).otherwise(0)).alias("bg_count")).where("fg_count > 0")
    return genomes.floor_filter(g, F.col("fg_count") / (F.col("bg_count") + 1), "kmer", 1.0, 0.8).select("kmer", "fg_count", "bg_count")


@query(f"WITH {wide(8)} SELECT kmer, fg_count, bg_count, fg_count - 0.5 * bg_count AS score FROM wide ORDER BY fg_count - 0.5 * bg_count DESC, kmer LIMIT 300")
def weighted_top_k(spark, d):
    c = kmers.count(sequences(spark, d), [8])
    g = c.groupBy("kmer").agg(F.sum(F.when(is_target(), F.col("n")).otherwise(0)).alias("fg_count"), F.sum(F.when(is_background(), F.col("n")).otherwise(0)).alias("bg_count")).where("fg_count > 0")
    return g.withColumn("score", F.col("fg_count") - 0.5 * F.col("bg_count")).orderBy(F.desc("score"), "kmer").limit(300)


# --- sequence functions ----------------------------------------------------
@query(f"WITH {SEQ} SELECT genome, len(seq)::INT AS length, " + ", ".join(f"len(seq) - len(replace(seq, '{b}', '')) AS n_{b.lower()}" for b in "ACGT") + ", ((len(seq) - len(replace(seq, 'AA', ''))) // 2) AS n_aa, CASE WHEN len(seq) = 0 THEN 0 ELSE round(len(translate(seq, 'AT', ''))::DOUBLE / len(seq), 6) END AS gc FROM seqs")
def base_composition(spark, d):
    s = F.col("seq")
    return sequences(spark, d).select("genome", F.length(s).alias("length"), *[seq.count_base(s, b).cast("long").alias(f"n_{b.lower()}") for b in "ACGT"], seq.count_base(s, "AA").cast("long").alias("n_aa"), r(seq.gc_content(s)).alias("gc"))


@query(f"{cand(8)} SELECT primer, {rc('primer')} AS rc, translate(primer, 'ACGT', 'TGCA') AS comp, primer = {rc('primer')} AS palindrome FROM c")
def reverse_complements(spark, d):
    p = F.col("primer")
    return candidates(spark, d).select("primer", seq.reverse_complement(p).alias("rc"), seq.complement(p).alias("comp"), seq.is_palindrome(p).alias("palindrome"))


@query(f"WITH {SEQ} SELECT genome, " + ", ".join(f"coalesce(list_max(list_transform(regexp_extract_all(seq, '{b}+'), lambda x: len(x))), 0)::INT AS run_{b.lower()}" for b in "ACGT") + " FROM seqs")
def homopolymer_runs(spark, d):
    return sequences(spark, d).select("genome", *[seq.longest_run(F.col("seq"), b).cast("int").alias(f"run_{b.lower()}") for b in "ACGT"])


@query(f"""{cand(8)}, n AS (SELECT primer, """ + ", ".join(f"(len(primer) - len(replace(primer, '{b}', '')))::DOUBLE / len(primer) AS p{b}" for b in "ACGT") + """ FROM c)
SELECT primer, round(""" + " + ".join(f"CASE WHEN p{b} > 0 THEN -p{b} * log2(p{b}) ELSE 0 END" for b in "ACGT") + """, 6) AS entropy,
round(len(list_distinct(flatten(list_transform(range(1, len(primer) + 1), lambda k: list_transform(range(1, len(primer) - k + 2), lambda i: primer[i:i + k - 1])))))::DOUBLE / (len(primer) * (len(primer) + 1) / 2), 6) AS complexity,
round(len(list_distinct(list_transform(range(1, len(primer) - 2), lambda i: primer[i:i + 3])))::DOUBLE / (len(primer) - 3), 6) AS diversity FROM n""")
def sequence_complexity(spark, d):
    p = F.col("primer")
    return candidates(spark, d).select("primer", r(seq.base_entropy(p)).alias("entropy"), r(seq.linguistic_complexity(p)).alias("complexity"), r(seq.kmer_diversity(p)).alias("diversity"))


@query(f"{cand(8)} SELECT primer, regexp_matches(primer, 'AAAAAA|CCCCCC|GGGGGG|TTTTTT|{seq.dinucleotide_pattern(3, True)}') AS repeats, {gc_sql('primer')} BETWEEN 0.3 AND 0.7 AS gc_ok, len(translate(right(primer, 5), 'AT', '')) BETWEEN 1 AND 3 AS clamp_ok FROM c")
def adaptive_filters(spark, d):
    p = F.col("primer")
    return candidates(spark, d).select("primer", (seq.has_homopolymer(p, 6) | seq.has_dinucleotide_repeat(p, 3, True)).alias("repeats"), seq.gc_content(p).between(0.3, 0.7).alias("gc_ok"), seq.gc_last(p, 5).between(1, 3).alias("clamp_ok"))


@query(f"{cand(8)} SELECT count(*) AS n, count_if({gc_sql('primer')} BETWEEN 0.4 AND 0.6) AS fixed, count_if({gc_sql('primer')} BETWEEN 0.3 AND 0.7) AS adaptive, count_if({gc_sql('primer')} BETWEEN 0.3 AND 0.7 AND NOT {gc_sql('primer')} BETWEEN 0.4 AND 0.6) AS gained FROM c")
def filter_comparison(spark, d):
    gc = seq.gc_content(F.col("primer"))
    old, new = gc.between(0.4, 0.6), gc.between(0.3, 0.7)
    return candidates(spark, d).agg(F.count("*").alias("n"), F.count_if(old).alias("fixed"), F.count_if(new).alias("adaptive"), F.count_if(new & ~old).alias("gained"))


@query(f"{all_sql()}, v AS (SELECT primer, unnest(flatten(list_transform(range(1, len(primer) + 1), lambda i: list_transform(list_filter(['A', 'C', 'G', 'T'], lambda b: b <> primer[i]), lambda b: primer[1:i - 1] || b || primer[i + 1:])))) AS variant FROM top), bg AS (SELECT kmer, sum(n) AS n FROM cnt WHERE role = 1 GROUP BY kmer) SELECT primer, count(*) AS variants, coalesce(sum(bg.n), 0)::BIGINT AS bg_hits FROM v LEFT JOIN bg ON bg.kmer = {can('variant')} GROUP BY primer")
def one_mismatch_neighbours(spark, d):
    bg = kmers.count(sequences(spark, d).where(is_background()), [8]).select("kmer", "n")
    v = all_candidates(spark, d).select("primer", F.explode(seq.mismatch_variants(F.col("primer"))).alias("variant")).withColumn("kmer", seq.canonical(F.col("variant")))
    return v.join(bg, "kmer", "left").groupBy("primer").agg(F.count("*").alias("variants"), F.coalesce(F.sum("n"), F.lit(0)).alias("bg_hits"))


NEAR_K, SEED = 12, 8
#: Near matches of every candidate among the k-mers of both strands of the background.
NEAR = f"""{all_sql(NEAR_K)}, o AS (SELECT DISTINCT kmer FROM w WHERE role = 1), b AS (SELECT kmer FROM o UNION SELECT {rc('kmer')} FROM o),
n AS (SELECT t.primer AS query, b.kmer AS target, {NEAR_K} - len(list_filter(range(1, {NEAR_K + 1}), lambda i: t.primer[i] = b.kmer[i])) AS mismatches FROM top t JOIN b ON t.primer[3:{2 + SEED}] = b.kmer[3:{2 + SEED}])"""


def near_matches(spark: SparkSession, d: str) -> DataFrame:
    q = all_candidates(spark, d, NEAR_K).select(F.col("primer").alias("query"))
    t = kmers.windows(sequences(spark, d).where(is_background()), [NEAR_K]).select("kmer").distinct()
    both = t.select(F.explode(F.array("kmer", seq.reverse_complement(F.col("kmer")))).alias("target")).distinct()
    return pairs.seed_matches(q, both, SEED, 2)


@query(f"{NEAR} SELECT query, target, mismatches::INT AS mismatches FROM n WHERE mismatches <= 2")
def near_match_seed_join(spark, d):
    return near_matches(spark, d)


# --- thermodynamics --------------------------------------------------------
H, E = nn_sql("primer")


@query(f"""{cand(8)}, t AS (SELECT primer, {H} AS h, {E} AS e, {tm_salt_sql('primer')} AS tm_salt FROM c), u AS (SELECT *, h - 310.15 * e / 1000 AS dg FROM t)
SELECT primer, round(h, 6) AS enthalpy, round(e, 6) AS entropy, round(1000 * h / (e + CASE WHEN primer = {rc('primer')} THEN {thermo.R * math.log(0.5e-6 / 4)!r} ELSE {thermo.R * math.log(0.5e-6 / 2)!r} END) - 273.15, 6) AS tm_basic, round(tm_salt, 6) AS tm_salt,
round(dg, 6) AS delta_g, round(1 / (1 + exp(dg / {thermo.R * 310.15 / 1000!r})), 6) AS bound, (2 * len(primer) + 2 * len(translate(primer, 'AT', '')))::INT AS wallace FROM u""")
def nearest_neighbour_thermodynamics(spark, d):
    p = F.col("primer")
    dg = thermo.free_energy(p)
    return candidates(spark, d).select("primer", r(thermo.enthalpy(p)).alias("enthalpy"), r(thermo.entropy(p)).alias("entropy"), r(thermo.tm_basic(p)).alias("tm_basic"), r(thermo.tm_salt(p)).alias("tm_salt"), r(dg).alias("delta_g"), r(thermo.binding_probability(dg)).alias("bound"), thermo.wallace_tm(p).cast("int").alias("wallace"))


ADD = {"dmso": 5.0, "betaine": 1.0}


@query(f"{cand(8)} SELECT primer, round({tm_salt_sql('primer')} + {thermo.additive_term(30.0, **ADD)!r} - 2.0 * len(primer) * ({gc_sql('primer')} - 0.5) * {1 / (1 + math.exp(-1.5 * (1.0 - 5.2 / 3)))!r}, 6) AS effective_tm FROM c")
def effective_tm(spark, d):
    return candidates(spark, d).select("primer", r(thermo.effective_tm(F.col("primer"), **ADD)).alias("effective_tm"))


def _vendor_sql(s: str) -> str:
    """The same formula at the default concentrations, with its constants worked out."""
    m_na, m_mg, m_dntp, ka = 0.01, 0.02, 0.01, 3e4
    b = ka * m_dntp - ka * m_mg + 1
    assert math.sqrt((-b + math.sqrt(b * b + 4 * ka * m_mg)) / (2 * ka)) / m_na >= 6
    y = math.log(m_mg)
    both = lambda t: f"list_sum(list_transform(range(1, len({s})), lambda i: {_map(t)}[{s}[i:i + 1]]))"
    gc = f"(({s}[1] IN ('G', 'C'))::INT + ({s}[-1] IN ('G', 'C'))::INT)"
    h = f"(0.1 * {gc} + 2.3 * (2 - {gc}) + {both(thermo._VENDOR_H)})"
    e = f"(-2.8 * {gc} + 4.1 * (2 - {gc}) + CASE WHEN {s} = {rc(s)} THEN -1.4 ELSE 0 END + {both(thermo._VENDOR_S)})"
    term = f"({3.92 - 0.911 * y!r} + {6.26 + 1.42 * y!r} / len({s}) + {-48.2 + 52.5 * y + 8.31 * y * y!r} / (2 * (len({s}) - 1)))"
    return f"greatest(1 / (({e} + {1.987 * math.log(5e-6)!r}) / (1000 * {h}) + {term} * 1e-5) - 273.15, 0)"


@query(f"{cand(8)} SELECT primer, round({_vendor_sql('primer')}, 6) AS tm FROM c")
def vendored_tm(spark, d):
    return candidates(spark, d).select("primer", r(thermo.vendored_tm(F.col("primer"))).alias("tm"))


SCORE = f"""{cand(8)}, f AS (SELECT primer, {_vendor_sql('primer')} AS tm, {gc_sql('primer')} AS gc, len(translate(right(primer, 5), 'AT', '')) AS clamp, greatest({', '.join(f"coalesce(list_max(list_transform(regexp_extract_all(primer, '{b}+'), lambda x: len(x))), 0)" for b in 'ACGT')}) AS run FROM c),
s AS (SELECT primer, greatest(0.0, least(20.0, 10 + CASE WHEN tm BETWEEN 30 AND 42 THEN 2 WHEN tm BETWEEN 25 AND 50 THEN 1 ELSE -2 END + CASE WHEN gc BETWEEN 0.4 AND 0.6 THEN 2 WHEN gc BETWEEN 0.3 AND 0.7 THEN 1 ELSE -1 END
+ CASE WHEN right(primer, 1) IN ('T', 'C') THEN 1 ELSE 0 END + CASE WHEN clamp BETWEEN 1 AND 3 THEN 1.0 WHEN clamp > 4 THEN -0.5 ELSE 0 END - CASE WHEN run >= 4 THEN 2 WHEN run >= 3 THEN 1 ELSE 0 END))::DOUBLE AS score FROM f)"""


def _scored(spark, d):
    p = F.col("primer")
    return candidates(spark, d).select("primer", scores.heuristic_score(p, thermo.vendored_tm(p)).alias("score"))


@query(SCORE + " SELECT primer, score FROM s")
def heuristic_score(spark, d):
    return _scored(spark, d)


@query(SCORE + ", m AS (SELECT median(score) AS m, max(score) AS x FROM s) SELECT primer, score FROM s, m WHERE score >= CASE WHEN x >= 19 THEN 19 ELSE m END")
def threshold_or_median(spark, d):
    """Rows at or above a threshold; where none is, at or above the median."""
    s = _scored(spark, d)
    m = s.agg(F.max("score").alias("x"), F.percentile("score", F.lit(0.5)).alias("m"))
    return s.join(F.broadcast(m)).where(F.col("score") >= F.when(F.col("x") >= 19, 19).otherwise(F.col("m"))).select("primer", "score")


from helixmill.plans import more_queries, network_queries, set_queries  # noqa: E402,F401  they register their queries
