"""Quality rules: fixed rules, then robust multivariate outliers per language and source.

Every text gives a vector of five transformed statistics: log word count, log
mean word length, and the square roots of the rates of symbols, of words in
repeated three-word windows and of repeated lines.  For each language and
source the minimum-covariance-determinant estimate of centre and scatter is
found by concentration steps: take the ``H`` share of rows nearest to the
present estimate, estimate again from these, repeat.  The steps begin from
several deterministic starts, the shares that are most central by the sum of
squares, the sum and the maximum of the robust scores of their statistics
(medians and median absolute deviations).  After ``TRIAL`` steps each group goes
on with the start of least determinant, until its determinant stops falling.

Groups are no islands: estimates are made as well per language and over all,
and that of a group of n rows is shrunk to its language's, that of a language to
the one over all, by the weight ``n / (n + SHRINK)``.  So every document is
judged, however small its group.  A document is an outlier when its squared
Mahalanobis distance exceeds ``CUTOFF``.

Everything is DataFrame code.  Order statistics come from histograms with
fixed bins, so a group of any size is summed in parallel and results do not
depend on task order.  Only the table of groups, behind Spark's own size
check, is ever broadcast.

Edge cases: a null or empty text has no words and fails the fixed rules; null
``lang`` or ``source`` form groups of their own; a lone document that passes the
fixed rules is its own centre and stays; repeated rows count and are returned
each; an empty table gives an empty result; other columns are ignored by
``assess`` and kept by ``keep_good``.  Repeated windows are compared by 64-bit
hashes within one document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.llm.common import Stash, blank_words, maybe_broadcast

SYMBOLS = "#*$%&|<>"
P = 5
H = 0.75
#: Concentration steps of every start, and the least fall of the log determinant that is worth another step.
TRIAL = 2
FALL = 1e-3
#: Rows at which a group's own estimate weighs as much as its language's.
SHRINK = 40
#: Chi-square of 5 degrees of freedom at a tail of one in a million.
CUTOFF = 35.9
#: Consistency factor of the estimate for 5 dimensions and a share of 0.75 under the normal law.
CONSISTENCY = 1.41
#: Least standard deviation of each statistic; keeps scatters regular where most documents have a rate of 0.
FLOORS = (0.25, 0.03, 0.05, 0.14, 0.18)
BINS = 64
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body) -> Column:
    """Evaluates ``value`` once for a body that uses it many times."""
    return F.transform(F.array(value), body)[0]


def statistics(text: Column) -> Column:
    """Struct of the counts that the rules use."""
    whole = F.coalesce(text, F.lit(""))
    plain = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), SYMBOLS, whole)

    def lines(ls: Column) -> Column:
        return F.struct(F.size(ls).alias("n"), (F.size(ls) - F.size(F.array_distinct(ls))).alias("again"))

    def repeated(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))

        def covered(s: Column) -> Column:
            twice = F.filter(s, lambda x, j: F.get(s, j - 1)["h"].eqNullSafe(x["h"]) | F.get(s, j + 1)["h"].eqNullSafe(x["h"]))
            return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        return F.when(F.size(w) < 3, F.lit(0)).otherwise(_let(F.sort_array(windows), covered))

    return _let(
        blank_words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.length(whole) - F.length(plain)).cast("long").alias("n_symbols"),
            _let(F.filter(F.split(whole, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\x0b\x0c\r"))) > 0), lines).alias("lines"),
            repeated(w).cast("long").alias("n_repeat_words"),
        ),
    )


def with_statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    s = docs.select(*[F.col(f"`{c}`") for c in keep], statistics(F.col(text)).alias("__s"))
    n = F.col("n_words")
    out = s.select(*[F.col(f"`{c}`") for c in keep], F.col("__s.n_words").alias("n_words"), F.col("__s.word_chars").alias("word_chars"), F.col("__s.n_symbols").alias("n_symbols"), F.col("__s.lines.again").cast("long").alias("n_dup_lines"), F.col("__s.n_repeat_words").alias("n_repeat_words"), F.col("__s.lines.n").alias("__lines"))
    failed = (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)
    x = (F.log(n), F.log(F.col("word_chars") / n), F.sqrt(F.col("n_symbols") / n), F.sqrt(F.col("n_repeat_words") / n), F.sqrt(F.col("n_dup_lines") / F.col("__lines")))
    return out.withColumn("base_failed", failed).select("*", *[F.when(~F.col("base_failed"), v).alias(f"__x{j}") for j, v in enumerate(x)]).drop("__lines")


def _bin(v: Column) -> Column:
    return F.floor(v * BINS).cast("long")


def _quantile_bin(df: DataFrame, keys: list[str], value: Column, share: float) -> DataFrame:
    """Least bin at which ``share`` of a group's rows is reached: ``keys, bin``."""
    # dealt out again by group only once the bins are summed, else a hot group's parts would all meet in one task
    counts = df.select(*keys, _bin(value).alias("bin")).groupBy(*keys, "bin").count().repartition(*keys)
    w = Window.partitionBy(*keys)
    run = counts.select(*keys, "bin", F.sum("count").over(w.orderBy("bin")).alias("upto"), F.sum("count").over(w).alias("all"))
    return run.where(F.col("upto") >= F.ceil(F.col("all") * share)).groupBy(*keys).agg(F.min("bin").alias("bin"))


def _distance(df: DataFrame) -> DataFrame:
    """Squared distance from the columns ``m*`` and ``l**`` (lower triangle of the scatter's root)."""
    y: list[Column] = []
    out = df
    for i in range(P):
        v = F.col(f"__x{i}") - F.col(f"m{i}")
        for j in range(i):
            v = v - F.col(f"l{i}{j}") * F.col(f"__y{j}")
        out = out.withColumn(f"__y{i}", v / F.col(f"l{i}{i}"))
        y.append(F.col(f"__y{i}"))
    return out.withColumn("__d2", reduce(lambda a, b: a + b, [c * c for c in y])).drop(*[f"__y{i}" for i in range(P)])


def _roots(cov: DataFrame, keep: list[str]) -> DataFrame:
    """Cholesky factor ``l**`` of each scatter ``c**``, unrolled over the five statistics, and its ``logdet``."""
    out = cov
    for i in range(P):
        for j in range(i + 1):
            v = F.col(f"c{i}{j}") + (FLOORS[i] ** 2 if i == j else 0.0)
            for k in range(j):
                v = v - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(v, F.lit(1e-12))) if i == j else v / F.col(f"l{j}{j}"))
    logdet = reduce(lambda a, b: a + b, [2 * F.log(f"l{i}{i}") for i in range(P)])
    return out.select(*keep, *MEAN, *SCATTER, *[f"l{i}{j}" for i in range(P) for j in range(i + 1)], logdet.alias("logdet"))


X = [f"__x{j}" for j in range(P)]
MEAN = [f"m{i}" for i in range(P)]
SCATTER = [f"c{i}{j}" for i in range(P) for j in range(i + 1)]
GROUP = ["__g1", "__g2"]
NULL = "\x00null"
ANY = "\x00any"


def _keys(df: DataFrame, lang: str, source: str) -> DataFrame:
    return df.withColumn("__lang", F.coalesce(F.col(lang), F.lit(NULL))).withColumn("__source", F.coalesce(F.col(source), F.lit(NULL)))


#: Rows of a table of groups up to which it is broadcast, a hundred bytes or two each.
MOST_GROUPS = 100_000


def _per_group(df: DataFrame) -> DataFrame:
    """Broadcast behind a count: its many small files look larger than they are, and rows would be shuffled to their groups."""
    return maybe_broadcast(df, MOST_GROUPS)


def _concentrated(near: DataFrame, keys: list[str], stash: Stash) -> DataFrame:
    """Estimate from the ``H`` share of each group's rows with the least ``__ld``."""
    limit = stash.put(_quantile_bin(near, keys, F.col("__ld"), H))
    inner = near.join(_per_group(limit), keys).where(_bin(F.col("__ld")) <= F.col("bin"))
    moments = inner.groupBy(*keys).agg(*[F.avg(X[i]).alias(f"m{i}") for i in range(P)], *[F.avg(F.col(X[i]) * F.col(X[j])).alias(f"s{i}{j}") for i in range(P) for j in range(i + 1)])
    cov = moments.select(*keys, *MEAN, *[(CONSISTENCY * (F.col(f"s{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}"))).alias(f"c{i}{j}") for i in range(P) for j in range(i + 1)])
    return stash.put(_roots(cov, keys))


def _near(rows: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    return _distance(rows.join(_per_group(model), GROUP)).select(*keys, *X, F.log1p("__d2").alias("__ld"))


def _started(rows: DataFrame, stash: Stash) -> DataFrame:
    """Rows three times, ``__start`` 0 to 2, with the log of three measures of how far they are from the middle."""
    long = rows.select(*GROUP, F.posexplode(F.array(*X)).alias("j", "v"))
    middle = stash.put(_quantile_bin(long, [*GROUP, "j"], F.col("v"), 0.5).select(*GROUP, "j", ((F.col("bin") + 0.5) / BINS).alias("m")))
    spread = _quantile_bin(long.join(_per_group(middle), [*GROUP, "j"]), [*GROUP, "j"], F.abs(F.col("v") - F.col("m")), 0.5)
    both = stash.put(middle.join(spread, [*GROUP, "j"]).groupBy(*GROUP).agg(
        *[F.max(F.when(F.col("j") == i, F.col("m"))).alias(f"m{i}") for i in range(P)],
        *[F.max(F.when(F.col("j") == i, F.pow(1.4826 * F.col("bin") / BINS, F.lit(2)))).alias(f"v{i}") for i in range(P)],
    ))
    z = [F.abs(F.col(X[i]) - F.col(f"m{i}")) / F.sqrt(F.col(f"v{i}") + FLOORS[i] ** 2) for i in range(P)]
    scored = rows.join(_per_group(both), GROUP).select(*GROUP, *X, *[c.alias(f"z{i}") for i, c in enumerate(z)])
    z = [F.col(f"z{i}") for i in range(P)]
    measures = (reduce(lambda a, b: a + b, [c * c for c in z]), reduce(lambda a, b: a + b, z), F.greatest(*z))
    return scored.select(*GROUP, *X, F.posexplode(F.array(*[F.log1p(m) for m in measures])).alias("__start", "__ld"))


def estimates(rows: DataFrame, stash: Stash) -> DataFrame:
    """Centre and scatter of least determinant per group of ``rows`` (``GROUP`` and ``X``)."""
    keys = [*GROUP, "__start"]
    model = _concentrated(_started(rows, stash), keys, stash)
    for _ in range(TRIAL):
        model = _concentrated(_near(rows, model, keys), keys, stash)
    best = stash.put(model.groupBy(*GROUP).agg(F.min_by(F.struct(*[c for c in model.columns if c not in keys]), F.struct("logdet", "__start")).alias("b")).select(*GROUP, "b.*"))
    falling = best.select(*GROUP)
    while True:
        new = _concentrated(_near(rows.join(_per_group(falling), GROUP, "left_semi"), best, GROUP), GROUP, stash)
        lower = new.join(best.select(*GROUP, F.col("logdet").alias("__was")), GROUP).where(F.col("logdet") < F.col("__was") - FALL)
        lower = stash.put(lower.drop("__was"))
        if not lower.limit(1).count():
            return best
        best = stash.put(best.join(lower, GROUP, "left_anti").unionByName(lower))
        falling = lower.select(*GROUP)


def _shrunk(own: DataFrame, parent: DataFrame, on: list[str]) -> DataFrame:
    """Mixture of an estimate from ``__n`` rows and its parent's, by the weight n / (n + SHRINK)."""
    up = parent.select(*on, *[F.col(c).alias(f"p{c}") for c in (*MEAN, *SCATTER)])
    j = own.join(up, on) if on else own.join(F.broadcast(up))  # the parent of languages is one row
    w = F.col("__n") / (F.col("__n") + SHRINK)
    gap = lambda i: F.col(f"m{i}") - F.col(f"pm{i}")
    keep = [c for c in own.columns if c not in (*MEAN, *SCATTER)]
    return j.select(
        *keep,
        *[(w * F.col(f"m{i}") + (1 - w) * F.col(f"pm{i}")).alias(f"m{i}") for i in range(P)],
        *[(w * F.col(f"c{i}{k}") + (1 - w) * F.col(f"pc{i}{k}") + w * (1 - w) * gap(i) * gap(k)).alias(f"c{i}{k}") for i in range(P) for k in range(i + 1)],
    )


def fit(stats: DataFrame, stash: Stash, lang: str = "lang", source: str = "source") -> DataFrame:
    """Table of groups: ``__lang, __source`` and the estimate that applies to them."""
    passed = _keys(stats.where("not base_failed"), lang, source)
    group = lambda a, b: F.struct(a.alias("__g1"), b.alias("__g2"))
    rows = stash.put(passed.select(F.explode(F.array(group(F.col("__lang"), F.col("__source")), group(F.col("__lang"), F.lit(ANY)), group(F.lit(ANY), F.lit(ANY)))).alias("g"), *X).select("g.*", *X))
    sizes = rows.groupBy(*GROUP).agg(F.count("*").alias("__n"))
    model = stash.put(estimates(rows, stash).join(sizes, GROUP).select(F.col("__g1").alias("__lang"), F.col("__g2").alias("__source"), "__n", *MEAN, *SCATTER))
    whole = model.where(F.col("__lang") == ANY)
    langs = stash.put(_shrunk(model.where((F.col("__lang") != ANY) & (F.col("__source") == ANY)).drop("__source"), whole, []))
    own = _shrunk(model.where(F.col("__source") != ANY), langs, ["__lang"])
    return stash.put(_roots(own, ["__lang", "__source"]).drop(*SCATTER, "logdet"))


def score(stats: DataFrame, model: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Adds ``distance2`` (null where no estimate applies) and ``kept``."""
    joined = _keys(stats, lang, source).join(_per_group(model), ["__lang", "__source"], "left")
    out = _distance(joined).withColumnRenamed("__d2", "distance2")
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance2"), F.lit(0.0)) <= CUTOFF)
    return out.withColumn("kept", kept).drop("__lang", "__source", *[f"__x{i}" for i in range(P)], *[c for c in model.columns if c[0] in "ml" and c[1:].isdigit()])


def assess(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per document: key, the counts, ``base_failed``, ``distance2`` and ``kept``."""
    stash = Stash(docs.sparkSession)
    stats = stash.put(with_statistics(docs, text, (key, lang, source)))
    return score(stats, fit(stats, stash, lang, source), lang, source).drop(lang, source)


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that pass, with all their columns.

    Documents are written once beside their statistics, so that no text is read
    twice or shuffled to its verdict.
    """
    stash = Stash(docs.sparkSession)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"))
    stats = stash.put(with_statistics(whole.select("__doc", F.col(f"__doc.`{text}`").alias("__text"), F.col(f"__doc.`{lang}`").alias("__l"), F.col(f"__doc.`{source}`").alias("__o")), "__text", ("__doc", "__l", "__o")))
    model = fit(stats.drop("__doc"), stash, "__l", "__o")
    stash.drop_others(stats, model)
    return score(stats, model, "__l", "__o").where("kept").select("__doc.*")


BASE_ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i:i + 2]) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM g WHERE n > 1) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(w) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(w) AS base_failed
FROM d LEFT JOIN r ON r.doc_id = d.doc_id
"""
