"""Scores of candidates and sets as columns."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from helixmill.functions import seq

# Weights of set scores by application (coverage, selectivity, dimer, evenness, Tm).
APPLICATIONS = {"balanced": (0.35, 0.30, 0.15, 0.10, 0.10), "discovery": (0.50, 0.15, 0.10, 0.15, 0.10), "clinical": (0.20, 0.45, 0.20, 0.10, 0.05), "enrichment": (0.35, 0.30, 0.15, 0.10, 0.10), "metagenomics": (0.60, 0.10, 0.10, 0.15, 0.05)}
# Grade components: weight, bounds of four ratings, best first.
GRADES = {"coverage": (0.35, (0.95, 0.85, 0.70, 0.50)), "enrichment": (0.30, (500.0, 100.0, 50.0, 20.0)), "uniformity": (0.20, (0.85, 0.70, 0.55, 0.40)), "tm_range": (0.10, (3.0, 5.0, 8.0, 12.0)), "dimer": (0.05, (0.10, 0.20, 0.35, 0.50))}


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def heuristic_score(s: Column, tm: Column, strong_share: Column | None = None) -> Column:
    """Amplification score in [0, 20] from Tm, GC, 3' end, clamp, runs and the share of strong binding."""
    gc = seq.gc_content(s)
    clamp = seq.gc_last(s, 5)
    runs = F.greatest(*[seq.longest_run(s, b) for b in seq.BASES])
    score = (
        F.lit(10.0)
        + F.when(tm.between(30, 42), 2.0).when(tm.between(25, 50), 1.0).otherwise(-2.0)
        + F.when(gc.between(0.4, 0.6), 2.0).when(gc.between(0.3, 0.7), 1.0).otherwise(-1.0)
        # codes 2 and 3 stand for T and C; the score is defined on these codes
        + F.when(seq.end_code(F.right(s, F.lit(1))).isin(2, 3), 1.0).otherwise(0.0)
        + F.when(clamp.between(1, 3), 1.0).when(clamp > 4, -0.5).otherwise(0.0)
        + F.when(runs >= 4, -2.0).when(runs >= 3, -1.0).otherwise(0.0)
        + (F.lit(0.0) if strong_share is None else 3.0 * strong_share)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(20.0), score))


def set_score(coverage: Column, selectivity: Column, dimer: Column | float, gini: Column, tm_spread: Column | float, application: str = "balanced") -> Column:
    """Weighted sum of five parts; a part of a plain number is weighed in decimals, as SQL's literals are."""
    w = APPLICATIONS[application]
    one = F.lit(1.0)
    if isinstance(dimer, Column):
        cross = w[2] * (1 - F.least(dimer, one))
    else:
        cross = F.lit(float(Decimal(str(w[2])) * (1 - min(Decimal(str(dimer)), 1))))
    if isinstance(tm_spread, Column):
        even = w[4] * F.greatest(F.lit(0.0), 1 - tm_spread / 20)
    else:
        even = F.lit(float(Decimal(str(w[4])) * max(0, 1 - Decimal(str(tm_spread)) / 20)))
    return w[0] * F.least(coverage, one) + w[1] * F.greatest(F.lit(0.0), F.least(selectivity / 100, one)) + cross + w[3] * (1 - F.least(gini, one)) + even


def rating(value: Column | float, bounds: tuple[float, ...], lower_better: bool = False) -> Column:
    """Piecewise-linear rating in [0, 1] through 1, 0.75, 0.5 and 0.25 at the four bounds, 0 at the open end.

    Bounds and a plain number are subtracted from each other as decimals, as SQL's literals are.
    """
    levels, b = (1.0, 0.75, 0.5, 0.25), [Decimal(str(x)) for x in bounds]
    v = value if isinstance(value, Column) else F.lit(value)

    def above(x: Decimal) -> Column:
        return v - float(x) if isinstance(value, Column) else F.lit(float(Decimal(str(value)) - x))

    reaches = (lambda x: v <= float(x)) if lower_better else (lambda x: v >= float(x))
    out = F.when(reaches(b[0]), levels[0])
    for i in range(1, 4):
        part = -above(b[i]) if lower_better else above(b[i])
        out = out.when(reaches(b[i]), levels[i] + (levels[i - 1] - levels[i]) * part / float(abs(b[i - 1] - b[i])))
    last = levels[3] * (1 - above(b[3]) / float(b[3])) if lower_better else levels[3] * v / float(b[3])
    return out.otherwise(F.greatest(F.lit(0.0), last))


def grade(score: Column) -> Column:
    return F.when(score >= 0.9, "A").when(score >= 0.75, "B").when(score >= 0.6, "C").when(score >= 0.4, "D").otherwise("F")


def gc_class(gc: Column) -> Column:
    return F.when(gc < 0.25, "extreme_at").when(gc < 0.4, "at_rich").when(gc < 0.6, "balanced").when(gc < 0.7, "gc_rich").otherwise("extreme_gc")


def softmax(values: Column) -> Column:
    """Array of shares ``exp(x) / sum(exp(x))`` of an array of numbers; the greatest is taken off first."""
    raised = F.transform(values, lambda x: F.exp(x - F.array_max(values)))
    return F.transform(F.array(raised), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y)))[0]


def scaled_histogram(counts: Column, length: Column, unit: float = 6200.0) -> Column:
    """An energy histogram per genome length, in units of the length that the scores were fitted on."""
    return F.transform(counts, lambda x: x / (length / unit))


def tm_efficiency(tm: Column, celsius: float) -> Column:
    """Share of binding by distance from five degrees above the reaction's temperature, 0.1 at least."""
    return F.greatest(F.lit(0.1), F.exp(-0.1 * F.pow(tm - (celsius + 5), F.lit(2))))


def fold_interval(sites: Column, largest: Column, gini: Column) -> Column:
    """Fold of the largest component with its 95 % interval, log-normal: ``fold, lower, upper``.

    It widens with few sites, uneven sites and a small component.
    """
    f = fold(largest)
    spread = 1.96 * (0.2 + 1 / F.sqrt(F.greatest(sites, F.lit(1))) + gini / 2 + 0.3 * F.greatest(F.lit(0.0), 1 - largest / 100))
    known = F.struct(f.alias("fold"), F.greatest(F.lit(1.0), F.exp(F.log(f) * (1 - spread))).alias("lower"), F.least(F.lit(2.0**20), F.exp(F.log(f) * (1 + spread))).alias("upper"))
    one = F.lit(1.0)
    return F.when(f <= 1, F.struct(one.alias("fold"), one.alias("lower"), one.alias("upper"))).otherwise(known)


def fold(sites: Column) -> Column:
    """Predicted amplification fold of a component."""
    return F.when(sites < 10, 5.0 * sites).otherwise(F.pow(F.lit(2.0), F.least(sites / 10, F.lit(20.0))))


def scaled_threshold(base: float, k: Column) -> Column:
    """Frequency bound for length k: the expected count falls by four for each base beyond ten."""
    return F.when(k <= 10, F.lit(base)).otherwise(base * F.pow(F.lit(4.0), (10 - k).cast("double")))
