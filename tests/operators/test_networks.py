"""Searches over networks against plain loops on small sets."""

import random

import pytest

from helixmill.functions import conditions
from helixmill.operators import networks, selection


def graph_components(rows, reach):
    """Sizes and spans of components, by edges between opposite strands of one genome."""
    rows = sorted(rows)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (g, p, s) in enumerate(rows):
        for j in range(i):
            if rows[j][0] == g and rows[j][2] != s and abs(rows[j][1] - p) <= reach:
                parent[find(i)] = find(j)
    out = {}
    for i, x in enumerate(rows):
        out.setdefault(find(i), []).append(x[1])
    return [(len(v), max(v) - min(v) + 1) for v in out.values()]


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(6)
    rows = lambda n, w: [(rnd.choice("xy"), rnd.choice("ABCDEF"), rnd.choice("+-"), i * w + rnd.randint(0, w - 1)) for i in range(n)]
    fg, bg = rows(70, 9), rows(30, 25)
    return fg, bg, *(spark.createDataFrame(x, "genome string, primer string, strand string, pos long") for x in (fg, bg))


def of(rows, names):
    return [(g, pos, s) for g, p, s, pos in rows if p in names]


def test_network(data):
    fg, bg, dfg, dbg = data
    picks, f0, b0 = [], 0, 0
    for _ in range(3):
        best = None
        for c in sorted(set("ABCDEF") - set(picks)):
            f = max((n for n, _ in graph_components(of(fg, [*picks, c]), 20)), default=0)
            sizes = [n for n, _ in graph_components(of(bg, [*picks, c]), 20)]
            b = sum(sizes) / len(sizes) if sizes else b0
            score = (f - f0) / (b - b0 + 1)
            if best is None or score > best[0]:
                best = (score, c, f, b)
        picks.append(best[1])
        f0, b0 = best[2], best[3]
    assert networks.network(dfg, dbg, 3, 20) == picks


def test_refine_and_amplicons(data):
    fg, _, dfg, _ = data
    left = list("ABCDEF")
    while len(left) > 3:
        fold = {}
        for c in left:
            n = max(x for x, _ in graph_components(of(fg, [p for p in left if p != c]), 20))
            fold[c] = 5 * n if n < 10 else 2 ** min(n / 10, 20)
        left.remove(min(left, key=lambda c: (-fold[c], c)))
    assert networks.refine(dfg, list("ABCDEF"), 3, 20) == left
    assert "A" in networks.refine(dfg, list("ABCDEF"), 1, 20, fixed=("A",))
    picks = []
    for _ in range(2):
        span = {c: sum(w for n, w in graph_components(of(fg, [*picks, c]), 20) if n > 1) for c in set("ABCDEF") - set(picks)}
        picks.append(min(span, key=lambda c: (-span[c], c)))
    assert networks.amplicon_cover(dfg, 2, 20) == picks


def test_edits(spark):
    rnd = random.Random(2)
    inc = {p: {str(rnd.randint(0, 25)) for _ in range(rnd.randint(2, 9))} for p in "ABCDEFGH"}
    df = spark.createDataFrame([(p, b) for p, bs in inc.items() for b in bs], "primer string, bin string")
    bg = spark.createDataFrame([(p, i * 3) for i, p in enumerate("ABCDEFGH") if p != "C"], "primer string, bg_sites long")
    more = [r.primer for r in networks.expand(df, ["A"], 2, failed=["B"]).collect()]
    have = set(inc["A"])
    for p in more:
        assert len(inc[p] - have) == max(len(inc[x] - have) for x in inc if x not in "AB")
        have |= inc[p]
    assert len(networks.contract(df, list("ABCD"), 2)) == 2
    new = networks.swap(df, list("ABC"), "B")
    assert networks.coverage_of(df, new) >= networks.coverage_of(df, list("ABC"))
    left, bins, sites = list("ABCDEFGH"), len(set().union(*inc.values())), {p: i * 3 for i, p in enumerate("ABCDEFGH") if p != "C"}
    while len(left) > 3:
        cov = lambda ps: len(set().union(*[inc[p] for p in ps]))
        cost = {}
        for p in left:
            without = cov([x for x in left if x != p])
            if without / bins >= 0.5:
                loss = cov(left) - without
                cost[p] = sites.get(p, 0) / (loss / bins) if loss else sites.get(p, 0) * 1000.0
        if not cost:
            break
        left.remove(min(cost, key=lambda p: (-cost[p], p)))
    assert networks.prune(df, bg, 3, bins, 0.5) == left
    with pytest.raises(ValueError):
        networks.pool_names(spark.range(600).selectExpr("cast(id as string) as primer"))


def test_dimers_fall(spark):
    pool = spark.createDataFrame([(p,) for p in ("AAAAACCC", "GGGTTTTT", "ACACACAC", "CCCCCCAA", "AACCAACC")], "primer string")
    members, severity = networks.replace_dimers(["AAAAACCC", "GGGTTTTT"], pool)
    assert len(members) == 2 and severity == 0.0


def test_conditions():
    c = conditions.Conditions
    assert conditions.max_length(c()) == 12 and conditions.max_length(c(betaine=2.0, dmso=5.0)) == 17 and conditions.max_length(c(polymerase="equiphi29", celsius=42, betaine=2.0, dmso=5.0)) == 18
    assert conditions.max_length(c(), 0.75) == 10 and conditions.max_length(c(), 0.2) == 13 and conditions.max_length(c(betaine=0.5), 0.35) == 15
    assert conditions.accessibility(c(celsius=25), 0.4) == 1.0 and conditions.accessibility(c(celsius=25), 0.7) == pytest.approx(0.8)
    assert conditions.enzyme(c(mg=2.5)) == {"processivity": 1.0, "speed": 1.0, "stability": 1.0}
    assert conditions.interaction(c(betaine=1.0, trehalose=0.3), "stability", 0.5) == pytest.approx((1 + 0.15 * 0.5 * 0.2) * (1 + 0.05 * 0.5))
    assert conditions.dimer_energy_limit(-9.0, 0.675) == pytest.approx(-10.5) and conditions.gc_range(0.32) == pytest.approx((0.17, 0.47))
    assert conditions.set_size("clinical", 1_000_000, 12)["recommended_size"] == 10
    assert conditions.criteria(c(celsius=42), 0.7)["max_dimer_energy"] == -10.0
    assert set(selection.REGISTRY) >= {"network", "hybrid"}


def test_forest_learns_what_the_features_tell(spark):
    from pyspark.sql import functions as F

    from helixmill.operators import features

    rnd = random.Random(8)
    primers = spark.createDataFrame([("".join(rnd.choice("ACGT") for _ in range(rnd.randint(8, 12))),) for _ in range(300)], "primer string").distinct()
    f = features.of_sequence(primers)
    assert len(f.columns) == 1 + 19 + 14 + 5 + 20
    rows = f.withColumn("y", F.col("gc_content") * 10 + F.col("longest_homopolymer")).cache()
    e = features.held_out_error(rows, "y", trees=20, depth=6)
    assert e["forest"] < 0.6 * e["mean"]
