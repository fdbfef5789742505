import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helixmill.functions import seq
from helixmill.operators import genomes, kmers, pairs, selection, simulation, sites
from helixmill.plans import queries
from helixmill.sinks import files

COMP = str.maketrans("ACGT", "TGCA")
rc = lambda s: s.translate(COMP)[::-1]


def seqs(spark, *texts, role=0):
    return spark.createDataFrame([(i, role, t) for i, t in enumerate(texts)], "genome int, role int, seq string")


def test_counts_over_chunk_borders(spark, monkeypatch):
    text = "".join(random.Random(1).choice("ACGT") for _ in range(333))
    monkeypatch.setattr(kmers, "CHUNK", 7)
    got = {(r.k, r.kmer): r.n for r in kmers.count(seqs(spark, text, "ACG", ""), [3, 5]).collect()}
    want = Counter((k, min(w, rc(w))) for t in (text, "ACG") for k in (3, 5) for w in (t[i : i + k] for i in range(len(t) - k + 1)))
    assert got == want


def find(spark, text, *primers, **kw):
    p = spark.createDataFrame([(x,) for x in primers], "primer string")
    out = sites.find_sites(seqs(spark, text), p, sorted({len(x) for x in primers}), **kw)
    return sorted((r.primer, r.strand, r.pos) for r in out.collect())


def test_sites(spark):
    plus = lambda *a, **k: [p for _, s, p in find(spark, *a, **k) if s == "+"]
    assert plus("ATCGATCGATCG", "ATCG") == [0, 4, 8]
    assert plus("ATCGATCGATCG", "TCGA") == [1, 5] and plus("ATCGATCGATCG", "CGAT") == [2, 6]
    assert plus("AAAAAAAAAA", "AA") == list(range(9))
    assert plus("ACG", "ACGTACG") == []
    assert plus("CGAT", "TCGA", circular=True) == [3]
    assert sorted(find(spark, "AATT", "AATT")) == [("AATT", "+", 0), ("AATT", "-", 0)]


def random_sites(seed, n=60, top=400):
    rnd = random.Random(seed)
    return [(rnd.randint(0, 2), "+" if rnd.random() < 0.5 else "-", rnd.randint(0, top), i) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_components_match_union_find(spark, seed):
    rows, reach = random_sites(seed), 12
    got = {r.site: (r.genome, r.component) for r in sites.components(spark.createDataFrame(rows, "genome int, strand string, pos long, site int"), ["genome"], reach).collect()}
    parent = {s: s for *_, s in rows}

    def find_(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for g, s, p, i in rows:
        for h, t, q, j in rows:
            if g == h and s != t and abs(p - q) <= reach:
                parent[find_(i)] = find_(j)
    for a in parent:
        for b in parent:
            assert (find_(a) == find_(b)) == (got[a] == got[b])


@pytest.mark.parametrize("seed", range(2))
def test_band_join_and_nearest(spark, seed):
    rows = random_sites(seed + 10)
    df = spark.createDataFrame(rows, "genome int, strand string, pos long, site int")
    f, v = df.where("strand = '+'"), df.where("strand = '-'")
    got = sorted((r.site_f, r.site_r) for r in sites.band_join(f, v, ["genome"], 25).collect())
    assert got == sorted((i, j) for g, s, p, i in rows for h, t, q, j in rows if g == h and s == "+" and t == "-" and abs(p - q) <= 25)
    got = sorted((r.site_f, r.site_r) for r in sites.band_join(f, v, ["genome"], 40, 5, directed=True).collect())
    assert got == sorted((i, j) for g, s, p, i in rows for h, t, q, j in rows if g == h and s == "+" and t == "-" and 5 <= q - p <= 40)
    near = {r.site: r.distance for r in sites.nearest_opposite(df, ["genome"]).collect()}
    assert near == {i: min((abs(p - q) for h, t, q, _ in rows if h == g and t == "-"), default=None) for g, s, p, i in rows if s == "+"}


def test_coverage_holes_and_gaps(spark):
    rows = random_sites(5, 20, 1000)
    df = spark.createDataFrame(rows, "genome int, strand string, pos long, site int")
    covered = {}
    for g, _, p, _ in rows:
        covered.setdefault(g, set()).update(range(max(0, p - 15), min(1000, p + 15)))
    cov = {r.genome: r.covered for r in sites.coverage(df, ["genome"], 15, F.lit(1000)).collect()}
    assert cov == {g: len(x) for g, x in covered.items()}
    total = {r.genome: r.x for r in sites.holes(df, ["genome"], 15, F.lit(1000), 0).groupBy("genome").agg(F.sum("size").alias("x")).collect()}
    assert total == {g: 1000 - len(x) for g, x in covered.items()}
    ring = sites.gaps(df.select("genome", "pos").distinct(), ["genome"], F.lit(1000)).groupBy("genome").agg(F.sum("gap").alias("x")).collect()
    assert {r.x for r in ring} == {1000}


def test_gini_and_entropy(spark):
    df = spark.createDataFrame([("a", 5), ("a", 5), ("a", 5), ("b", 1), ("b", 9), ("c", 3)], "g string, v int")
    g = {r.g: r.gini for r in sites.gini(df, ["g"], "v").collect()}
    assert g["a"] == pytest.approx(0, abs=1e-9) and g["b"] == pytest.approx(0.4, abs=1e-6) and g["c"] == 0
    e = {r.g: r.entropy for r in sites.histogram_entropy(df, ["g"], "v").collect()}
    assert e["a"] == 0 and e["b"] == pytest.approx(1.0) and e["c"] == 0


def test_selection(spark):
    inc = spark.createDataFrame([(p, b) for p, bs in {"a": range(10), "b": range(5, 14), "c": range(10, 14), "d": [20]}.items() for b in bs], "primer string, bin int")
    picks = [(r.step, r.primer, r.gain) for r in selection.set_cover(inc, 3).orderBy("step").collect()]
    assert picks == [(1, "a", 10.0), (2, "b", 4.0), (3, "d", 1.0)]
    loss = {r.primer: r.loss for r in selection.leave_one_out(inc).collect()}
    assert loss == {"a": 5, "b": 0, "c": 0, "d": 1}
    rnd = random.Random(2)
    pts = [(i, rnd.randint(0, 9), rnd.randint(0, 9)) for i in range(60)]
    sky = {r.i for r in selection.skyline(spark.createDataFrame(pts, "i int, u int, v int"), "u", "v").collect()}
    assert sky == {i for i, u, v in pts if not any(x >= u and y >= v and (x > u or y > v) for _, x, y in pts)}


def test_search(spark):
    scored = spark.createDataFrame([("p%02d" % i, float(i % 7)) for i in range(20)], "primer string, score double")
    bad = {("p06", "p13"), ("p05", "p06")}
    table = spark.createDataFrame([("p%02d" % i, "p%02d" % j, ("p%02d" % i, "p%02d" % j) in bad, 0.0) for i in range(20) for j in range(i + 1, 20)], "a string, b string, dimer boolean, severity double")
    best = selection.beam(scored, table, 3).first()
    assert best.score == 16.0 or best.score == 17.0
    for r in selection.beam(scored, table, 3).collect() + selection.dimer_free_sets(scored.select("primer").limit(8), table, 3).collect():
        assert not any((x, y) in bad for x in r.members for y in r.members)
    ga = selection.genetic(scored, table, 3).collect()
    assert ga[0].fitness >= 15 and selection.genetic(scored, table, 3).collect() == ga


def test_dimer_free_sets_are_whole_and_ranked(spark):
    names = ["p%02d" % i for i in range(30)]
    p = spark.createDataFrame([(x,) for x in names], "primer string")
    table = spark.createDataFrame([(a, b, False, 0.0) for a in names for b in names if a < b], "a string, b string, dimer boolean, severity double")
    sets = selection.dimer_free_sets(p, table, 3)
    assert len({tuple(r.members) for r in sets.collect()}) == sets.count() == 4060
    assert selection.dimer_free_sets(p.where("primer < 'p10'"), table, 3).count() == 120
    with pytest.raises(ValueError):
        selection.dimer_free_sets(p, table, 3, most=4059)
    counts = spark.createDataFrame([(x, i, 9 if i < 27 else 0) for i, x in enumerate(names)], "primer string, fg_sites long, bg_sites long")
    assert selection.best_ratio(sets, counts).first().members == ["p27", "p28", "p29"]


def test_too_many_candidates_are_an_error(spark):
    many = spark.range(5001).select(F.format_string("p%05d", "id").alias("primer"), F.lit(1.0).alias("score"))
    with pytest.raises(ValueError):
        selection.genetic(many, spark.createDataFrame([], "a string, b string, dimer boolean"), 3)
    with pytest.raises(ValueError):
        simulation.delta_g_histogram(many, spark.createDataFrame([], "kmer string, n long"), simulation.EDGES)


def test_pairs_and_hairpins(spark):
    p = spark.createDataFrame([("ACGTACGT",), ("TTTTTTTT",), ("AAAAAAAA",)], "primer string")
    d = {(r.a, r.b): r.dimer for r in pairs.dimer_table(p).collect()}
    assert d == {("AAAAAAAA", "ACGTACGT"): False, ("AAAAAAAA", "TTTTTTTT"): True, ("ACGTACGT", "TTTTTTTT"): False}
    with pytest.raises(Exception):
        pairs.candidate_pairs(p, most=2).collect()
    h = pairs.hairpins(spark.createDataFrame([("GCGCAAAAGCGC",)], "primer string")).collect()
    assert (1, 4, 4) in {(r.start, r.stem, r.loop) for r in h}


def test_genomes(spark):
    n = {r.k: r.n50 for r in genomes.n50(spark.createDataFrame([("a", x) for x in (2, 3, 4, 5, 6)], "k string, length int"), ["k"]).collect()}
    assert n == {"a": 5}
    df = spark.createDataFrame([("k%02d" % i, float(i // 3)) for i in range(20)], "kmer string, q double")
    kept = {r.kmer for r in genomes.floor_filter(df, F.col("q"), "kmer", 5.0, 0.5).collect()}
    order = sorted(((-(i // 3), "k%02d" % i) for i in range(20)))
    assert kept == {k for q, k in order if -q >= 5} | {k for _, k in order[:10]}


def test_simulations_are_reproducible(spark):
    sets = spark.createDataFrame([(1, 30, 5), (2, 0, 0)], "set_id long, fg_sites long, bg_sites long")
    a = sorted(map(tuple, simulation.gillespie(sets, 2).collect()))
    assert a == sorted(map(tuple, simulation.gillespie(sets, 2).collect())) and len(a) == 2 * 2 * 7
    assert all(x[-2:] == (0, 0) for x in a if x[0] == 2)


def test_gillespie_query_takes_all_sites(spark, tmp_path):
    rows = [(1, "AR"[i % 2], i % 7, i) for i in range(6000)]
    spark.createDataFrame(rows, "l_suppkey long, l_returnflag string, l_linenumber int, l_orderkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    last = [r for r in queries.QUERIES["gillespie_runs"](spark, str(tmp_path)).collect() if r.t == 60]
    # some 9 of 100 sites are bound at a time
    assert len(last) == 4 and all(r.fg_bound > 200 and r.bg_bound > 200 for r in last)


def test_sinks(spark):
    p = spark.createDataFrame([("ACGT",), ("AAAA",)], "primer string")
    assert [r.value for r in files.fasta_lines(p).collect()] == [">SET_001", "AAAA", ">SET_002", "ACGT"]
    assert files.order_table(p, "idt").columns == ["Name", "Sequence", "Scale", "Purification"]
    assert p.select(files.modified(F.col("primer")).alias("x")).first().x == "AC*G*T"
    assert seq.BASES == "ACGT"
