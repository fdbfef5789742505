"""Queries against their SQL on tables that the small scales don't have."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from helixmill.operators import vectors
from helixmill.plans import queries


def against_sql(spark, folder, name, **tables):
    c = duckdb.connect()
    for t, rows in tables.items():
        pq.write_table(rows, f"{folder}/{t}.parquet")
        c.register(t, rows)
    want = c.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, str(folder)).select(*want.columns)
    want = sorted(want.fetchall(), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == want and want
    return want


def lines(at=None):
    """Sites within the length of 1,000,000, around it, past it, twice at a place past it, and of no genome."""
    at = at or {1: [5, 400, 1500, 999_700], 2: [300, 999_990, 1_000_010, 1_000_060, 1_000_061, 1_000_400], 3: [2_000_000, 2_000_000, 2_000_500], 4: [1_000_060], None: [70, 5_000, 1_000_300]}
    rows = [(g, p, i + 1, "RAN"[i % 3]) for g, ps in at.items() for i, p in enumerate(ps)]
    kinds = {"l_suppkey": pa.int64(), "l_orderkey": pa.int64(), "l_linenumber": pa.int32(), "l_returnflag": pa.string()}
    return pa.table({k: pa.array(x, t) for (k, t), x in zip(kinds.items(), zip(*rows, strict=True), strict=True)})


def test_coverage_union_past_the_end(spark, tmp_path):
    assert {r[0] for r in against_sql(spark, tmp_path, "coverage_union", lineitem=lines())} == {1, 2, 3, 4, None}


def test_coverage_holes_past_the_end(spark, tmp_path):
    assert {r[0] for r in against_sql(spark, tmp_path, "coverage_holes", lineitem=lines())} == {1, 2, 3, 4, None}


def test_efficiency_prediction_past_the_end(spark, tmp_path):
    assert {r[0] for r in against_sql(spark, tmp_path, "efficiency_prediction", lineitem=lines())} == {1, 2, 3}


def test_quality_grade_past_the_end(spark, tmp_path):
    assert {r[0] for r in against_sql(spark, tmp_path, "quality_grade", lineitem=lines())} == {1, 2, 3}


def test_set_metrics_past_the_end(spark, tmp_path):
    assert {r[0] for r in against_sql(spark, tmp_path, "set_metrics", lineitem=lines())} == {1, 2, 3}


def test_set_metrics_of_halves_far_past_the_end(spark, tmp_path):
    """Scores whose seventh decimal is a 5 that a double doesn't hold."""
    far = {g: [p, p + step] for g, (p, step) in enumerate(((base + i, step) for base in (5_000_000, 6_000_000_000, 24_000_000_000) for i in range(40) for step in (1, 34)), 1)}
    assert len(against_sql(spark, tmp_path, "set_metrics", lineitem=lines(far))) == len(far)


def test_set_metrics_of_halves_by_fixed_parts(spark, tmp_path):
    """Scores near 0 that are halves only if the fixed parts are weighed as decimals."""
    far = {g: [p, p + step] for g, (p, step) in enumerate(((base + i, step) for base in (1_999_950, 2_000_100) for i in range(100) for step in (1, 7, 60)), 1)}
    assert len(against_sql(spark, tmp_path, "set_metrics", lineitem=lines(far))) == len(far)


def test_quality_grade_of_halves(spark, tmp_path):
    """Scores whose seventh decimal is a 5: even gaps and 8, 24 or 64 background sites, within the length and past it."""
    kinds = {"l_suppkey": pa.int64(), "l_orderkey": pa.int64(), "l_linenumber": pa.int32(), "l_returnflag": pa.string()}
    sets = [(base, step, bg, fg) for base, step in ((2_000_000, 1), (500, 121)) for bg in (8, 24, 64) for fg in range(1, 120, 2)]
    rows = [(g, base + i * step, i, "R" if i < bg else "A") for g, (base, step, bg, fg) in enumerate(sets) for i in range(bg + fg)]
    table = pa.table({k: pa.array(x, t) for (k, t), x in zip(kinds.items(), zip(*rows, strict=True), strict=True)})
    assert len(against_sql(spark, tmp_path, "quality_grade", lineitem=table)) == len(sets)


def test_r_scaled(spark):
    """DuckDB's rounding at halves, next to them, past the whole doubles, of no number and none."""
    xs = [random.Random(5).randrange(-(10**12), 10**12) / 2e6 for _ in range(2000)] + [0.0, 0.4999999999999999e-6, 5e-7, -5e-7, 1.5e-6, 2.0**52 / 1e6, 4503599627.370497, -9007199254.740993, 1e17, -1e300, float("nan"), float("inf"), None]
    want = duckdb.execute("SELECT round(x, 6) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [xs]).fetchall()
    got = spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1).select(queries.r_scaled(F.col("x"))).collect()
    assert list(map(str, (g[0] for g in got))) == list(map(str, (w[0] for w in want)))


def embeddings(n=700):
    """Vectors of which many are equal, opposite or zero's neighbours; every seventh is one and the same."""
    rnd = random.Random(4)
    vs = [[1.0, 2.0, 3.0, 4.0] if i % 7 == 0 else [rnd.choice((-1.0, -0.5, 0.25, 1.0)) for _ in range(4)] for i in range(n)]
    return pa.table({"vec_id": pa.array(range(n), pa.int64()), "embedding": pa.array(vs, pa.list_(pa.float32()))})


def test_cosine_top_k_of_small_blocks(spark, tmp_path, monkeypatch):
    for name, size in {"ASKED": 11, "BLOCK": 90, "ROWS": 3, "COLUMNS": 17}.items():
        monkeypatch.setattr(vectors, name, size)
    against_sql(spark, tmp_path, "cosine_top_k", embeddings=embeddings())
    rows, n = vectors.dealt(spark.createDataFrame([(i, [1.0, float(i)]) for i in range(20)], "id long, v array<double>"), "b", 6)
    assert n == 4 and sorted(r.id for r in rows.collect()) == list(range(20))  # no row holds a block
