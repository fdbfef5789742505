import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixmill.config import Config
from helixmill.operators import learning
from helixmill.plans import design
from helixmill.sinks import report
from helixmill.sources import readers
from helixmill.streaming import incremental


@pytest.fixture(scope="module")
def problem(spark, tmp_path_factory):
    rnd = random.Random(42)
    motif = ["ATGCATCAGA", "CTTGACATAC"]
    fg = "".join(rnd.choice("ACGT") if rnd.random() < 0.99 else "A" for _ in range(3000))
    for i in range(0, 3000, 60):
        m = motif[(i // 60) % 2]
        fg = fg[:i] + m + fg[i + len(m) :]
    bg = "".join(rnd.choice("ACGT") for _ in range(3000))
    df = lambda name, s: spark.createDataFrame([(name, s)], "genome string, seq string")
    inputs = design.Inputs(df("fg", fg), df("bg", bg))
    cfg = Config(min_k=8, max_k=8, min_fg_freq=2e-3, max_bg_freq=5e-3, max_gini=1.0, max_tm=60, min_tm=-50, gc_min=0.2, gc_max=0.8, max_primer=40, bin_size=200, target_set_size=3, max_self_dimer_bp=6, max_dimer_bp=4)
    base = tmp_path_factory.mktemp("design")
    design.step3(design.step2(design.step1(inputs, cfg), inputs, cfg)).write.parquet(f"{base}/scored")
    scored = spark.read.parquet(f"{base}/scored")
    design.all_sites(scored, inputs, cfg).write.parquet(f"{base}/sites")
    where = spark.read.parquet(f"{base}/sites")
    return inputs, cfg, scored, where


def test_candidates_are_the_planted_ones(problem):
    inputs, cfg, scored, where = problem
    rows = scored.collect()
    assert 4 <= len(rows) <= 40 and all(r.fg_count > 0 and r.gini <= 1 for r in rows)
    assert max(r.fg_count for r in rows) >= 20
    assert where.where("role = 'target'").count() >= sum(r.fg_count for r in rows)


@pytest.mark.parametrize("method", design.METHODS)
def test_methods(problem, method):
    _, cfg, scored, where = problem
    small = scored.orderBy("ratio", "primer").limit(12) if method in ("clique", "greedy") else scored
    got = [r.primer for r in design.step4(method, small, where, cfg).collect()]
    assert 1 <= len(got) <= max(cfg.target_set_size, 4) and len(set(got)) == len(got)
    assert set(got) <= {r.primer for r in scored.collect()}


def test_report(problem, spark):
    inputs, cfg, scored, where = problem
    chosen = design.step4("dominating-set", scored, where, cfg)
    lengths = inputs.target.select("genome", F.length("seq").alias("length"))
    rep = design.set_report(chosen, where, lengths, cfg)
    x = report.summary(rep)
    assert 0 <= x["coverage"] <= 1 and 0 <= x["score"] <= 1 and x["reach_coverage"] <= x["coverage"]
    assert "<table>" in report.page("Set", rep, chosen) and "phi29" in report.protocol(chosen, "phi29", 30)
    assert json.loads(report.audit(cfg, {"fg": "x"}))["parameters"]["min_k"] == 8


def test_exact_cover(spark):
    inc = spark.createDataFrame([(p, str(b)) for p, bs in {"a": [1, 2, 3, 4], "b": [1, 2, 5, 6], "c": [3, 4, 7, 8], "d": [5, 6, 7, 8]}.items() for b in bs], "primer string, bin string")
    got = {r.primer for r in design.exact_cover(inc, 2).collect()}
    assert got in ({"a", "d"}, {"b", "c"})


def test_sources(spark, tmp_path):
    f = tmp_path / "g.fasta"
    f.write_text(">one first\nATCG\nGCta\n>two\nNNNN\n")
    rows = sorted(readers.read_fasta(spark, str(f)).collect(), key=lambda r: r.contig_idx)
    assert [(r.genome, r.contig, r.contig_idx, r.length, r.seq) for r in rows] == [("g", "one", 0, 8, "ATCGGCTA"), ("g", "two", 1, 4, "NNNN")]
    s = readers.genome_stats(readers.read_fasta(spark, str(f)))
    assert s.first().gc == 0.5 and set(readers.validate(s).first().problems) == {"short", "too many N"}
    (tmp_path / "a_4mer_all.txt").write_text("ACGT 7\nAAAA 2\n")
    assert sorted(map(tuple, readers.read_kmer_dump(spark, str(tmp_path / "a_4mer_all.txt")).collect())) == [("a", 4, "AAAA", 2), ("a", 4, "ACGT", 7)]
    (tmp_path / "p.txt").write_text("acgt # x\nACGT\nxx\n")
    assert [r.primer for r in readers.read_primers(spark, str(tmp_path / "p.txt")).collect()] == ["ACGT"]


def test_learning(spark, tmp_path):
    x = np.linspace(0, 1, 12)[:, None]
    gp = learning.GaussianProcess().fit(x, np.sin(3 * x[:, 0]))
    mean, std = gp.predict(np.array([[0.5], [9.0]]))
    assert abs(mean[0] - np.sin(1.5)) < 0.05 and std[1] > std[0]
    cand = spark.createDataFrame([(i, i / 10) for i in range(11)], "id int, f double")
    assert learning.suggest(cand, gp, ["f"], 2).count() == 2
    learning.record(spark, f"{tmp_path}/log", spark.createDataFrame([(1, "m", 0.5, 0.4), (2, "m", 0.7, 0.6)], "set_id int, method string, predicted double, observed double"))
    assert learning.calibration(spark.read.parquet(f"{tmp_path}/log")).first().mean_error == pytest.approx(0.1)


def test_streaming(spark, tmp_path):
    d = spark.createDataFrame([(1, "ACGTACGT"), (2, "ACGT")], "id int, text string")
    d.write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in")
    q = incremental.kmer_counts(s, "id", "text", 4).writeStream.outputMode("complete").format("memory").queryName("kc").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.kmer: r.n for r in spark.table("kc").collect()} == {r.kmer: r.n for r in incremental.kmer_counts(d, "id", "text", 4).collect()}
    rows = spark.createDataFrame([("g", "p", "+", 1), ("g", "p", "+", 5)], "genome string, primer string, strand string, pos long")
    for _ in range(2):
        incremental.append_sites(rows, f"{tmp_path}/idx")
    assert spark.read.parquet(f"{tmp_path}/idx").count() == 2
