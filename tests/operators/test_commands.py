"""Every command of the command line, on small files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from helixmill.__main__ import COMMANDS, main
from helixmill.sources import artefacts, readers
from helixmill.sources.registry import Registry


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    base = tmp_path_factory.mktemp("commands")
    rnd = random.Random(3)
    seq = "".join(rnd.choice("ACGT") for _ in range(2500))
    motif = "ATGCATCAGA"
    for i in range(0, 2500, 100):
        seq = seq[:i] + motif + seq[i + 10 :]
    (base / "t.fa").write_text(f">t one\n{seq}\n")
    (base / "b.fa").write_text(">b\n" + "".join(rnd.choice("ACGT") for _ in range(2500)) + "\n")
    (base / "p.txt").write_text("TGCATCAG\nATGCATCA\nGCATCAGA\nATGCATCA # again\n")
    (base / "c.txt").write_text("CATCAGAA\n" + "\n".join(seq[i : i + 8] for i in range(200, 1200, 130)) + "\n")
    (base / "params.json").write_text(json.dumps({"min_k": 8, "max_k": 8, "bin_size": 200, "min_fg_freq": 1e-3, "max_bg_freq": 5e-3, "max_gini": 1.0, "min_tm": -50, "max_tm": 60, "target_set_size": 2, "max_primer": 20}))
    return base


def test_driver_commands(files, capsys):
    assert main(["list-methods"]) == 0 and "network" in capsys.readouterr().out
    assert main(["schema"]) == 0 and "max_gini" in json.loads(capsys.readouterr().out)
    assert main(["show-presets"]) == 0 and set(json.loads(capsys.readouterr().out)) == {"phi29", "equiphi29", "bst", "klenow"}
    assert main(["suggest", "--genome-gc", "0.7", "--betaine", "1.0"]) == 0 and json.loads(capsys.readouterr().out)["max_length"] == 15
    assert main(["init", str(files / "new.json")]) == 0 and main(["validate-params", str(files / "new.json")]) == 0
    (files / "bad.json").write_text('{"min_k": 40}')
    assert main(["validate-params", str(files / "bad.json")]) == 2
    (files / "typo.json").write_text('{"max_ginny": 1}')
    with pytest.warns(UserWarning, match="max_ginny"):
        assert main(["validate-params", str(files / "typo.json")]) == 0


def test_set_commands(spark, files):
    base, out = str(files), str(files / "out")
    run = lambda name, *more: (main([name, *more, "--config", f"{base}/params.json", "--out", out]), spark.read.parquet(out).collect())[1]
    own, cand, target = f"{base}/p.txt", f"{base}/c.txt", f"{base}/t.fa"
    assert len(run("analyze-dimers", own)) == 3 and len(run("analyze-stability", own)) == 3 and len(run("optimize-conditions", own)) == 4 * 3 * 4
    (files / "lone.txt").write_text("GGGGGGGG\n")
    # a set that covers all bins gains nothing; one without sites gains a primer that does
    assert len(run("expand-primers", own, cand, target, "--add", "2")) == 3 and len(run("expand-primers", f"{base}/lone.txt", cand, target, "--add", "1")) == 2
    assert len(run("contract-set", own, target, "--size", "2")) == 2
    assert len(run("swap-primer", own, cand, target, "ATGCATCA")) == 3
    for name in ("analyze-set", "rescore-set", "predict-efficiency", "simulate"):
        assert len(run(name, own, target)) == 1
    assert len(run("export", own, target)) == 6 and len(run("export", own, target, "--format", "bed")) >= 75


def test_genome_commands(spark, files):
    base, out = str(files), str(files / "out2")
    run = lambda name, *more: (main([name, *more, "--config", f"{base}/params.json", "--out", out]), spark.read.parquet(out).collect())[1]
    target, back = f"{base}/t.fa", f"{base}/b.fa"
    assert run("analyze-genome", target)[0].length == 2500
    n = len(run("build-filter", back))
    assert 0 < len(run("build-filter", back, "--share", "4")) < n
    assert run("multi-genome", target, "--background", back) and run("filter", target, "--background", back)
    assert 1 <= len(run("design", target, "--background", back, "--method", "network")) <= 2


def test_registry_and_results(spark, files):
    reg = f"{files}/registry"
    assert main(["genome-add", reg, "one", f"{files}/t.fa"]) == 0 and main(["background-add", reg, "two", f"{files}/b.fa"]) == 0
    r = Registry(spark, reg)
    assert {x.name: x.length for x in r.list().collect()} == {"one": 2500, "two": 2500}
    assert main(["genome-remove", reg, "two"]) == 0 and r.get("two") is None and r.get("one").role == "target"
    assert {x.path.rsplit("/", 1)[1] for x in r.discover(str(files)).collect()} == {"t.fa", "b.fa"}
    folder = f"{files}/run"
    assert artefacts.latest_step(spark, folder) is None
    df = spark.createDataFrame([("ACGT", 2.0), ("GGGT", 1.0)], "primer string, score double")
    artefacts.write_step(df, folder, "step2")
    artefacts.write_step(df.limit(1), folder, "step3", csv=True)
    step, got = artefacts.latest_step(spark, folder)
    assert step == "step3" and got.count() == 1 and got.schema["score"].dataType.simpleString() == "double"
    assert main(["report", folder]) == 0 and main(["interpret", folder]) == 0


def test_site_index(spark, files):
    rows = [("g", p, "+", i) for i, p in enumerate(["ACGT", "ACGTA", "GGGT", "GGGTT", "ACGT"])]
    sites = spark.createDataFrame(rows, "genome string, primer string, strand string, pos long")
    artefacts.write_sites(sites, f"{files}/sites")
    assert artefacts.read_sites(spark, f"{files}/sites").count() == 5
    one = artefacts.read_sites(spark, f"{files}/sites", ["ACGT"])
    assert one.count() == 2 and "PartitionFilters: [isnotnull(k" in one._jdf.queryExecution().toString()
    assert artefacts.sites_of(spark, f"{files}/sites", sites.where(F.length("primer") == 5)).count() == 2
    order = [r.primer for r in readers.read_primers(spark, f"{files}/p.txt").collect()]
    assert order == ["TGCATCAG", "ATGCATCA", "GCATCAGA"]


def test_all_commands_are_known():
    assert len(COMMANDS) == 34
