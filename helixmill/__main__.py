"""Command line: ``python -m helixmill <command>``."""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys

GENOMES = ("background", "blacklist", "exclusion")
#: Commands: positional arguments, and options with their defaults.
COMMANDS: dict[str, tuple[tuple[str, ...], dict]] = {
    "count-kmers": (("target",), {}), "filter": (("target",), dict.fromkeys(GENOMES)), "score": (("target",), dict.fromkeys(GENOMES)), "optimize": (("target",), dict.fromkeys(GENOMES) | {"method": "hybrid"}), "design": (("target",), dict.fromkeys(GENOMES) | {"method": "hybrid"}),
    "auto-pipeline": (("target",), dict.fromkeys(GENOMES) | {"polymerase": "phi29", "method": "hybrid"}), "multi-genome": (("target",), dict.fromkeys(GENOMES)), "build-filter": (("background",), {"share": 1}),
    "analyze-genome": (("target",), {}), "analyze-dimers": (("primers",), {}), "analyze-stability": (("primers",), {}), "analyze-set": (("primers", "target"), {"background": None}), "predict-efficiency": (("primers", "target"), {"background": None}), "rescore-set": (("primers", "target"), {"background": None}),
    "expand-primers": (("primers", "candidates", "target"), {"add": 6}), "swap-primer": (("primers", "candidates", "target", "old"), {}), "contract-set": (("primers", "target"), {"size": 6}), "optimize-conditions": (("primers",), {}),
    "suggest": ((), {"genome_gc": 0.5, "length": 1_000_000, "k": 10, "application": "enrichment", "celsius": 30.0, "betaine": 0.0, "dmso": 0.0}), "simulate": (("primers", "target"), {"replicates": 4}),
    "report": (("folder",), {}), "interpret": (("folder",), {}), "export": (("primers", "target"), {"format": "fasta", "vendor": "generic"}),
    "genome-add": (("registry", "name", "path"), {"role": "target"}), "genome-list": (("registry",), {}), "genome-remove": (("registry", "name"), {}), "background-add": (("registry", "name", "path"), {"role": "background"}), "background-list": (("registry",), {"discover": None}),
    "init": (("params",), {"polymerase": "phi29"}), "schema": ((), {}), "validate-params": (("params",), {}), "show-presets": ((), {}), "list-methods": ((), {}), "doctor": ((), {}),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="helixmill")
    sub = top.add_subparsers(dest="command", required=True)
    for name, (paths, options) in COMMANDS.items():
        p = sub.add_parser(name)
        for x in paths:
            p.add_argument(x)
        for k, v in options.items():
            p.add_argument(f"--{k.replace('_', '-')}", default=v, type=type(v) if v is not None else str)
        p.add_argument("--config")
        p.add_argument("--out")
    return top


def driver_only(args, cfg) -> str | None:
    """Commands that need no session: their text, or None for the others."""
    from helixmill.config import K_RANGE, Config
    from helixmill.functions import conditions, thermo
    from helixmill.plans import design

    if args.command == "list-methods":
        return "\n".join(design.METHODS)
    if args.command == "validate-params":
        return "ok"
    if args.command == "schema":
        return json.dumps({f.name: {"type": f.type, "default": f.default} for f in dataclasses.fields(Config)}, indent=2)
    if args.command == "show-presets":
        return json.dumps({name: dataclasses.asdict(Config.for_polymerase(name)) for name in K_RANGE}, indent=2)
    if args.command == "init":
        with open(args.params, "x") as f:
            json.dump(dataclasses.asdict(Config.for_polymerase(args.polymerase)), f, indent=2)
        return args.params
    if args.command == "suggest":
        c = conditions.Conditions(polymerase=cfg.polymerase, celsius=args.celsius, betaine=args.betaine, dmso=args.dmso)
        e = conditions.enzyme(c, args.genome_gc)
        size = conditions.set_size(args.application, args.length, args.k, e["processivity"], reach=thermo.POLYMERASES[cfg.polymerase][0])
        return json.dumps({"criteria": conditions.criteria(c, args.genome_gc), "max_length": conditions.max_length(c), "enzyme": e, "accessibility": conditions.accessibility(c, args.genome_gc), "set_size": size}, indent=2)
    return None


def registry(spark, args):
    from helixmill.sources.readers import read_fasta
    from helixmill.sources.registry import Registry

    reg = Registry(spark, args.registry)
    if args.command.endswith("-add"):
        from pyspark.sql import functions as F

        reg.add(args.name, args.path, args.role, read_fasta(spark, args.path).agg(F.sum("length").alias("n")).first()["n"] or 0)
    elif args.command.endswith("-remove"):
        reg.remove(args.name)
    elif getattr(args, "discover", None):
        return reg.discover(args.discover)
    out = reg.list()
    return out.where("role = 'background'") if args.command == "background-list" else out


def of_sets(spark, args, cfg):
    """Commands on a list of primers, most of them with a target."""
    from pyspark.sql import functions as F

    from helixmill.functions import thermo
    from helixmill.operators import networks, pairs, quality, simulation, sites
    from helixmill.plans import design
    from helixmill.sinks import files
    from helixmill.sources import readers

    own = readers.read_primers(spark, args.primers)
    if args.command == "analyze-dimers":
        return pairs.profiles(pairs.dimer_table(own, cfg.max_dimer_bp))
    p = F.col("primer")
    if args.command == "analyze-stability":
        return own.select("primer", quality.three_prime_score(p).alias("score"), quality.three_prime_reason(p).alias("reason"), thermo.effective_tm(p, cfg.na_conc, cfg.mg_conc, cfg.temperature).alias("tm"))
    if args.command == "optimize-conditions":
        return quality.best_conditions(quality.condition_grid(own, [30.0, 37.0, 42.0, 45.0], [0.0, 2.5, 5.0], [0.0, 0.5, 1.0, 1.5])).orderBy(F.desc("score"))
    target = readers.read_fasta(spark, args.target).select("genome", "seq")
    back = readers.read_fasta(spark, args.background).select("genome", "seq") if getattr(args, "background", None) else None
    inputs = design.Inputs(target, back)
    pool = readers.read_primers(spark, args.candidates).unionByName(own).distinct() if hasattr(args, "candidates") else own
    where = design.all_sites(pool, inputs, cfg).cache()
    fg = where.where("role = 'target'")
    lengths = target.groupBy("genome").agg(F.sum(F.length("seq")).alias("length"))
    inc = sites.bins_of(fg, ["primer", "genome"], thermo.POLYMERASES[cfg.polymerase][1], cfg.bin_size).select("primer", F.concat_ws(":", "genome", F.col("bin").cast("string")).alias("bin"))
    members = networks.pool_names(own)
    named = lambda names: spark.createDataFrame([(x,) for x in names], "primer string")
    if args.command == "expand-primers":
        return named([*members, *(r["primer"] for r in networks.expand(inc, members, args.add).collect())])
    if args.command == "swap-primer":
        return named(networks.swap(inc, members, args.old.upper()))
    if args.command == "contract-set":
        return named(networks.contract(inc, members, args.size))
    if args.command == "simulate":
        s = fg.join(lengths, "genome").groupBy("genome").agg(F.array_sort(F.collect_list(F.struct("pos", "strand"))).alias("x"), F.max("length").alias("length"))
        s = s.select(F.shiftrightunsigned(F.xxhash64("genome"), 1).alias("set_id"), "length", F.transform("x", lambda y: y["pos"]).alias("starts"), F.transform("x", lambda y: F.when(y["strand"] == "+", 1).otherwise(-1)).alias("directions"))
        return simulation.summary(simulation.replication(s, args.replicates), ["set_id"], "coverage")
    if args.command == "export":
        if args.format == "bed":
            return files.bed(fg, F.length("primer"))
        if args.format == "bedgraph":
            return files.bedgraph(fg.join(lengths, "genome"), cfg.bin_size, F.col("length"))
        return files.order_table(own, args.vendor) if args.format == "order" else files.fasta_lines(own)
    report = design.set_report(own, where, lengths, cfg)
    if args.command == "predict-efficiency":
        return report.select(quality.efficiency(F.col("coverage"), F.col("selectivity"), F.col("gap_gini"), F.col("dimer_risk")).alias("efficiency"))
    return report


def of_genomes(spark, args, cfg):
    from pyspark.sql import functions as F

    from helixmill.config import Config
    from helixmill.operators import genomes, kmers
    from helixmill.plans import design
    from helixmill.sources import artefacts, readers

    seqs = lambda path: readers.read_fasta(spark, path).select("genome", "seq") if path else None
    if args.command == "build-filter":
        rows = kmers.sequences(readers.read_fasta(spark, args.background), "genome", "seq", F.lit(1))
        return artefacts.sampled(kmers.count(rows, list(range(cfg.min_k, cfg.max_k + 1)), deal=True), args.share)
    if args.command == "analyze-genome":
        c = readers.read_fasta(spark, args.target)
        return readers.genome_stats(c).join(genomes.n50(c, ["genome"]).select("genome", "n50"), "genome", "left")
    if args.command == "auto-pipeline":
        cfg = Config.for_polymerase(args.polymerase)
    inputs = design.Inputs(seqs(args.target), *(seqs(getattr(args, x, None)) for x in GENOMES))
    counts = design.step1(inputs, cfg)
    if args.command == "count-kmers":
        return counts
    if args.command == "multi-genome":
        totals = kmers.lengths(inputs.all(), "role")
        return genomes.blended(counts, totals, {"target": 0, "background": 1, "blacklist": 2}).where("target_freq > 0").orderBy("penalty", F.desc("target_freq")).limit(cfg.max_primer)
    if args.command in ("filter", "score"):
        found = design.step2(counts, inputs, cfg)
        return found if args.command == "filter" else design.step3(found)
    chosen, report = design.run_optimization(args.method, inputs, cfg)
    return chosen.join(report.select(F.struct("*").alias("report")))


def of_results(spark, args):
    from pyspark.sql import functions as F

    from helixmill.sources import artefacts

    found = artefacts.latest_step(spark, args.folder)
    if found is None:
        raise ValueError(f"no results in {args.folder}")
    step, df = found
    numbers = [c for c, t in df.dtypes if t in ("int", "bigint", "double", "float")]
    if args.command == "report":
        return df.agg(F.lit(step).alias("step"), F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in numbers])
    return df.agg(F.lit(step).alias("step"), F.when(F.count("*") >= 6, "good").when(F.count("*") > 0, "few primers").otherwise("empty").alias("verdict"))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from helixmill.config import Config

    try:
        path = args.params if args.command == "validate-params" else args.config
        cfg = Config.read(path) if path else Config()
    except (ValueError, TypeError) as e:
        print(f"invalid parameters: {e}", file=sys.stderr)
        return 2
    text = driver_only(args, cfg)
    if text is not None:
        print(text)
        return 0

    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("helixmill").getOrCreate()
    if args.command == "doctor":
        print(json.dumps({"spark": spark.version, "master": spark.sparkContext.master, "rows": spark.range(10).count(), "checkpoint_dir": spark.conf.get("spark.checkpoint.dir", "")}))
        return 0
    first = COMMANDS[args.command][0][0]
    out = registry(spark, args) if first == "registry" else of_results(spark, args) if first == "folder" else of_sets(spark, args, cfg) if first == "primers" else of_genomes(spark, args, cfg)
    if args.out:
        out.write.mode("overwrite").parquet(args.out)
    else:
        out.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
