"""Sinks: BED, BedGraph, FASTA, order tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns of the vendors' order tables.
VENDORS = {
    "idt": ("Name", "Sequence", "Scale", "Purification"),
    "twist": ("name", "sequence"),
    "sigma": ("Oligo Name", "Sequence", "Scale", "Purification"),
    "generic": ("name", "sequence", "length"),
}


def bed(sites: DataFrame, length: Column) -> DataFrame:
    """``chrom, start, stop, name, score, strand``; stop is exclusive."""
    return sites.select(F.col("genome").alias("chrom"), F.col("pos").alias("start"), (F.col("pos") + length).alias("stop"), F.col("primer").alias("name"), F.lit(0).alias("score"), "strand")


def bedgraph(sites: DataFrame, window: int, length: Column) -> DataFrame:
    """Sites per fixed window; windows without sites are left out."""
    start = (F.floor(F.col("pos") / window) * window).cast("long")
    g = sites.groupBy(F.col("genome").alias("chrom"), start.alias("start")).agg(F.count("*").alias("n"))
    return g.select("chrom", "start", F.least(F.col("start") + window, length.cast("long")).alias("stop"), "n")


def fasta_lines(primers: DataFrame, order: str = "primer", prefix: str = "SET") -> DataFrame:
    """Two lines per primer, numbered in order: ``value``.  A set is small: one partition, in order."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.orderBy(order))
    two = primers.select("primer", n.alias("n")).select("n", F.posexplode(F.array(F.format_string(f">{prefix}_%03d", F.col("n")), F.col("primer"))).alias("line", "value"))
    return two.orderBy("n", "line").select("value")


def write_bed(sites: DataFrame, length: Column, path: str) -> None:
    bed(sites, length).write.option("sep", "\t").csv(path)


def order_table(primers: DataFrame, vendor: str, prefix: str = "SET") -> DataFrame:
    from pyspark.sql import Window

    n = F.format_string(f"{prefix}_%03d", F.row_number().over(Window.orderBy("primer")))
    values = {"name": n, "sequence": F.col("primer"), "length": F.length("primer"), "scale": F.lit("25nm"), "purification": F.lit("STD")}
    key = lambda c: "name" if "name" in c.lower() else c.lower()
    return primers.select(*[values[key(c)].alias(c) for c in VENDORS[vendor]])


def modified(primer: Column, bonds: int = 2, spacer: str = "") -> Column:
    """Protected bonds (``*``) before the last ``bonds`` bases, after an optional spacer."""
    head = F.substring(primer, F.lit(1), F.length(primer) - bonds)
    tail = F.transform(F.split(F.right(primer, F.lit(bonds)), ""), lambda c: F.concat(F.lit("*"), c))
    return F.concat(F.lit(spacer), head, F.array_join(tail, ""))
