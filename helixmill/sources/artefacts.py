"""Artefacts of a run on shared storage: site index, step tables, sampled counts, and where a run stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEPS = ("step2", "step3", "step4")


def write_sites(sites: DataFrame, path: str) -> None:
    """``genome, primer, strand, pos`` by length of the primer, sorted by primer, so that scans skip other lengths and row groups."""
    k = sites.withColumn("k", F.length("primer"))
    k.repartition("k", "primer").sortWithinPartitions("primer", "genome", "pos").write.mode("overwrite").partitionBy("k").parquet(path)


def read_sites(spark: SparkSession, path: str, primers: list[str] | None = None, ks: list[int] | None = None) -> DataFrame:
    """The index, lazily; given primers (or lengths) become filters on partitions and pages."""
    s = spark.read.parquet(path)
    ks = ks or (sorted({len(p) for p in primers}) if primers else None)
    if ks:
        s = s.where(F.col("k").isin(ks))
    if primers:
        s = s.where(F.col("primer").isin(primers))
    return s.select("genome", "primer", "strand", "pos")


def sites_of(spark: SparkSession, path: str, primers: DataFrame) -> DataFrame:
    """Batch look-up: the sites of a table of primers, by a join."""
    return read_sites(spark, path).join(primers.select("primer").distinct(), "primer")


def write_step(df: DataFrame, folder: str, step: str, csv: bool = False) -> None:
    if step not in STEPS:
        raise ValueError(f"step must be one of {', '.join(STEPS)}")
    w = df.write.mode("overwrite")
    (w.option("header", True).csv if csv else w.parquet)(f"{folder.rstrip('/')}/{step}")


def read_step(spark: SparkSession, folder: str, step: str, csv: bool = False, schema: str | None = None) -> DataFrame:
    """A step's table; from CSV the given schema, or one that is inferred."""
    path = f"{folder.rstrip('/')}/{step}"
    if not csv:
        return spark.read.parquet(path)
    r = spark.read.option("header", True)
    return r.schema(schema).csv(path) if schema else r.option("inferSchema", True).csv(path)


def latest_step(spark: SparkSession, folder: str) -> tuple[str, DataFrame] | None:
    """The furthest step that left a table, and the table; None where there is none."""
    for step in reversed(STEPS):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{step}/_SUCCESS")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            files = [s.getPath().getName() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path.getParent())]
            return step, read_step(spark, folder, step, csv=any(f.endswith(".csv") for f in files))
    return None


def sampled(counts: DataFrame, share: int) -> DataFrame:
    """Every ``share``-th k-mer by hash: a small stand-in for a huge background; the same k-mers whatever the genome."""
    return counts.where(F.pmod(F.xxhash64("kmer"), F.lit(share)) == 0)
