"""Sources: FASTA, k-mer dumps, primer lists, any string column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixmill.functions import seq


def read_fasta(spark: SparkSession, path: str, genome: str | None = None) -> DataFrame:
    """``genome, contig, contig_idx, length, seq``, one row per record, upper-cased.

    Records are split by the reader itself (``\\n>``), so no line goes through
    Python; ``.gz`` and other codecs follow from the file's suffix.  ``genome``
    is the file's name unless given.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select("value", F.input_file_name().alias("file"))
    name = F.lit(genome) if genome else F.regexp_extract("file", r"([^/]+?)(?:\.(?:fa|fasta|fna))?(?:\.gz)?$", 1)
    rec = raw.where(F.length(F.trim("value")) > 0).select(name.alias("genome"), "file", F.regexp_replace("value", r"^\s*>", "").alias("v"), F.monotonically_increasing_id().alias("__at"))
    head = F.regexp_extract("v", r"^([^\r\n]*)", 1)
    body = F.upper(F.regexp_replace(F.regexp_replace("v", r"^[^\r\n]*", ""), r"\s+", ""))
    out = rec.select("genome", F.element_at(F.split(head, r"\s+"), 1).alias("contig"), (F.row_number().over(Window.partitionBy("file").orderBy("__at")) - 1).alias("contig_idx"), body.alias("seq"))
    return out.select("genome", "contig", "contig_idx", F.length("seq").cast("long").alias("length"), "seq")


def genome_stats(contigs: DataFrame) -> DataFrame:
    """Length, contigs, GC and share of N per genome."""
    n = F.sum(F.length("seq") - F.length(F.translate("seq", "N", "")))
    acgt = F.sum(F.length(F.regexp_replace("seq", "[^ACGT]", "")))
    return contigs.groupBy("genome").agg(F.sum("length").alias("length"), F.count("*").alias("contigs"), F.count_if(F.col("length") == 0).alias("empty"), (F.sum(F.length(F.regexp_replace("seq", "[^GC]", ""))) / F.nullif(acgt, F.lit(0))).alias("gc"), (n / F.nullif(F.sum("length"), F.lit(0))).alias("n_share"))


def validate(stats: DataFrame, least: int = 100_000) -> DataFrame:
    """``genome, problems``: too short, too many N, empty records, GC out of 0.15 to 0.85."""
    p = F.array_compact(F.array(F.when(F.col("length") < least, "short"), F.when(F.col("n_share") > 0.10, "too many N"), F.when(F.col("empty") > 0, "empty record"), F.when(~F.coalesce(F.col("gc"), F.lit(0.0)).between(0.15, 0.85), "GC out of range")))
    return stats.select("genome", p.alias("problems"))


def read_kmer_dump(spark: SparkSession, path: str) -> DataFrame:
    """``genome, k, kmer, n`` of space-separated dumps named ``<genome>_<k>mer_all.txt``."""
    d = spark.read.option("sep", " ").schema("kmer string, n long").csv(path).withColumn("file", F.input_file_name())
    return d.select(F.regexp_extract("file", r"([^/]+)_\d+mer_all\.txt$", 1).alias("genome"), F.length("kmer").alias("k"), "kmer", "n")


def read_primers(spark: SparkSession, path: str) -> DataFrame:
    """Valid primers of a list file, each once, first come first; ``#`` starts a comment."""
    at = F.struct(F.input_file_name(), F.monotonically_increasing_id())  # order of the lines in their file
    d = spark.read.text(path).select(F.upper(F.trim(F.regexp_replace("value", "#.*", ""))).alias("primer"), at.alias("at"))
    return d.where(F.rlike("primer", F.lit("^[ACGT]+$"))).groupBy("primer").agg(F.min("at").alias("at")).orderBy("at").select("primer")


def from_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """Any string column as sequences."""
    return df.select(F.col(key).cast("string").alias("genome"), F.lit("0").alias("contig"), F.lit(0).alias("contig_idx"), seq.clean(F.col(text)).alias("seq")).withColumn("length", F.length("seq").cast("long"))
