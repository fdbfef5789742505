"""Helpers shared by the corpus operators: shared storage, word splitting, sizes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Spark's own setting: the shuffle files of a plan go when its execution ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_OWN: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Taken from ``spark.checkpoint.dir``.  Only where that is unset and the
    master is local (tests) a folder of this machine is set up and remembered;
    on a cluster it must be set, as executors don't see each other's folders.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not where:
        where = _OWN.setdefault(spark.sparkContext.applicationId, "")
        if not where:
            where = _OWN[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="helixmill-")
    return where.rstrip("/")


class Stash:
    """Tables written to the shared folder to cut lineage.

    ``put`` writes a DataFrame as Parquet and reads it back: a lost executor
    then costs a re-read, not a re-run.  The shuffle files of the job that wrote
    it go as it ends.  ``drop`` deletes tables that later ones have replaced;
    the rest go with the driver's JVM, as results are lazy and still read them.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/helixmill-{uuid.uuid4().hex}"
        self.n = 0
        self.paths: dict[int, str] = {}
        path, store = self._at(self.base)
        store.deleteOnExit(path)

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{self.n}"
        self.n += 1
        conf = self.spark.conf
        held, cleaned = conf.get(BATCH), conf.get(CLEANUP)
        conf.set(BATCH, min(int(held), 2000) if int(held) > 0 else 2000)  # whole texts: small batches bound the workers' memory
        conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            conf.set(BATCH, held)
            conf.set(CLEANUP, cleaned)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def folder(self) -> str:
        """A new folder beside the tables."""
        self.n += 1
        return f"{self.base}/{self.n - 1}"

    def drop(self, *frames: DataFrame) -> None:
        for f in frames:
            path = self.paths.pop(id(f), None)
            if path:
                self._delete(path)

    def drop_others(self, *kept: DataFrame) -> None:
        """Delete all tables but these."""
        paths = {self.paths[id(f)] for f in kept}
        for i, path in list(self.paths.items()):
            if path not in paths:
                self._delete(path)
                del self.paths[i]

    def _at(self, path: str) -> tuple:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _delete(self, path: str) -> None:
        p, store = self._at(path)
        store.delete(p, True)


def few_rows(df: DataFrame, most: int) -> bool:
    """Whether a table has at most ``most`` rows; reads no more than ``most + 1`` of them."""
    return df.limit(most + 1).count() <= most


def maybe_broadcast(df: DataFrame, most: int) -> DataFrame:
    """Broadcast hint only behind a count; larger tables keep a shuffle join."""
    return F.broadcast(df) if few_rows(df, most) else df


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  Texts of ASCII alone take the quick built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def blank_words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none.

    White space becomes one character so that the split takes Java's quick
    path for a single literal character.
    """
    t = F.coalesce(text, F.lit(""))
    for c in ("\t", "\n", "\x0b", "\x0c", "\r"):
        t = F.replace(t, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(t, " ", -1), "")
