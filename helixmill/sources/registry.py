"""Catalogue of genomes by name, kept as a table in a shared folder."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "name string, path string, role string, length long, gone boolean, version long"


class Registry:
    """Append-only log of entries; the last version of a name counts, removal is an entry too."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _log(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], SCHEMA)
            raise

    def list(self) -> DataFrame:
        w = Window.partitionBy("name").orderBy(F.desc("version"))
        last = self._log().withColumn("n", F.row_number().over(w)).where("n = 1 and not gone")
        return last.select("name", "path", "role", "length")

    def _append(self, name: str, path: str | None, role: str | None, length: int | None, gone: bool) -> None:
        version = time.time_ns()  # not read from the log, so that writers don't take each other's number
        self.spark.createDataFrame([(name, path, role, length, gone, version)], SCHEMA).write.mode("append").parquet(self.path)

    def add(self, name: str, path: str, role: str, length: int) -> None:
        self._append(name, path, role, length, False)

    def remove(self, name: str) -> bool:
        if self.get(name) is None:
            return False
        self._append(name, None, None, None, True)
        return True

    def get(self, name: str):
        return self.list().where(F.col("name") == name).first()

    def search(self, part: str) -> DataFrame:
        return self.list().where(F.contains(F.lower("name"), F.lit(part.lower())))

    def discover(self, folder: str) -> DataFrame:
        """FASTA files below a folder that no entry names: ``path, bytes``."""
        found = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.{fa,fasta,fna,fa.gz,fasta.gz,fna.gz}").option("recursiveFileLookup", True).load(folder)
        return found.select("path", F.col("length").alias("bytes")).join(self.list().select("path"), "path", "left_anti")
