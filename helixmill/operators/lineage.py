"""Cutting the lineage of loops: a table in the shared folder, never a local checkpoint."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_OWN: dict[str, str] = {}


def cut(df: DataFrame) -> DataFrame:
    """Writes a table under ``spark.checkpoint.dir`` and reads it back; it goes with the driver.

    Only a local session may leave that unset; a folder of this machine serves then.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not base:
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="helixmill-cut-")
        base = _OWN[app]
    path = f"{base.rstrip('/')}/cut-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
