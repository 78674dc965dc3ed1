"""Tables written between steps, in the folder that the session names for them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SCRATCH_KEY = "spark.checkpoint.dir"


def folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder under ``spark.checkpoint.dir``, which all executors share.
    Only a local session may leave that setting empty."""
    base = spark.conf.get(SCRATCH_KEY, None) or spark.sparkContext.getConf().get(SCRATCH_KEY)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SCRATCH_KEY} to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(SCRATCH_KEY, base)
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in a new ``folder`` and read back, so that what builds on it
    several times computes it once, and a lost executor costs a re-read."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete what was written to ``path``, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
