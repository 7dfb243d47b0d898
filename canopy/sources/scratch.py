"""Scratch tables below spark.checkpoint.dir, which driver and executors share: what cuts lineage is written there and read again."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@lru_cache(8)
def _session_root(spark: SparkSession, root: str) -> str:
    """This session's folder, which goes when the driver's JVM ends."""
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/canopy-{uuid.uuid4().hex}")
    files = made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(made)
    files.deleteOnExit(made)
    return str(made)


@lru_cache(1)
def _local_root() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-canopy-", dir="/tmp")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder name.  Only a plain local master may leave the setting out."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _local_root()
    return f"{_session_root(spark, root)}/{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, most_rows: int) -> DataFrame:
    """Marks a staged table for broadcast if its counted rows allow that, else leaves the join to Spark."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
