"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session, as in tests, gets a temporary folder where it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get("quire.kept.dir", "")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='quire-kept-')}"
        spark.conf.set("quire.kept.dir", where)
    return where


def own_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder whose files go when the session ends."""
    path = f"{shared_dir(spark)}/quire-{name}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read back: what several later steps use is made once, and a lost executor costs a re-read."""
    path = own_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
