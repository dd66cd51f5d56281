"""Reliable intermediate results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no checkpoint folder, as in tests on one machine.
LOCAL_CHECKPOINTS = "/tmp/fotolake-checkpoints"


def _shared(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or LOCAL_CHECKPOINTS


def settled(df: DataFrame) -> DataFrame:
    """`df` checkpointed in the folder that driver and executors share; its partitions stay as they are."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(_shared(spark))
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, for files that Spark writes and reads again."""
    return f"{_shared(spark).rstrip('/')}/files-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """`df` as Parquet in the shared folder, read again: of large rows less disk than a checkpoint, and later reads take only their columns."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_files(spark: SparkSession, path: str) -> None:
    """Deletes a path of `new_path`; nothing may read it later."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear_files(spark: SparkSession) -> None:
    """Deletes what was written to paths of `new_path` in this application."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{_shared(spark).rstrip('/')}/files-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
