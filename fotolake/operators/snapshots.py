"""Snapshots of a store's tables: several tables under one manifest that is written last.

A snapshot is a folder named by its time. Its tables are Parquet; its manifest, a small table of their names, rows and schemas, is the
last to be committed, so a snapshot without one was torn and is never read. Old folders go by the rule of `session.stale_backups`.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fotolake.operators.session import stale_backups

#: Fixed value: snapshots kept.
KEPT = 5
MANIFEST = "table string, rows long, schema string"


def _fs(spark: SparkSession, root: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def backup(spark: SparkSession, tables: dict[str, DataFrame], root: str, stamp: str, only: int | None = None) -> None:
    """Writes a snapshot `stamp` (YYYY-MM-DD HHMMSS) below `root`. `only`: stops after so many tables, as a driver that dies does.

    Rows are counted from what was written, so the manifest tells what a reader must find.
    """
    rows = []
    for i, (name, df) in enumerate(tables.items()):
        if only is not None and i >= only:
            return
        df.write.parquet(f"{root}/{stamp}/{name}")
        rows.append((name, spark.read.schema(df.schema).parquet(f"{root}/{stamp}/{name}").count(), df.schema.json()))
    if only is None:
        spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{root}/{stamp}/manifest")


def folders(spark: SparkSession, root: str) -> DataFrame:
    """(name, whole) of the folders below `root`: a driver's listing, one entry a snapshot."""
    path, fs = _fs(spark, root)
    names = [x.getPath().getName() for x in fs.listStatus(path) if x.isDirectory()] if fs.exists(path) else []
    whole = [fs.exists(_fs(spark, f"{root}/{n}/manifest/_SUCCESS")[0]) for n in names]
    return spark.createDataFrame(list(zip(names, whole, strict=True)), "name string, whole boolean")


def newest(spark: SparkSession, root: str) -> str | None:
    """The name of the newest whole snapshot."""
    return folders(spark, root).where("whole").agg(F.max("name")).first()[0]


def restore(spark: SparkSession, root: str, stamp: str | None = None) -> dict[str, DataFrame]:
    """The tables of a snapshot, the newest whole one if none is named; a table with other rows than its manifest tells raises."""
    stamp = stamp or newest(spark, root)
    if stamp is None:
        raise FileNotFoundError(f"no whole snapshot below {root}")
    out = {}
    for m in spark.read.schema(MANIFEST).parquet(f"{root}/{stamp}/manifest").collect():  # a row a table
        df = spark.read.schema(T.StructType.fromJson(json.loads(m["schema"]))).parquet(f"{root}/{stamp}/{m['table']}")
        if df.count() != m["rows"]:
            raise ValueError(f"{stamp}/{m['table']} has other rows than its manifest")
        out[m["table"]] = df
    return out


def prune(spark: SparkSession, root: str, keep: int = KEPT) -> list[str]:
    """Deletes old snapshots: those beyond the newest `keep` whole ones, and torn ones older than the newest whole one. Returns their names."""
    there = folders(spark, root)
    last = newest(spark, root)
    old = [r["name"] for r in stale_backups(there.where("whole").select("name"), keep).collect()]
    old += [r["name"] for r in stale_backups(there.where(~F.col("whole") & (F.col("name") < F.lit(last or ""))).select("name"), 0).collect()]
    for name in old:
        path, fs = _fs(spark, f"{root}/{name}")
        fs.delete(path, True)
    return sorted(old)
