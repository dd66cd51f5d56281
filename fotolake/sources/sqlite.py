"""SQLite files as a Spark data source, read only, from a copy.

`spark.dataSource.register(SqliteSource)`, then `spark.read.format("sqlite").option("path", ...).option("table", ...)` with
optional `partitions`: row-id ranges that executors read apart. All executors must reach the path. The file is copied with
its write-ahead log before it is opened, so the original is never touched. TEXT stored as a zlib blob (a 4-byte length before
the stream) is inflated; integers, reals, text and blobs keep their types; a column declared as anything else is text.
"""

from __future__ import annotations

import os
import shutil
import sqlite3
import tempfile
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType


@contextmanager
def opened(path: str) -> Iterator[sqlite3.Connection]:
    """A connection to a private copy."""
    with tempfile.TemporaryDirectory() as d:
        copy = os.path.join(d, "copy.db")
        shutil.copyfile(path, copy)
        if os.path.exists(path + "-wal") and os.path.getsize(path + "-wal"):
            shutil.copyfile(path + "-wal", copy + "-wal")
        con = sqlite3.connect(copy)
        con.text_factory = lambda b: b.decode("utf-8", "replace")
        try:
            yield con
        finally:
            con.close()


def tables(path: str) -> set[str]:
    with opened(path) as con:
        return {r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view')")}


def columns(con: sqlite3.Connection, table: str) -> list[tuple[str, str]]:
    return [(r[1], (r[2] or "").upper()) for r in con.execute(f'PRAGMA table_info("{table.replace(chr(34), chr(34) * 2)}")')]


def text_of(v) -> str | None:
    """Text that is stored as such or as a 4-byte length and a zlib stream."""
    if isinstance(v, bytes):
        if len(v) <= 4:
            return None
        try:
            return zlib.decompress(v[4:]).decode("utf-8")
        except (zlib.error, UnicodeDecodeError):
            return None
    return None if v is None else str(v)


def _type(declared: str):
    if "INT" in declared:
        return LongType()
    if any(x in declared for x in ("REAL", "FLOA", "DOUB", "NUMERIC")):
        return DoubleType()
    return BinaryType() if declared == "BLOB" else StringType()


class _Range(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.fields = [(f.name, type(f.dataType).__name__) for f in schema.fields]
        self.path, self.table, self.count = options["path"], options["table"], int(options.get("partitions", "1"))

    def partitions(self) -> list[_Range]:
        with opened(self.path) as con:
            low, high = con.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return [_Range(0, 0)]
        step = -(-(high - low + 1) // self.count)
        return [_Range(at, min(at + step - 1, high)) for at in range(low, high + 1, step)]

    def read(self, part: _Range) -> Iterator[tuple]:
        names = ", ".join(f'"{n}"' for n, _ in self.fields)
        convert = {"LongType": lambda v: int(float(v)), "DoubleType": float, "StringType": text_of, "BinaryType": lambda v: v if isinstance(v, bytes) else str(v).encode()}
        with opened(self.path) as con:
            for row in con.execute(f'SELECT {names} FROM "{self.table}" WHERE rowid BETWEEN ? AND ? ORDER BY rowid', (part.low, part.high)):
                yield tuple(None if v is None else convert[t](v) for v, (_, t) in zip(row, self.fields, strict=True))


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> StructType:
        with opened(self.options["path"]) as con:
            found = columns(con, self.options["table"])
        if not found:
            raise ValueError(f"no table {self.options['table']}")
        return StructType([StructField(n, _type(t)) for n, t in found])

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(schema, dict(self.options))


def read(spark: SparkSession, path: str, table: str, partitions: int = 1):
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").option("path", path).option("table", table).option("partitions", str(partitions)).load()
