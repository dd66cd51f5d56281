"""What the training-data operators share: columns by name, the shared folder, written tables, document folds."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no checkpoint folder, as in tests on one machine.
LOCAL_CHECKPOINTS = "/tmp/fotolake-checkpoints"


def col(name: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's own, or a local one where none is set and all run on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    named = named or LOCAL_CHECKPOINTS
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def _tables(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tables-{spark.sparkContext.applicationId}"


#: Paths of the tables written in this application that are still there.
MADE: list[str] = []


def written(df: DataFrame, tag: str) -> DataFrame:
    """`df` as a table in the shared folder, read again: it cuts lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{_tables(spark)}/{tag}-{uuid.uuid4().hex}"
    MADE.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes what `written` left in the shared folder for this application, once its results are saved."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_tables(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables of `written` by their paths; nothing may read them later."""
    for name in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        MADE.remove(name)


def pointed(df: DataFrame) -> DataFrame:
    """`df` checkpointed in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id falls in the fold of the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(batches: Iterable[pa.RecordBatch], rows: int = 512, chars: int = 4_000_000) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts (null: empty) of two-column batches, in bounded parts so that memory does not follow the batch size."""
    for batch in batches:
        ids, text = batch.column(0), batch.column(1)
        at = 0
        while at < batch.num_rows:
            end, size = at, 0
            while end < batch.num_rows and end - at < rows and (end == at or size < chars):
                size += len(text[end].as_buffer()) if text[end].is_valid else 0
                end += 1
            yield ids.slice(at, end - at).to_pylist(), [t or "" for t in text.slice(at, end - at).to_pylist()]
            at = end


def parts(batch: pa.RecordBatch, at: int, rows: int = 512, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most `rows` rows and, but for single rows, about `chars` bytes of the texts in column `at`."""
    text, start = batch.column(at), 0
    while start < batch.num_rows:
        end, size = start, 0
        while end < batch.num_rows and end - start < rows and (end == start or size < chars):
            size += len(text[end].as_buffer()) if text[end].is_valid else 0
            end += 1
        yield batch.slice(start, end - start)
        start = end


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, parts: int, held: int, most: int, id_col: str = "doc_id", text_col: str = "text", value: int | None = None) -> DataFrame:
    """(id, text, label) of at most `most` labelled ids, outside fold `held` of `parts`, the first in a hashed order; a row an id.

    Null ids and labels are left out; the largest label of an id counts, and of rows that share an id the least text. The ids
    are few, so they go to the documents.
    """
    known = labels.select(col(id_col).alias("id"), col(label_col).cast("int").alias("label")).where("id is not null and label is not null").where(fold(F.col("id"), parts) != held)
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    if value is not None:
        known = known.where(F.col("label") == value)
    some = known.orderBy(F.xxhash64("id"), "id").limit(most)
    rows = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(some), "id")
    return rows.groupBy("id", "label").agg(F.min("text").alias("text"))


def sigmoid(x):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


#: At most so many keys, of some 16 bytes, are broadcast.
BROADCAST_KEYS = 500_000


def without_keys(df: DataFrame, keys: DataFrame, key: Column) -> DataFrame:
    """`df` less the rows whose `key` is in `keys` (key): by broadcast of up to BROADCAST_KEYS, counted first, else by shuffle.

    Null keys are in nothing; rows with one stay.
    """
    keys = written(keys.select(F.col("key").alias("__gone")).where("__gone is not null").distinct(), "gone")
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, key == F.col("__gone"), "left_anti")
