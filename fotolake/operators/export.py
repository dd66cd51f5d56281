"""Export jobs: a file and a status row for each item, whatever happens to single items, tasks or executors.

A job has two passes, and the only record between them is a table that Spark commits.

1. Each task writes its items to files of unique names in the job's attempt folder and yields a row for each: `ok` with size and digest,
   `failed` with the error, `skipped` if it has no destination or an earlier run of the job did it. An item that fails is a row, not the
   end of its task. Rows are written as a table, so of a task that ran twice one attempt's rows stand.
2. Each `ok` row's file moves to its destination. A file already moved is recognised by its size, so this pass can run again, in part or whole.

What attempts left behind that no row names goes with the attempt folder. Folders are URIs that pyarrow and all executors reach.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OK, FAILED, SKIPPED = "ok", "failed", "skipped"
STATUS = "dest string, status string, error string, bytes long, sha256 string, attempt string"


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _outside(dest: str) -> bool:
    return dest.startswith("/") or ".." in dest.split("/")


def _write(batches: Iterable[pa.RecordBatch], target: str, folder: str, render: Callable[[dict], bytes] | None, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    store, base = _store(target)
    store.create_dir(f"{base}/{folder}", recursive=True)
    types = [kind, pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):  # one item's bytes at a time
            row = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
            dest, content, name, size, digest, error = row["dest"], row.get("content"), None, None, None, None
            status = SKIPPED if dest is None or row["__done"] else FAILED
            if status == FAILED:
                try:
                    if _outside(dest):
                        raise ValueError(f"{dest} is outside the target")
                    data = render({k: v for k, v in row.items() if k != "__done"}) if render else content
                    if data is None:
                        raise ValueError("no content")
                    data = data.encode() if isinstance(data, str) else bytes(data)
                    name, size, digest = f"{folder}/{uuid.uuid4().hex}", len(data), hashlib.sha256(data).hexdigest()
                    with store.open_output_stream(f"{base}/{name}", compression=None) as f:
                        f.write(data)
                    status = OK
                except Exception as e:  # noqa: BLE001 (an item's failure is its status)
                    name, size, digest, error = None, None, None, f"{type(e).__name__}: {e}"[:500]
            rows.append((row["id"], dest, status, error, size, digest, name))
        if rows:  # status rows hold no bytes
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["id", "dest", "status", "error", "bytes", "sha256", "attempt"])


def attempted(items: DataFrame, target: str, job: str, render: Callable[[dict], bytes] | None = None, done: DataFrame | None = None) -> DataFrame:
    """The first pass: (id, dest, status, error, bytes, sha256, attempt) of each item; write it as a table before `committed`.

    items: id, dest relative to `target`, and `content` (bytes or text) or what `render` makes bytes of. Ids that are `ok` in `done` are skipped.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    if done is not None:
        known = done.where(F.col("status") == OK).select(F.col("id").alias("__id")).distinct()
        items = items.join(known.withColumn("__hit", F.lit(True)), F.col("id") == F.col("__id"), "left").withColumn("__done", F.col("__hit").isNotNull()).drop("__id", "__hit")
    else:
        items = items.withColumn("__done", F.lit(False))
    kind = items.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), *T._parse_datatype_string(STATUS).fields])
    return items.mapInArrow(functools.partial(_write, target=target, folder=f".attempts-{job}", render=render, kind=to_arrow_type(kind)), schema)


def _move(batches: Iterable[pa.RecordBatch], target: str) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    store, base = _store(target)
    made: set[str] = set()  # folders known to be there
    for batch in batches:
        states = []
        for name, dest, size in zip(*(batch.column(c).to_pylist() for c in ("attempt", "dest", "bytes")), strict=True):
            new, there = store.get_file_info([f"{base}/{name}", f"{base}/{dest}"])
            if new.type == fs.FileType.File:
                folder = f"{base}/{dest}".rpartition("/")[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                store.move(f"{base}/{name}", f"{base}/{dest}")
                states.append(True)
            else:
                states.append(there.type == fs.FileType.File and there.size == size)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(states, pa.bool_())], ["id", "moved"])


def committed(status: DataFrame, target: str) -> DataFrame:
    """The second pass over the table of the first: (id, moved). Two items of one destination are a mistake of the plan and both fail here."""
    ok = status.where(F.col("status") == OK).select("id", "attempt", "dest", "bytes")
    twice = ok.groupBy("dest").count().where("count > 1").select("dest")
    schema = T.StructType([status.schema["id"], T.StructField("moved", T.BooleanType())])
    return ok.join(twice, "dest", "left_anti").mapInArrow(functools.partial(_move, target=target), schema)


def export(items: DataFrame, target: str, table: str, render: Callable[[dict], bytes] | None = None, job: str | None = None, done: DataFrame | None = None) -> DataFrame:
    """Both passes: (id, dest, status, error, bytes, sha256) of each item; `table` is a path for the rows between them."""
    spark, job = items.sparkSession, job or uuid.uuid4().hex
    first = attempted(items, target, job, render, done)
    first.write.parquet(f"{table}/attempted")
    rows = spark.read.schema(first.schema).parquet(f"{table}/attempted")
    moved = committed(rows, target)
    moved.write.parquet(f"{table}/moved")
    moved = spark.read.schema(moved.schema).parquet(f"{table}/moved").where("moved").select(F.col("id").alias("__id")).distinct()
    store, base = _store(target)
    if store.get_file_info(f"{base}/.attempts-{job}").type.name == "Directory":
        store.delete_dir(f"{base}/.attempts-{job}")
    out = rows.join(moved, F.col("id") == F.col("__id"), "left")
    lost = (F.col("status") == OK) & F.col("__id").isNull()
    return out.select("id", "dest", F.when(lost, FAILED).otherwise(F.col("status")).alias("status"), F.when(lost, "not moved to its destination").otherwise(F.col("error")).alias("error"), F.when(~lost, F.col("bytes")).alias("bytes"), F.when(~lost, F.col("sha256")).alias("sha256"))


def counts(status: DataFrame) -> DataFrame:
    """(status, items, bytes) of a job."""
    return status.groupBy("status").agg(F.count("*").alias("items"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


#: What each ready-made export sets; other settings stay as they are.
QUICK = {
    "Instagram": {"format": "jpeg", "quality": 92, "resize": "long_edge", "size": 1080, "space": "srgb", "sharpen_for": "screen", "sharpen_level": "standard", "remove_location": True, "limit_kb": 0},
    "Web": {"format": "jpeg", "quality": 88, "resize": "long_edge", "size": 2048, "space": "srgb", "sharpen_for": "screen", "limit_kb": 0},
    "Messenger": {"format": "jpeg", "quality": 90, "resize": "long_edge", "size": 2048, "limit_kb": 1000, "remove_location": True},
    "Print": {"format": "jpeg", "quality": 100, "resize": "none", "ppi": 300, "space": "adobe", "sharpen_for": "matte"},
    "Archive": {"format": "tiff", "depth": 16, "resize": "none", "sharpen_for": "none", "metadata": "all"},
}


def quick(items: DataFrame, name: Column) -> DataFrame:
    """Items with the settings of the ready-made export that `name` gives; settings it does not set, and items of no known name, keep theirs."""
    columns = dict.fromkeys(k for q in QUICK.values() for k in q)
    new = {}
    for key in columns:
        value = F.col(key) if key in items.columns else F.lit(None)
        for title, settings in QUICK.items():
            value = F.when(name == title, F.lit(settings[key])).otherwise(value) if key in settings else value
        new[key] = value
    return items.withColumns(new)
