"""The library view: order, stacks gathered or collapsed, and moves within it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fotolake.functions.session import settled


def sort_keys(sort: str) -> list[Column]:
    c = F.col
    return {
        "capture_time": [F.coalesce(c("capture_time"), F.lit("")), c("file_name"), c("id")],
        "import_order": [c("id")],
        "file_name": [F.lower("file_name"), c("id")],
        "rating": [c("rating"), c("id")],
        "edited": [F.coalesce(c("edited"), F.lit(False)), c("id")],
    }[sort]


def library_view(photos: DataFrame, sort: str = "capture_time", descending: bool = False, expanded: DataFrame | None = None) -> DataFrame:
    """The rows in view, with `view_key` columns that order them: sort keys of their stack's first row, then the stack's order.

    Descending turns the whole order, ties too. A stack stands where its first row stands; only its lowest position shows
    unless its id is in `expanded` (stack_id). Windows are by stack, and loose photos are no stack, so the order is left
    to one distributed sort by the keys; no window gathers all rows.
    """
    keys = sort_keys(sort)
    df = photos.withColumns({f"k{i}": k for i, k in enumerate(keys)})
    names = [f"k{i}" for i in range(len(keys))]
    loose, stacked = df.where("stack_id = 0"), df.where("stack_id <> 0")
    place = F.struct(*names)
    by = Window.partitionBy("stack_id")
    stacked = stacked.withColumn("at", (F.max(place) if descending else F.min(place)).over(by)).withColumn("rn", F.row_number().over(by.orderBy("stack_pos", "id")))
    if expanded is None:
        stacked = stacked.where("rn = 1")
    else:
        opened = expanded.select("stack_id").distinct().withColumn("open", F.lit(True))
        stacked = stacked.join(opened, "stack_id", "left").where("rn = 1 or open").drop("open")
    loose = loose.withColumn("at", place).withColumn("rn", F.lit(1))
    out = loose.unionByName(stacked).withColumns({f"view_key{i}": F.col(f"at.{n}") for i, n in enumerate(names)}).withColumnRenamed("rn", "stack_rank")
    return out.drop("at", *names)


def ordered(view: DataFrame, sort: str, descending: bool = False) -> DataFrame:
    n = len(sort_keys(sort))
    turn = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    return view.orderBy(*(turn(f"view_key{i}") for i in range(n)), "stack_rank")


def numbered(df: DataFrame, keys: list[Column], name: str = "rank") -> DataFrame:
    """`df` with its 0-based rank in a total order, without gathering it in one task.

    A range-partitioned sort, a count for each partition, and offsets joined by partition: the counts are as many as
    partitions, the rows stay where they are. `keys` must order totally.
    """
    parts = settled(df.repartitionByRange(*keys).sortWithinPartitions(*keys))
    parts = parts.withColumn("__part", F.spark_partition_id()).withColumn("__order", F.monotonically_increasing_id())
    counts = parts.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__order").alias("__first"))
    w = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", "__first", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))  # a row a partition
    return parts.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + F.col("__order") - F.col("__first")).drop("__part", "__order", "__before", "__first")
