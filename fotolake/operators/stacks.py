"""Stacks of photos. Each function returns (id, stack_id, stack_pos) of the rows that change; `apply` puts them in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fotolake.functions.session import settled
from fotolake.functions.text import capture_secs


def apply(photos: DataFrame, changes: DataFrame) -> DataFrame:
    new = changes.select("id", F.col("stack_id").alias("__s"), F.col("stack_pos").alias("__p"))
    out = photos.join(new, "id", "left").withColumns({"stack_id": F.coalesce("__s", "stack_id"), "stack_pos": F.coalesce("__p", "stack_pos").cast(photos.schema["stack_pos"].dataType)})
    return out.drop("__s", "__p").select(photos.columns)


def _written(df: DataFrame, group: str, *order) -> DataFrame:
    """Dense positions from 0; the first row's id names the stack."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.select("id", F.first("id").over(w).alias("stack_id"), (F.row_number().over(w) - 1).alias("stack_pos"))


def auto_stack(photos: DataFrame, gap: float, within: str | None = None) -> DataFrame:
    """Runs of two or more loose originals whose capture times follow each other within `gap` seconds.

    Without `within` all rows are one sequence: sorted by ranges of time, each range against the last row before it, so no task
    holds the sequence. `within` (a folder, say) bounds runs.
    """
    df = photos.where("stack_id = 0 and master is null").select("id", F.col(within).alias("g") if within else F.lit(0).alias("g"), capture_secs(F.col("capture_time")).alias("t")).where("t is not null")
    if within:
        w = Window.partitionBy("g").orderBy("t", "id")
        df = df.withColumn("cut", F.coalesce((F.col("t") - F.lag("t").over(w) > gap).cast("int"), F.lit(1)))
        df = df.withColumn("run", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    else:
        df = _runs(df.drop("g"), gap).withColumn("g", F.lit(0))
    by = Window.partitionBy("g", "run")
    df = df.withColumn("n", F.count("*").over(by)).where("n > 1")
    o = by.orderBy("t", "id")
    return df.select("id", F.first("id").over(o).alias("stack_id"), (F.row_number().over(o) - 1).alias("stack_pos"))


def _runs(df: DataFrame, gap: float) -> DataFrame:
    """`df` (id, t) with the number of its run in the order of t and id."""
    parts = settled(df.repartitionByRange("t", "id").sortWithinPartitions("t", "id")).withColumn("part", F.spark_partition_id())
    w = Window.partitionBy("part").orderBy("t", "id")
    ends = parts.groupBy("part").agg(F.max("t").alias("last"))  # a row a partition
    ends = ends.select("part", F.lag("last").over(Window.orderBy("part")).alias("before"))
    before = F.coalesce(F.lag("t").over(w), F.col("before"))
    cuts = parts.join(F.broadcast(ends), "part").withColumn("cut", F.coalesce((F.col("t") - before > gap).cast("int"), F.lit(1)))
    offsets = cuts.groupBy("part").agg(F.sum("cut").alias("n"))
    offsets = offsets.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    run = F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("offset")
    return cuts.join(F.broadcast(offsets), "part").withColumn("run", run).select("id", "t", "run")


def stack(photos: DataFrame, selection: DataFrame) -> DataFrame:
    """One stack for each `group` of `selection` (group, id, seq): its first row on top, members of old stacks brought along."""
    chosen = selection.join(photos.select("id", F.col("stack_id").alias("old")), "id")
    top = selection.groupBy("group").agg(F.min(F.struct("seq", "id")).alias("top"), F.count("*").alias("n")).where("n > 1")
    members = photos.where("stack_id <> 0").select(F.col("id").alias("member"), F.col("stack_id").alias("old"), F.col("stack_pos").alias("pos"))
    brought = chosen.where("old <> 0").join(members, "old").select("group", F.col("member").alias("id"), "seq", "pos")
    rows = brought.unionByName(chosen.where("old = 0").select("group", "id", "seq", F.lit(0).alias("pos")))
    rows = rows.groupBy("group", "id").agg(F.min(F.struct("seq", "pos")).alias("at")).join(top, "group")
    return _written(rows, "group", F.col("id") != F.col("top.id"), F.col("at"), F.col("id"))


def unstack(photos: DataFrame, ids: DataFrame) -> DataFrame:
    """The given ids leave their stacks; stacks of one dissolve, others are renumbered."""
    out = photos.where("stack_id <> 0").join(ids.select("id").distinct().withColumn("gone", F.lit(True)), "id", "left").select("id", "stack_id", "stack_pos", F.coalesce("gone", F.lit(False)).alias("gone"))
    by = Window.partitionBy("stack_id")
    out = out.withColumn("touched", F.max("gone").over(by)).where("touched").withColumn("left", F.sum((~F.col("gone")).cast("int")).over(by))
    order = Window.partitionBy("stack_id", "gone").orderBy("stack_pos", "id")
    stays = ~F.col("gone") & (F.col("left") > 1)
    return out.select("id", F.when(stays, F.first("id").over(order)).otherwise(0).alias("stack_id"), F.when(stays, F.row_number().over(order) - 1).otherwise(0).alias("stack_pos"))


def dissolve(photos: DataFrame, ids: DataFrame) -> DataFrame:
    touched = photos.where("stack_id <> 0").join(ids.select("id"), "id", "left_semi").select("stack_id").distinct()
    return photos.join(touched, "stack_id", "left_semi").select("id", F.lit(0).cast("long").alias("stack_id"), F.lit(0).alias("stack_pos"))


def to_top(photos: DataFrame, ids: DataFrame) -> DataFrame:
    """Each given id moves to the top of its stack, whose id follows it; the smallest if a stack has several."""
    tops = photos.where("stack_id <> 0").join(ids.select("id"), "id", "left_semi").groupBy("stack_id").agg(F.min("id").alias("top"))
    return _written(photos.join(tops, "stack_id").select("id", "stack_id", "stack_pos", "top"), "stack_id", F.col("id") != F.col("top"), "stack_pos", "id")


def sizes(photos: DataFrame) -> DataFrame:
    return photos.where("stack_id <> 0").groupBy("stack_id").agg(F.count("*").alias("n"))
