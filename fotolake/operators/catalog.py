"""The catalogue as table transforms: frames in, frames out, latest row wins.

Ids given to a change are a frame (id or photo_id), joined, never collected. New ids follow the largest one in the order of
a key, by a ranked window over the new rows alone.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fotolake.functions.session import settled
from fotolake.operators.views import numbered

#: At most so many words of one change ride along as an array; more are joined by number.
WORDS_AT_ONCE = 10_000


def set_where(df: DataFrame, ids: DataFrame, key: str = "id", **values) -> DataFrame:
    """`df` with columns set for the rows of `ids`; values may be columns of `df`."""
    marked = df.join(ids.select(key).distinct().withColumn("__hit", F.lit(True)), key, "left")
    put = {c: F.when(F.col("__hit"), v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)).cast(df.schema[c].dataType) for c, v in values.items()}
    return marked.withColumns(put).select(df.columns)


def without(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(key), key, "left_anti").select(df.columns)


def upsert(df: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` replace those of equal keys and are added otherwise."""
    return df.join(new.select(*keys).distinct(), keys, "left_anti").select(df.columns).unionByName(new.select(df.columns))


def latest(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key, by one aggregation; `order` must be total within a key."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, *(F.col(f"r.{c}") for c in rest)).select(log.columns)


def keep_newest(log: DataFrame, keys: list[str], order: str, n: int = 500) -> DataFrame:
    """The newest `n` rows of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return log.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def coalesced(log: DataFrame, key: str, gap_ms: int = 600) -> DataFrame:
    """Edits of one label that follow each other within `gap_ms` become the last of them (columns: key, id, label, ts)."""
    w = Window.partitionBy(key).orderBy("ts", "id")
    after = (F.unix_micros(F.lead("ts").over(w).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1000
    merged = (F.lead("label").over(w) == F.col("label")) & (after < gap_ms)
    return log.withColumn("__merged", F.coalesce(merged, F.lit(False))).where(~F.col("__merged")).drop("__merged")


def add_keywords(links: DataFrame, ids: DataFrame, words: DataFrame) -> DataFrame:
    """(photo_id, keyword) with `words` (keyword) put on `ids` (photo_id); names are equal regardless of ASCII case."""
    low = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    clean = words.select(F.trim("keyword").alias("keyword")).where("keyword <> ''").groupBy(low(F.col("keyword")).alias("k")).agg(F.min("keyword").alias("new"))
    spelled = links.groupBy(low(F.col("keyword")).alias("k")).agg(F.min("keyword").alias("old"))
    clean = clean.join(spelled, "k", "left").select("k", F.coalesce("old", "new").alias("keyword"))
    have = links.select("photo_id", low(F.col("keyword")).alias("k"))
    # The words of a change ride along in arrays of a bounded size, no join of all with all: one array for most changes.
    parts = max(1, -(-clean.count() // WORDS_AT_ONCE))
    wanted = clean.groupBy(F.pmod(F.xxhash64("k"), F.lit(parts)).alias("part")).agg(F.collect_list(F.struct("k", "keyword")).alias("words"))
    each = ids.select("photo_id").distinct().withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    added = each.join(F.broadcast(wanted) if parts == 1 else wanted, "part").select("photo_id", F.inline("words"))
    return links.unionByName(added.join(have, ["photo_id", "k"], "left_anti").select("photo_id", "keyword"))


def remove_keyword(links: DataFrame, ids: DataFrame, word: str) -> DataFrame:
    gone = ids.select("photo_id").distinct().withColumn("gone", F.lit(True))
    return links.join(gone, "photo_id", "left").where(F.col("gone").isNull() | (F.lower("keyword") != word.lower())).select(links.columns)


def keyword_counts(photos: DataFrame) -> DataFrame:
    """(keyword, n) regardless of case, in the first spelling by id and place."""
    w = photos.select("id", F.posexplode("keywords").alias("at", "keyword"))
    return w.groupBy(F.lower("keyword").alias("key")).agg(F.min(F.struct("id", "at", "keyword"))["keyword"].alias("keyword"), F.count("*").alias("n")).select("keyword", "n")


def top_keywords(photos: DataFrame, n: int = 24) -> DataFrame:
    return keyword_counts(photos).orderBy(F.desc("n"), F.lower("keyword")).limit(n)


def folders(photos: DataFrame) -> DataFrame:
    return photos.groupBy("folder").agg(F.count("*").alias("n"))


def add_to_collection(members: DataFrame, new: DataFrame) -> DataFrame:
    """`members` (collection_id, photo_id, position) with `new` (collection_id, photo_id, seq) after the last place.

    Numbers are given before those already in are dropped, so gaps stay, as when rows are inserted one by one.
    """
    last = members.groupBy("collection_id").agg(F.max("position").alias("base"))
    w = Window.partitionBy("collection_id").orderBy("seq", "photo_id")
    placed = new.withColumn("i", F.row_number().over(w)).join(last, "collection_id", "left").select("collection_id", "photo_id", (F.coalesce("base", F.lit(0)) + F.col("i")).cast(members.schema["position"].dataType).alias("position"))
    first = placed.groupBy("collection_id", "photo_id").agg(F.min("position").alias("position"))
    return members.unionByName(first.join(members, ["collection_id", "photo_id"], "left_anti").select(members.columns))


def toggle_quick(quick: DataFrame, ids: DataFrame) -> DataFrame:
    """All of `ids` leave if all are in, else all are in."""
    outside = ids.select("photo_id").join(quick, "photo_id", "left_anti")
    flag = outside.limit(1).agg(F.count("*").alias("some"))
    added = ids.select("photo_id").unionByName(quick.select("photo_id")).distinct()
    kept = quick.join(ids, "photo_id", "left_anti").select("photo_id").withColumn("__kept", F.lit(True))
    return added.join(kept, "photo_id", "left").join(F.broadcast(flag)).where("some > 0 or __kept").select("photo_id")


def removal_closure(photos: DataFrame, ids: DataFrame) -> DataFrame:
    """The ids and the virtual copies of them."""
    copies = photos.where("master is not null").select("id", F.col("master").alias("m")).join(ids.select(F.col("id").alias("m")), "m", "left_semi").select("id")
    return photos.select("id").join(ids.select("id"), "id", "left_semi").unionByName(copies).distinct()


def remove_photos(photos: DataFrame, ids: DataFrame, dependents: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables after removal; `dependents` have photo_id."""
    gone = removal_closure(photos, ids)
    return {"photos": without(photos, gone)} | {n: without(df, gone.select(F.col("id").alias("photo_id")), "photo_id") for n, df in dependents.items()}


def virtual_copies(photos: DataFrame, ids: DataFrame) -> DataFrame:
    """A new row for each given id: numbered copies of its master, ids after the largest."""
    src = photos.join(ids.select("id").distinct(), "id", "left_semi").withColumn("m", F.coalesce("master", "id"))
    have = photos.where("master is not null").groupBy(F.col("master").alias("m")).agg(F.count("*").alias("have"))
    top = photos.agg(F.max("id").alias("top"))
    n = F.coalesce("have", F.lit(0)) + F.row_number().over(Window.partitionBy("m").orderBy("id"))
    out = src.join(have, "m", "left").withColumn("copy_name", F.concat(F.lit("Copy "), n.cast("string")))
    out = numbered(out, [F.col("id")], "new_id").join(F.broadcast(top))  # a row
    out = out.withColumns({"source": F.col("id"), "id": F.col("top") + 1 + F.col("new_id"), "master": F.col("m"), "stack_id": F.lit(0).cast("long"), "stack_pos": F.lit(0), "title": F.lit(""), "caption": F.lit("")})
    return out.select(*photos.columns, "source")


def label_or_clear(photos: DataFrame, ids: DataFrame, label: int) -> DataFrame:
    """(id, label) of the given rows: the label, or none if all have it."""
    target = photos.join(ids.select("id"), "id", "left_semi").select("id", "label")
    every = target.agg(F.bool_and(F.col("label") == label).alias("every"))
    return target.join(F.broadcast(every)).select("id", F.when(F.col("every"), 0).otherwise(label).alias("label"))


def display_name() -> Column:
    name = F.when(F.col("copy_name") == "", F.lit("Copy")).otherwise(F.col("copy_name"))
    return F.when(F.col("master").isNotNull(), F.concat(F.col("file_name"), F.lit(" ("), name, F.lit(")"))).otherwise(F.col("file_name"))


def known_paths(photos: DataFrame) -> DataFrame:
    return photos.where("master is null").select(F.lower("path").alias("path")).distinct()


def hierarchy(spark, nodes: DataFrame, most: int = 10_000, joiner: str = "/") -> DataFrame:
    """(id, name, path, depth) of nodes (id, name, parent), by a join for each level below the roots.

    Levels are checkpointed, so plans do not grow. It raises beyond `most` levels; nodes that no root reaches are left out.
    """
    level = settled(nodes.where("parent is null").select("id", "name", F.col("name").alias("path"), F.lit(1).alias("depth")))
    levels = [level]
    while not level.isEmpty():
        if len(levels) > most:
            raise ValueError(f"hierarchy: more than {most} levels")
        above = level.select(F.col("id").alias("parent"), F.col("path").alias("__above"), (F.col("depth") + 1).alias("depth"))
        level = settled(nodes.join(above, "parent").select("id", "name", F.concat("__above", F.lit(joiner), "name").alias("path"), "depth"))
        levels.append(level)
    return functools.reduce(DataFrame.unionByName, levels)
