"""Edits of many photos at once: one change of a settings document put into a selection, with its history, in one pass.

Photos have `develop`, a JSON document or null for the defaults. Changes that leave a document as it was are dropped: such photos get no
new settings, no time of edit and no history. New history ids follow the largest one, in the order of photos, by a ranged sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fotolake.functions.session import settled
from fotolake.functions.settings import json_changes, json_copied, json_patch
from fotolake.operators.views import numbered


def _put(photos: DataFrame, history: DataFrame, new: DataFrame, label: str | Column, now: int) -> tuple[DataFrame, DataFrame]:
    """Photos and history with documents (id, old, new) put in, those that differ."""
    label = F.lit(label) if isinstance(label, str) else label
    real = settled(new.where(F.col("new").isNotNull() & (F.size(json_changes(F.col("old"), F.col("new"))) > 0)).select("id", "new"))
    hit = F.col("__new").isNotNull()
    put = photos.join(real.select("id", F.col("new").alias("__new")), "id", "left")
    columns = {"develop": F.coalesce("__new", "develop"), "edited_at": F.when(hit, F.lit(now)).otherwise(F.col("edited_at"))}
    if "thumb_ver" in photos.columns:
        columns["thumb_ver"] = F.col("thumb_ver") + hit.cast("int")
    photos = put.withColumns(columns).select(photos.columns)
    last = history.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    rows = numbered(real, [F.col("id")]).crossJoin(F.broadcast(last)).select((F.col("last") + 1 + F.col("rank")).alias("id"), F.col("id").alias("photo_id"), label.alias("label"), F.col("new").alias("settings"), F.lit(now).alias("ts"))
    return photos, history.select("id", "photo_id", "label", "settings", "ts").unionByName(rows.select(*(F.col(c).cast(history.schema[c].dataType).alias(c) for c in ("id", "photo_id", "label", "settings", "ts"))))


def auto_sync(photos: DataFrame, history: DataFrame, selection: DataFrame, before: str, after: str, default: str, label: str, now: int) -> tuple[DataFrame, DataFrame]:
    """What changed from document `before` to `after`, put into every photo of `selection` (id)."""
    chosen = photos.join(selection.select("id").distinct(), "id", "left_semi").select("id", F.coalesce("develop", F.lit(default)).alias("old"))
    return _put(photos, history, chosen.withColumn("new", json_patch(F.col("old"), F.lit(before), F.lit(after))), label, now)


def paste(photos: DataFrame, history: DataFrame, selection: DataFrame, source: str, groups: list[str], default: str, label: str, now: int) -> tuple[DataFrame, DataFrame]:
    """The groups of settings of document `source`, put into every photo of `selection` (id)."""
    chosen = photos.join(selection.select("id").distinct(), "id", "left_semi").select("id", F.coalesce("develop", F.lit(default)).alias("old"))
    return _put(photos, history, chosen.withColumn("new", json_copied(F.col("old"), F.lit(source), F.lit(",".join(groups)))), label, now)


def apply_fields(photos: DataFrame, history: DataFrame, fields: DataFrame, default: str, label: str, now: int) -> tuple[DataFrame, DataFrame]:
    """Numbers of each photo of its own, such as those of auto tone (id and a column for each field), put into its document."""
    names = [c for c in fields.columns if c != "id"]
    once = fields.groupBy("id").agg(*(F.max(c).alias(c) for c in names))
    chosen = photos.select("id", "develop").join(once, "id").select("id", F.coalesce("develop", F.lit(default)).alias("old"), F.to_json(F.struct(*names)).alias("values"))
    return _put(photos, history, chosen.withColumn("new", json_patch(F.col("old"), F.lit("{}"), F.col("values"))), label, now)


def previous_settings(view: DataFrame, keys: list[Column]) -> DataFrame:
    """(id, previous): of each photo of a view, the settings document of the one before it in the view's order."""
    placed = numbered(view, keys, "place").select("id", "develop", "place")
    before = placed.select((F.col("place") + 1).alias("place"), F.col("develop").alias("previous"))
    return placed.join(before, "place", "left").select("id", "previous")
