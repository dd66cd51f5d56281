"""Foreign catalogues read from SQLite into photos, keywords, collections, stacks; optional tables are probed first.

Table and column names are the foreign format's own.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from fotolake.functions.text import exif_steps, history_name, orientation_steps, xmp_title
from fotolake.operators.catalog import hierarchy, keep_newest
from fotolake.sources.files import lua_json
from fotolake.sources.lua import LABEL_WORDS, smart_rules
from fotolake.sources.sqlite import opened, read, tables

IMAGES, FILES, FOLDERS, ROOTS = "Adobe_images", "AgLibraryFile", "AgLibraryFolder", "AgLibraryRootFolder"
EPOCH_2001 = 978_307_200
STEPS_KEPT = 60


@dataclass
class Foreign:
    photos: DataFrame
    keywords: DataFrame | None = None
    captions: DataFrame | None = None
    titles: DataFrame | None = None
    develop: DataFrame | None = None
    history: DataFrame | None = None
    snapshots: DataFrame | None = None
    collections: DataFrame | None = None
    members: DataFrame | None = None
    stacks: DataFrame | None = None


JAMO = re.compile("[ᄀ-ᄒ][ᅡ-ᅵ][ᆨ-ᇂ]?")


@F.pandas_udf(StringType())
def compose_hangul(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else JAMO.sub(lambda m: unicodedata.normalize("NFC", m[0]), v))


@F.pandas_udf(StringType())
def _rules(sources: pd.Series) -> pd.Series:
    """Rules of smart collections as text, in Arrow batches."""
    return sources.map(lambda text: repr(smart_rules(text)) if isinstance(text, str) else None)


def composed(s: Column) -> Column:
    """Decomposed Hangul composed, everything else as it is."""
    return compose_hangul(s)


def label_of(s: Column) -> Column:
    low, out = F.lower(s), F.lit(0)
    for number, words in reversed(LABEL_WORDS):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, number).otherwise(out)
    return F.coalesce(out, F.lit(0))


def read_catalogue(spark: SparkSession, path: str) -> Foreign:
    """Raises ValueError for a database that is no such catalogue."""
    have = tables(path)
    if not {IMAGES, FILES} <= have:
        raise ValueError("not a catalogue of this kind")
    with opened(path) as con:
        cols = {r[1] for r in con.execute(f"PRAGMA table_info({IMAGES})")}
    at = lambda name: read(spark, path, name)
    some = lambda name: at(name) if name in have else None
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    i = at(IMAGES)
    f = at(FILES).select(F.col("id_local").alias("rootFile"), F.col("folder").alias("fo"), "baseName", "extension")
    o = at(FOLDERS).select(F.col("id_local").alias("fo"), "rootFolder", "pathFromRoot")
    r = at(ROOTS).select(F.col("id_local").alias("rootFolder"), "absolutePath")
    j = i.join(f, "rootFile").join(o, "fo").join(r, "rootFolder")
    whole = F.concat("absolutePath", blank("pathFromRoot"), "baseName", F.when(blank("extension") == "", "").otherwise(F.concat(F.lit("."), "extension")))
    pick = F.coalesce(F.col("pick"), F.lit(0.0))
    touch = F.col("touchTime") if "touchTime" in cols else F.lit(0.0)
    photos = j.select(
        F.col("id_local").alias("id"),
        F.replace(composed(whole), F.lit("/"), F.lit("\\")).alias("path"),
        F.greatest(F.lit(0), F.least(F.lit(5), F.coalesce(F.col("rating"), F.lit(0.0)).cast("int"))).alias("rating"),
        F.when(pick > 0.5, 1).when(pick < -0.5, -1).otherwise(0).alias("flag"),
        label_of(blank("colorLabels")).alias("label"),
        blank("orientation").alias("orientation"),
        F.col("masterImage").alias("master"),
        blank("copyName").alias("copy_name"),
        F.replace("captureTime", F.lit("T"), F.lit(" ")).alias("capture_time"),
        F.when(touch > 0, touch.cast("long") + EPOCH_2001).otherwise(0).alias("touched"),
    )
    out = Foreign(photos)
    if (k := some("AgLibraryKeywordImage")) is not None:
        names = at("AgLibraryKeyword").where("name <> ''").select(F.col("id_local").alias("tag"), F.col("name").alias("keyword"))
        out.keywords = k.join(names, "tag").select(F.col("image").alias("id"), "keyword").distinct()
    if (c := some("AgLibraryIPTC")) is not None:
        out.captions = c.where("caption <> ''").select(F.col("image").alias("id"), "caption")
    if (x := some("Adobe_AdditionalMetadata")) is not None:
        out.titles = x.select(F.col("image").alias("id"), xmp_title(F.col("xmp")).alias("title")).where("title is not null")
    lua = lua_json
    if (d := some("Adobe_imageDevelopSettings")) is not None:
        adj = F.col("hasDevelopAdjustmentsEx") if "hasDevelopAdjustmentsEx" in d.columns else F.col("hasDevelopAdjustments")
        real = (F.coalesce(adj.cast("double"), F.lit(1.0)) > 0) | F.contains("text", F.lit("HasCrop = true"))
        out.develop = d.where(real & F.col("text").isNotNull()).select(F.col("image").alias("id"), lua("text").alias("settings")).where("settings is not null")
    if (h := some("Adobe_libraryImageDevelopHistoryStep")) is not None:
        w = Window.partitionBy("image").orderBy("dateCreated", "id_local")
        steps = h.where("text is not null").withColumn("step", F.row_number().over(w))
        name = F.when(blank("name") == "", "Imported step").otherwise(history_name(F.col("name")))
        out.history = keep_newest(steps.select(F.col("image").alias("id"), "step", name.alias("label"), lua("text").alias("settings")), ["id"], "step", STEPS_KEPT)
    if (s := some("Adobe_libraryImageDevelopSnapshot")) is not None:
        name = F.when(blank("name") == "", "Snapshot").otherwise(F.col("name"))
        out.snapshots = s.where("text is not null").select(F.col("image").alias("id"), name.alias("name"), lua("text").alias("settings"))
    if (c := some("AgLibraryCollection")) is not None:
        nodes = c.select(F.col("id_local").alias("id"), "name", "parent", "creationId")
        paths = hierarchy(spark, nodes.select("id", "name", "parent"), joiner=" / ")
        above = F.when(F.col("depth") > 1, F.substr("path", F.lit(1), F.length("path") - F.length("name") - 3)).otherwise("")
        paths = paths.select("id", above.alias("group"))
        out.collections = nodes.join(paths, "id", "left").select("id", "name", F.coalesce("group", F.lit("")).alias("group"), "creationId")
        if (m := some("AgLibraryCollectionImage")) is not None:
            out.members = m.select(F.col("collection").alias("collection_id"), F.col("image").alias("photo_id"))
        if (t := some("AgLibraryCollectionContent")) is not None:
            rules = _rules
            out.collections = out.collections.join(t.where("owningModule is not null").select(F.col("collection").alias("id"), rules("content").alias("rules")), "id", "left")
    if (t := some("AgLibraryFolderStackImage")) is not None:
        w = Window.partitionBy("stack").orderBy("position", "image")
        out.stacks = t.select(F.col("image").alias("id"), F.first("image").over(w).alias("stack_id"), (F.row_number().over(w) - 1).alias("stack_pos"))
    return out


def turns(photos: DataFrame, exif: DataFrame) -> DataFrame:
    """(id, turns): quarter turns of the foreign orientation beyond those of the file (exif: id, orientation)."""
    j = photos.select("id", orientation_steps(F.col("orientation")).alias("a")).join(exif.select("id", exif_steps(F.col("orientation")).alias("b")), "id")
    return j.select("id", F.pmod(F.col("a") - F.col("b"), F.lit(4)).alias("turns"))


def split_known(foreign: DataFrame, photos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(known: id, new_id; to do): foreign originals whose path, in lower case, is in the catalogue, and the rest."""
    low = photos.where("master is null").groupBy(F.lower("path").alias("low")).agg(F.min("id").alias("new_id"))
    masters = foreign.where("master is null").withColumn("low", F.lower("path"))
    return masters.join(low, "low").select("id", "new_id"), masters.join(low, "low", "left_anti").drop("low")


def mapped(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """`rows` with a foreign id column replaced by new ids (ids: id, new_id); rows without one go."""
    return rows.join(ids.select(F.col("id").alias(column), "new_id"), column).withColumn(column, F.col("new_id")).drop("new_id").select(rows.columns)
