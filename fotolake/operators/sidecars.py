"""Sidecars of a selection: written as an export job with a status row each, and read back into photos.

A photo's sidecar stands beside it under its own name with the extension `xmp`. Virtual copies have no file and none is written.
Reading takes settings and ratings independently: a packet may hold either, both or none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fotolake.operators import export
from fotolake.sources import files, xmp


def sidecar_path(path: Column) -> Column:
    """The path with its extension replaced; names that start with their only dot, or have none, get one."""
    return F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ""), F.lit(".xmp"))


def save(photos: DataFrame, packet: Column, root: str, table: str, selection: DataFrame | None = None) -> DataFrame:
    """Status rows (see `export.export`) of the sidecars of originals (id, path below `root`, master), of `selection` (id) if given."""
    chosen = photos if selection is None else photos.join(selection.select("id").distinct(), "id", "left_semi")
    items = chosen.where("master is null").select("id", sidecar_path(F.col("path")).alias("dest"), packet.alias("content"))
    return export.export(items, root, table)


def load(photos: DataFrame, root: str, selection: DataFrame | None = None) -> DataFrame:
    """(id, settings, groups, curves, rating) of photos (id, path below `root`) whose sidecar says something.

    settings is null where the packet has none, or is no XML; rating where it states none.
    """
    chosen = photos if selection is None else photos.join(selection.select("id").distinct(), "id", "left_semi")
    found = files.texts(photos.sparkSession, root, ["xmp"])
    base = F.regexp_replace(F.lit(root), r"^[a-z]+:/+|/+$|^/+", "")
    found = found.select(F.call_function("substring_index", F.col("path"), F.concat(base, F.lit("/")), F.lit(-1)).alias("__side"), F.col("text").alias("xmp"))
    met = chosen.select("id", sidecar_path(F.col("path")).alias("__side")).join(found, "__side").drop("__side")
    read = xmp.settings(met).withColumn("rating", xmp.rating(F.col("xmp")))
    said = F.size(F.coalesce("groups", F.array())) > 0
    read = read.select("id", F.when(said, F.col("settings")).alias("settings"), F.when(said, F.col("groups")).alias("groups"), F.when(said, F.col("curves")).alias("curves"), "rating")
    return read.where("settings is not null or rating is not null")
