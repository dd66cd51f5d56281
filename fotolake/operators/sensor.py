"""Sensor values and camera decisions as columns; camera tables are the caller's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scaled(v: Column, x: Column, y: Column, black: list[float], white: list[float]) -> Column:
    """Value less black over range, by the place in the 2 by 2 colour filter; negative values stay."""
    at = (y % 2) * 2 + x % 2
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), at.cast("int") + 1)
    return (v - pick(black)) / (pick(white) - pick(black))


def dynamic_range_ev(percent: Column) -> Column:
    """Stops of a dynamic-range mode."""
    return F.when(percent > 0, F.log2(percent / 100.0)).otherwise(0.0)


def low_iso_ev(make: Column, model: Column, iso: Column, steps: DataFrame | None, shots: DataFrame) -> DataFrame:
    """(shot, ev): a model's own step (model, ev) or, for Canon below 100, the stops from 100."""
    own = F.when((F.lower(make) == "canon") & (iso < 100), -F.log2(100.0 / iso)).otherwise(0.0)
    if steps is None:
        return shots.select("shot", own.alias("ev"))
    known = steps.select(F.lower("model").alias("__m"), F.col("ev").alias("__ev"))
    return shots.withColumn("__m", F.lower(model)).join(known, "__m", "left").select("shot", F.coalesce("__ev", own).alias("ev"))


def aspect_crop(w: Column, h: Column, ratio: Column) -> Column:
    """The centred rectangle (x, y, w, h) of an aspect ratio; all of the image where it fits already."""
    cw, ch = F.when(w / h > ratio, F.round(h * ratio)).otherwise(w), F.when(w / h > ratio, h).otherwise(F.round(w / ratio))
    whole = lambda c: c.cast("long")
    return F.struct(whole(F.floor((w - cw) / 2)).alias("x"), whole(F.floor((h - ch) / 2)).alias("y"), whole(cw).alias("w"), whole(ch).alias("h"))


def to_sensor(x: Column, y: Column, orientation: Column) -> tuple[Column, Column]:
    """Relative display coordinates in the sensor's frame, for upright, half and quarter turns."""
    sx = F.when(orientation == 3, 1 - x).when(orientation == 6, y).when(orientation == 8, 1 - y).otherwise(x)
    sy = F.when(orientation == 3, 1 - y).when(orientation == 6, 1 - x).when(orientation == 8, x).otherwise(y)
    return sx, sy


def from_sensor(x: Column, y: Column, orientation: Column) -> tuple[Column, Column]:
    """The inverse of `to_sensor`."""
    dx = F.when(orientation == 3, 1 - x).when(orientation == 6, 1 - y).when(orientation == 8, y).otherwise(x)
    dy = F.when(orientation == 3, 1 - y).when(orientation == 6, x).when(orientation == 8, 1 - x).otherwise(y)
    return dx, dy


def distorted(x: Column, y: Column, ratio: Column, amount: Column | float = 1.0) -> tuple[Column, Column]:
    """Centred coordinates under a radial ratio, blended by an amount."""
    k = 1 + (ratio - 1) * amount
    return x * k, y * k


def log_code(v: Column, stops: float = 24.0, least: float = -12.0) -> Column:
    """A linear value as an unsigned 16-bit code, even in stops; 0 stands for nothing."""
    return F.when(v <= 0, 0).otherwise(F.greatest(F.lit(1), F.least(F.lit(65535), F.round((F.log2(v) - least) / stops * 65534) + 1))).cast("int")


def log_value(code: Column, stops: float = 24.0, least: float = -12.0) -> Column:
    return F.when(code == 0, 0.0).otherwise(F.pow(F.lit(2.0), (code - 1) / 65534.0 * stops + least))


def policy(shots: DataFrame, rules: DataFrame) -> DataFrame:
    """(shot, distortion, ca, vignetting): what applies by default, by a table of makers (make, ext, and the three)."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    keyed = rules.select(low("make").alias("m"), low("ext").alias("e"), "distortion", "ca", "vignetting")
    j = shots.select("shot", low("make").alias("m"), low("ext").alias("e")).join(keyed, ["m", "e"], "left")
    return j.select("shot", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("distortion", "ca", "vignetting")))


def redaction_ellipses(faces: DataFrame, widen: float = 1.2) -> DataFrame:
    """(photo_id, cx, cy, rx, ry) about face boxes (x, y, w, h)."""
    return faces.select("photo_id", (F.col("x") + F.col("w") / 2).alias("cx"), (F.col("y") + F.col("h") / 2).alias("cy"), (F.col("w") / 2 * widen).alias("rx"), (F.col("h") / 2 * widen).alias("ry"))


def placed(w: Column, h: Column, layer_w: Column, layer_h: Column, anchor: str, inset: float) -> tuple[Column, Column]:
    """The corner of a layer at one of nine anchors (top, middle or bottom; left, centre or right), inset from the edges."""
    row, column = anchor.split("-")
    x = {"left": F.lit(inset), "centre": (w - layer_w) / 2, "right": w - layer_w - inset}[column]
    y = {"top": F.lit(inset), "middle": (h - layer_h) / 2, "bottom": h - layer_h - inset}[row]
    return x, y


def crop_to_aspect(left: Column, top: Column, right: Column, bottom: Column, frame: Column, ratio: float) -> Column:
    """A relative crop made to an aspect about its centre, never larger; `frame` is the image's width over height."""
    w, h = right - left, bottom - top
    now = w / h * frame
    nw, nh = F.when(now > ratio, h * ratio / frame).otherwise(w), F.when(now > ratio, h).otherwise(w * frame / ratio)
    cx, cy = (left + right) / 2, (top + bottom) / 2
    return F.struct((cx - nw / 2).alias("left"), (cy - nh / 2).alias("top"), (cx + nw / 2).alias("right"), (cy + nh / 2).alias("bottom"))
