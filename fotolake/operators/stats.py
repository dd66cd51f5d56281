"""Histograms, tone and exposure, weighted means, monotone fits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fotolake.functions.color import ev_of


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def histogram(pixels: DataFrame, key: list[str]) -> DataFrame:
    """(key, channel, bin, n) of pixels with r, g, b in 0 to 255; channel l is luma, cut to whole numbers."""
    luma = F.least(F.floor(0.2126 * F.col("r") + 0.7152 * F.col("g") + 0.0722 * F.col("b")), F.lit(255))
    rows = pixels.select(*key, F.explode(F.array(*(F.struct(F.lit(n).alias("channel"), c.cast("int").alias("bin")) for n, c in (("r", F.col("r")), ("g", F.col("g")), ("b", F.col("b")), ("l", luma))))).alias("x"))
    return rows.groupBy(*key, "x.channel", "x.bin").agg(F.count("*").alias("n"))


def merge_histograms(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*[c for c in out.columns if c != "n"]).agg(F.sum("n").alias("n"))


def percentiles(hist: DataFrame, key: list[str], shares: dict[str, float]) -> DataFrame:
    """(key, one column a share): the first bin, over 255, whose cumulative count reaches the truncated share of the total.

    A target of zero is reached by bin 0.
    """
    w = Window.partitionBy(*key)
    run = hist.withColumns({"acc": F.sum("n").over(w.orderBy("bin")), "total": F.sum("n").over(w)})
    target = lambda p: F.floor(F.col("total") * F.lit(p))
    return run.groupBy(*key).agg(*(F.when(F.max(target(p)) == 0, F.lit(0.0)).otherwise(F.min(F.when(F.col("acc") >= target(p), F.col("bin"))) / 255.0).alias(name) for name, p in shares.items()))


def auto_tone(hist: DataFrame, key: list[str], present: DataFrame | None = None) -> DataFrame:
    """Exposure, highlights, shadows, whites, blacks, contrast and vibrance from luma percentiles, by fixed constants.

    `present` (key, exposure, vibrance) are the settings so far (0 where there are none): exposure is added to, vibrance is raised to 10.
    """
    p = percentiles(hist, key, {"lo": 0.005, "mid": 0.5, "hi": 0.995})
    c = F.col
    p = p.withColumns({"was": F.lit(0.0), "vivid": F.lit(0.0)}) if present is None else p.join(present.select(*key, F.col("exposure").alias("was"), F.col("vibrance").alias("vivid")), key, "left").fillna(0.0, ["was", "vivid"])
    ev = clamp(F.log2(F.pow(0.46 / F.greatest(c("mid"), F.lit(0.02)), F.lit(2.2))), -2.5, 2.5) * 0.7
    return p.select(
        *key,
        clamp(F.round(c("was") + ev, 2), -5.0, 5.0).alias("exposure"),
        F.round(F.when(c("hi") > 0.97, -clamp((c("hi") - 0.9) * 600, 0.0, 60.0)).otherwise(0.0)).alias("highlights"),
        F.round(F.when(c("lo") < 0.05, clamp((0.08 - c("lo")) * 500, 0.0, 45.0)).otherwise(0.0)).alias("shadows"),
        F.round(clamp((0.98 - c("hi")) * 150, -30.0, 40.0)).alias("whites"),
        F.round(clamp((0.02 - c("lo")) * -150, -30.0, 20.0)).alias("blacks"),
        F.round(clamp((0.85 - (c("hi") - c("lo"))) * 60, -20.0, 30.0)).alias("contrast"),
        F.greatest(c("vivid"), F.lit(10.0)).alias("vibrance"),
    )


def match_exposures(photos: DataFrame, reference: DataFrame, group: str) -> DataFrame:
    """(id, ev): exposure that makes a photo as bright as its group's reference (group, id, exposure setting `base`)."""
    light = photos.select("id", group, ev_of(F.col("exposure"), F.col("iso"), F.col("fnumber")).alias("light"))
    ref = light.join(reference.select(F.col("id"), F.col("base")), "id").select(group, F.col("id").alias("ref"), F.col("light").alias("ref_light"), "base")
    ev = clamp(F.round(F.col("base") + F.col("ref_light") - F.col("light"), 2), -5.0, 5.0)
    return light.join(ref, group).where("id <> ref and light is not null and ref_light is not null").select("id", group, ev.alias("ev"))


def upper_median(values: DataFrame, key: list[str], col: str, least: int, default: float) -> DataFrame:
    """(key, median): the element at n // 2 in order, or `default` below `least` elements; ranked, not gathered."""
    w = Window.partitionBy(*key)
    ranked = values.withColumns({"rn": F.row_number().over(w.orderBy(col)) - 1, "n": F.count("*").over(w)})
    return ranked.groupBy(*key).agg(F.when(F.max("n") >= least, F.max(F.when(F.col("rn") == F.floor(F.col("n") / 2), F.col(col)))).otherwise(F.lit(default)).alias("median"))


def exposure_ratio(cells: DataFrame, key: list[str], least: int = 50) -> DataFrame:
    """The median brightness ratio b / a of cells well inside the range."""
    good = cells.where("a > 0.02 and a < 0.7 and b > 0.02 and b < 0.7").withColumn("ratio", F.col("b") / F.col("a"))
    return upper_median(good, key, "ratio", least, 1.0)


def weighted_merge(samples: DataFrame, key: list[str], value: str, weight: str, order: str) -> DataFrame:
    """(key, value): the weighted mean, or the first value in `order` where all weights are zero."""
    total = F.sum(weight)
    return samples.groupBy(*key).agg(F.when(total > 0, F.sum(F.col(value) * F.col(weight)) / total).otherwise(F.min_by(value, order)).alias(value))


def small_luma(pixels: DataFrame, k: int) -> DataFrame:
    """(image, cx, cy, luma): means over cells of k by k pixels."""
    l = 0.2126 * F.col("r") + 0.7152 * F.col("g") + 0.0722 * F.col("b")  # noqa: E741
    return pixels.groupBy("image", F.floor(F.col("x") / k).alias("cx"), F.floor(F.col("y") / k).alias("cy")).agg(F.avg(l).alias("luma"))


def mosaic(pixels: DataFrame, k: int) -> DataFrame:
    """Each pixel gets its cell's mean colour."""
    w = Window.partitionBy("image", F.floor(F.col("x") / k), F.floor(F.col("y") / k))
    return pixels.withColumns({c: F.avg(c).over(w) for c in ("r", "g", "b")})


def pool(y: np.ndarray) -> np.ndarray:
    """Pool-adjacent-violators; runs merged are bridged linearly between the middles of neighbouring runs."""
    level, size = [], []
    for v in y:
        level.append(float(v))
        size.append(1)
        while len(level) > 1 and level[-2] > level[-1]:
            n = size[-2] + size[-1]
            level[-2:] = [(level[-2] * size[-2] + level[-1] * size[-1]) / n]
            size[-2:] = [n]
    ends = np.cumsum(size)
    return np.interp(np.arange(len(y)), ends - (np.array(size) + 1) / 2, level) if len(y) else np.asarray(y, float)


def isotonic(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, order, value) made monotone within each key."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        pdf[value] = pool(pdf[value].to_numpy(float))
        return pdf

    return df.select(key, order, F.col(value).cast("double").alias(value)).groupBy(key).applyInPandas(fit, df.select(key, order, F.col(value).cast("double").alias(value)).schema)
