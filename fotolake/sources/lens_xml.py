"""Lens calibration files: XML read by Spark's own source into cameras and lenses, calibrations nested in their lens.

A lens is a row: its name (the first without a language), crop factor, aspect, focal range and three arrays of calibration points.
Numbers that are none count as missing. Names of elements and attributes, and defaults of missing ones, are the format's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fotolake.functions.text import name_focal

#: Fixed values of the format: attributes of each kind of calibration, by model, with the value of a missing one.
DISTORTION = {"ptlens": [("a", 0.0), ("b", 0.0), ("c", 0.0)], "poly3": [("k1", 0.0), (None, 0.0), (None, 0.0)], "poly5": [("k1", 0.0), ("k2", 0.0), (None, 0.0)]}
TCA = {"poly3": [("vr", 1.0), ("vb", 1.0), ("cr", 0.0), ("cb", 0.0), ("br", 0.0), ("bb", 0.0)], "linear": [("kr", 1.0), ("kb", 1.0), *[(None, 0.0)] * 4]}
VIGNETTING = {"pa": [("k1", 0.0), ("k2", 0.0), ("k3", 0.0)]}
CROP, ASPECT, DISTANCE = 1.0, 1.5, 1000.0
#: Most lenses or cameras in a file that is written: a file is read by one task.
PER_FILE = 10_000

_text = "array<struct<_VALUE: string, _lang: string>>"
_points = lambda models, *more: "array<struct<" + ", ".join(f"_{a}: string" for a in ["model", "focal", *more, *dict.fromkeys(a for m in models.values() for a, _ in m if a)]) + ">>"
CAMERA = f"model {_text}, cropfactor array<string>"
LENS = f"model {_text}, cropfactor array<string>, `aspect-ratio` array<string>, focal array<struct<_value: string, _min: string, _max: string>>, calibration array<struct<distortion: {_points(DISTORTION)}, tca: {_points(TCA)}, vignetting: {_points(VIGNETTING, 'aperture', 'distance')}>>"


def _number(c: Column) -> Column:
    return F.trim(c).try_cast("double")


def _rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    read = spark.read.format("xml").options(rowTag=tag, attributePrefix="_", valueTag="_VALUE", ignoreSurroundingSpaces=True, pathGlobFilter="*.[xX][mM][lL]").schema(schema).load(path)
    return read.select("*", F.col("_metadata.file_name").alias("file"))


def cameras(spark: SparkSession, path: str) -> DataFrame:
    """(file, model, crop): a row for each name of a camera."""
    df = _rows(spark, path, "camera", CAMERA)
    return df.select("file", F.explode("model._VALUE").alias("model"), F.coalesce(_number(F.get("cropfactor", F.lit(0))), F.lit(CROP)).alias("crop")).where("model is not null")


def _terms(x: Column, models: dict[str, list[tuple[str | None, float]]]) -> Column:
    """The model's terms as an array, null for other models."""
    out = F.lit(None).cast("array<double>")
    for name, terms in models.items():
        out = F.when(x["_model"] == name, F.array(*(F.coalesce(_number(x[f"_{a}"]), F.lit(d)) if a else F.lit(d) for a, d in terms))).otherwise(out)
    return out


def _calibration(kind: str, models: dict, more: dict[str, Column | None]) -> Column:
    """Points (model, focal, t, and `more`: attributes with their defaults, None where a missing one drops the point)."""
    every = F.flatten(F.transform("calibration", lambda c: F.coalesce(c[kind], F.array())))
    point = lambda x: F.struct(x["_model"].alias("model"), _number(x["_focal"]).alias("focal"), _terms(x, models).alias("t"), *((_number(x[f"_{a}"]) if d is None else F.coalesce(_number(x[f"_{a}"]), d)).alias(a) for a, d in more.items()))

    def whole(x: Column) -> Column:
        ok = x["focal"].isNotNull() & x["t"].isNotNull()
        for a, d in more.items():
            ok = ok & x[a].isNotNull() if d is None else ok
        return ok

    return F.coalesce(F.filter(F.transform(every, point), whole), F.array())


def _ratio(s: Column) -> Column:
    a, b = _number(F.substring_index(s, ":", 1)), _number(F.substring_index(s, ":", -1))
    return F.when(F.contains(s, F.lit(":")), F.when(b > 0, a / b)).otherwise(_number(s))


def lenses(spark: SparkSession, path: str) -> DataFrame:
    """(file, lens, crop, aspect, low, high, distortion, tca, vignetting) of lenses with any calibration.

    The focal range is that of the last element that states one, else that in the name, else that of all calibrations.
    """
    df = _rows(spark, path, "lens", LENS)
    plain = F.filter("model", lambda m: m["_lang"].isNull())
    name = F.coalesce(F.get(plain, F.lit(0))["_VALUE"], F.get("model", F.lit(0))["_VALUE"], F.lit(""))
    stated = F.transform("focal", lambda x: F.struct(F.coalesce(_number(x["_value"]), _number(x["_min"])).alias("low"), F.coalesce(_number(x["_value"]), _number(x["_max"])).alias("high")))
    stated = F.filter(stated, lambda x: x["low"].isNotNull() & x["high"].isNotNull())
    df = df.select(
        "file",
        name.alias("lens"),
        F.coalesce(_number(F.get("cropfactor", F.lit(0))), F.lit(CROP)).alias("crop"),
        F.coalesce(_ratio(F.get("aspect-ratio", F.lit(0))), F.lit(ASPECT)).alias("aspect"),
        F.try_element_at(stated, F.lit(-1)).alias("stated"),
        _calibration("distortion", DISTORTION, {}).alias("distortion"),
        _calibration("tca", TCA, {}).alias("tca"),
        _calibration("vignetting", VIGNETTING, {"aperture": None, "distance": F.lit(DISTANCE)}).alias("vignetting"),
    ).where((F.col("lens") != "") & (F.size("distortion") + F.size("tca") + F.size("vignetting") > 0))
    focals = F.concat("distortion.focal", "tca.focal", "vignetting.focal")
    low = F.coalesce("stated.low", name_focal(F.col("lens"))["low"], F.array_min(focals))
    high = F.coalesce("stated.high", name_focal(F.col("lens"))["high"], F.array_max(focals))
    return df.select("file", "lens", "crop", "aspect", low.alias("low"), high.alias("high"), "distortion", "tca", "vignetting")


def points(lens_rows: DataFrame, kind: str) -> DataFrame:
    """The calibration table of one kind: (file, lens, crop, low, high, model, focal, t, and for vignetting aperture, distance)."""
    return lens_rows.select("file", "lens", "crop", "low", "high", F.explode(kind).alias("p")).select("file", "lens", "crop", "low", "high", "p.*")


def write(lens_rows: DataFrame, camera_rows: DataFrame, path: str) -> None:
    """Lenses and cameras as files of the format, lenses and cameras in files of their own."""

    def attributes(kind: str, models: dict, *more: str) -> Column:
        names = list(dict.fromkeys(a for m in models.values() for a, _ in m if a))

        def one(p: Column) -> Column:
            value = lambda a: F.coalesce(*(F.when(p["model"] == m, p["t"][[x for x, _ in t].index(a)]) for m, t in models.items() if a in [x for x, _ in t]))
            return F.struct(p["model"].alias("_model"), p["focal"].alias("_focal"), *(p[a].alias(f"_{a}") for a in more), *(value(a).alias(f"_{a}") for a in names))

        return F.transform(kind, one).alias(kind)

    lens = lens_rows.select(
        F.col("lens").alias("model"),
        F.col("crop").alias("cropfactor"),
        F.col("aspect").alias("aspect-ratio"),
        F.struct(F.col("low").alias("_min"), F.col("high").alias("_max")).alias("focal"),
        F.struct(attributes("distortion", DISTORTION), attributes("tca", TCA), attributes("vignetting", VIGNETTING, "aperture", "distance")).alias("calibration"),
    )
    for df, tag in ((lens, "lens"), (camera_rows.select("model", F.col("crop").alias("cropfactor")), "camera")):
        df.write.format("xml").options(rootTag="lensdatabase", rowTag=tag, attributePrefix="_", maxRecordsPerFile=PER_FILE).mode("append").save(path)


def database(spark: SparkSession, bundled: str, own: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Lenses and cameras of the caller's own files, and of the bundled files whose name (in lower case) none of them has."""
    from fotolake.operators.store import overridden

    out = []
    for read in (lenses, cameras):
        rows = read(spark, bundled)
        if own is not None:
            # a file may hold no row of this kind and yet replace another, so file names come from a listing
            names = spark.read.format("binaryFile").option("pathGlobFilter", "*.[xX][mM][lL]").load(own).select(F.lower(F.element_at(F.split("path", "/"), -1)).alias("__low")).distinct()
            left = rows.withColumn("__low", F.lower("file")).join(names, "__low", "left_anti").select(rows.columns)
            rows = overridden(read(spark, own), left, "file")
        out.append(rows)
    return out[0], out[1]
