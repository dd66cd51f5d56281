"""Foreign settings: a round trip of every field, rules that look at several names, curves."""

import random

from pyspark.sql import functions as F

from fotolake.functions.session import settled
from fotolake.sources import presets


def rows(spark, *maps):
    df = spark.createDataFrame([(i, m) for i, m in enumerate(maps)], "i int, m map<string,string>")
    df = settled(df.select("i", "m", presets.settings(F.col("m")).alias("s")))
    df = settled(df.select("i", "s", presets.groups(F.col("s"), F.col("m")).alias("groups"), presets.written(F.col("s")).alias("w")))
    return {r.i: r for r in df.select("i", "s", "groups", presets.settings(F.col("w")).alias("again")).collect()}


def test_every_name_both_ways(spark):
    rng = random.Random(1)
    full = {names[0][0]: str(rng.randrange(6, 90)) for _, names in presets.NUMBERS.values()}
    full |= {"WhiteBalance": "Custom", "Temperature": "5200", "Tint": "12", "CameraProfile": "Plain", "LookAmount": "0.5", "ConvertToGrayscale": "True", "AutoLateralCA": "1", "LensProfileEnable": "1", "LensProfileName": "n", "HasCrop": "True", "CropLeft": "0.1", "CropTop": "0.2", "CropRight": "0.9", "CropBottom": "0.8", "CropAngle": "-1.5"}
    r = rows(spark, full)[0]
    assert len(presets.NUMBERS) > 75 and all(r.s[f] is not None for f in presets.NUMBERS)
    assert all(abs(r.s[f] - r.again[f]) < 1e-9 for f in presets.NUMBERS) and all(r.s[f] == r.again[f] for f in r.s.asDict() if not f.startswith("curve_split"))
    assert r.s.hue_aqua == float(full["HueAdjustmentAqua"]) and abs(r.s.curve_split_1 - int(full["ParametricMidtoneSplit"]) / 100) < 1e-9
    assert set(r.groups) == {"basic_tone", "calibration", "color_grading", "crop", "detail", "effects", "hsl", "lens", "presence", "tone_curve", "treatment", "white_balance"}


def test_rules(spark):
    got = rows(spark, {"WhiteBalance": "As Shot", "Temperature": "9000"}, {"IncrementalTemperature": "-300", "IncrementalTint": "7"}, {"Exposure": "1.5", "Contrast": "30", "HighlightRecovery": "20", "FillLight": "+5"}, {"Clarity": "9", "Texture": "1"}, {"Clarity": "9"}, {"CropLeft": "0.1", "CropAngle": "2", "HasCrop": "False"}, {"LookName": "Vivid", "CameraProfile": "Plain", "LookAmount": "3"}, {"LensProfileName": "ignored"}, {}, {"Saturation": "abc"})
    assert got[0].s.temp_k is None and got[0].s.temp is None and got[0].groups == ["white_balance"]
    assert (got[1].s.temp, got[1].s.tint, got[1].s.wb_custom) == (-100.0, 7.0, False)
    assert (got[2].s.exposure, got[2].s.contrast, got[2].s.highlights, got[2].s.shadows) == (1.5, 5.0, -20.0, 5.0)
    assert got[3].s.clarity is None and got[4].s.clarity == 9.0
    assert got[5].s.crop_left is None and got[5].s.angle is None and got[5].groups == []
    assert (got[6].s.profile, got[6].s.profile_amount) == ("Vivid", 200.0) and got[7].s.lens_profile_name is None
    assert got[8].groups == got[9].groups == []
    assert all(r.s.asDict() == r.again.asDict() for r in got.values())


def test_curves(spark):
    (r,) = spark.range(1).select(presets.curve(F.lit("255,255;0,0;128,64;128,65;x,1")).alias("c")).collect()
    assert [(round(p.x * 255), round(p.y * 255)) for p in r.c] == [(0, 0), (128, 64), (255, 255)]
