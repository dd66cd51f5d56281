"""Colour spaces, profiles, picked colours, captions, foreign corrections."""

import struct

import numpy as np
from pyspark.sql import functions as F

from fotolake.functions import color, icc, text
from fotolake.sources import corrections, lua


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_matrices(spark):
    assert np.allclose(icc.to_xyz("srgb"), [[0.4124, 0.3576, 0.1805], [0.2126, 0.7152, 0.0722], [0.0193, 0.1192, 0.9505]], atol=2e-4)
    assert np.allclose(icc.adapted("srgb").sum(axis=1), icc.D50, atol=1e-6) and np.allclose(icc.between("srgb", "srgb"), np.eye(3))
    r = one(spark, *icc.convert("srgb", "display_p3", *map(F.lit, (1.0, 1.0, 1.0))), *icc.convert("srgb", "display_p3", *map(F.lit, (1.0, 0.0, 0.0))))
    assert np.allclose(r[:3], 1) and 0.8 < r[3] < 0.85


def test_profiles():
    for space in icc.SPACES:
        p = icc.profile(space, "Name")
        size, count = struct.unpack(">I", p[:4])[0], struct.unpack(">I", p[128:132])[0]
        assert size == len(p) and count == 9 and p[36:40] == b"acsp"
        tags = {p[132 + 12 * i : 136 + 12 * i]: struct.unpack(">II", p[136 + 12 * i : 144 + 12 * i]) for i in range(count)}
        assert tags[b"rTRC"] == tags[b"gTRC"] and all(at + n <= len(p) for at, n in tags.values())
        at, _ = tags[b"rXYZ"]
        assert np.allclose(np.frombuffer(p[at + 8 : at + 20], ">i4") / 65536, icc.adapted(space)[:, 0], atol=1e-4)


def test_points_and_captions(spark):
    at, ranges = (350.0, 0.5, 0.5), (20.0, 0.3, 0.3)
    w = lambda h, s, v: color.point_weight(F.lit(h), F.lit(s), F.lit(v), at, ranges)
    r = one(spark, w(350.0, 0.5, 0.5), w(5.0, 0.5, 0.5), w(100.0, 0.5, 0.5), w(350.0, 0.0, 0.5), color.stretched(F.lit(0.5), 0.25, 0.75))
    assert r[0] == 1 and 0 < r[1] < 1 and r[2] == 0 and r[3] == 0 and r[4] == 0.5
    df = spark.createDataFrame([("a.jpg", "", "M", 50.0, 2.8, 0.004, 400)], "file_name string, title string, model string, focal double, fnumber double, exposure double, iso int")
    assert [df.select(text.caption(k)).first()[0] for k in ("none", "file", "title", "exif")] == ["", "a.jpg", "a.jpg", "M  50 mm  f/2.8  1/250 s  ISO 400"]
    assert df.select(text.expand_tokens("{a}-{b}{c}", {"a": F.lit("{b}"), "b": F.col("iso"), "c": F.lit(None)})).first()[0] == "400-400"


def test_corrections():
    source = """s = { MaskGroupBasedCorrections = { { CorrectionActive = true, CorrectionName = "A", LocalExposure2012 = 0.25, LocalHue = 0.5, CorrectionMasks = { { What = "Mask/Gradient", ZeroX = 0.1, ZeroY = 0, FullX = 0.5, FullY = 0, MaskInverted = true }, { What = "Mask/CircularGradient", Top = 0, Left = 0, Bottom = 1, Right = 1, MaskBlendMode = 1, MaskInverted = true }, { What = "Mask/Paint", MaskBlendMode = 1, Dabs = { "d 0.1 0.2" } }, { What = "Mask/Image" } } }, { CorrectionActive = false, CorrectionMasks = { { What = "Mask/Paint" } } }, { CorrectionMasks = { } } },
      RetouchInfo = { "centerX = 0.5, centerY = 0.25, radius = 0.01, sourceX = 0.6, sourceY = 0.3, spotType = clone" } }"""
    found, warnings = corrections.masks(lua.plain(lua.parse(source)))
    assert len(found) == 1 and warnings == ["1 mask components are not supported"]
    assert found[0]["local"] == {"exposure": 1.0, "hue": 90.0} and [(p["kind"], p["how"], p["inverted"]) for p in found[0]["parts"]] == [("linear", "add", True), ("radial", "subtract", False), ("brush", "intersect", False)]
    assert corrections.spots(lua.plain(lua.parse(source))) == [{"x": 0.5, "y": 0.25, "source": (0.6, 0.3), "radius": 0.01, "heal": False}]


def test_brushes_and_ranges():
    part = corrections.component
    got = part({"What": "Mask/Paint", "Radius": 0.1, "CenterWeight": 0.2, "Flow": 2, "MaskValue": 0, "Dabs": ["d 0.5 0.25", "d 0.6 0.3 1", "r 0.1", "junk"]})
    assert got["shape"] == {"points": [(0.5, 0.25), (0.6, 0.3)], "size": 0.1, "feather": 0.8, "flow": 1.0, "erase": True}
    assert part({"What": "Mask/Paint", "Dabs": []}) is None and part({"What": "Mask/Gradient", "ZeroX": 0, "ZeroY": 0, "FullX": 1}) is None
    assert part({"What": "Mask/RangeMask", "CorrectionRangeMask": {"Type": 2, "LumRange": "0.1 0.3 0.7 0.9", "LumFeather": 0.2}})["shape"] == {"low": 0.2, "high": 0.8, "smooth": 0.2}
    assert part({"What": "Mask/RangeMask", "CorrectionRangeMask": {"Type": 1}}) is None
    edges = {"What": "Mask/CircularGradient", "Top": 0, "Left": 0, "Bottom": 1, "Right": 1}
    turned = {(a, b, c): part(edges | {"Flipped": a, "MaskInverted": b, "MaskBlendMode": c}) for a in (False, True) for b in (False, True) for c in (0, 1)}
    assert {k: (v["how"], v["inverted"]) for k, v in turned.items()} == {(a, b, c): ("add" if not c else "subtract" if b else "intersect", (b and not (c and b)) != a) for a, b, c in turned}
    assert corrections.adjustments({"LocalTexture": 0.1, "LocalLuminanceNoise": -0.2}) == {"texture": 10.0, "noise": -20.0}
