"""Boundary cases of scalar functions, settings documents, predicates and planning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fotolake.functions import color, settings, text, vector
from fotolake.operators import catalog, lens, people, planning, stats
from fotolake.operators.predicates import Rule, Rules


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_text(spark):
    r = one(spark, text.capture_secs(F.lit("2024-02-01 00:00:03.5")), text.capture_secs(F.lit("nonsense")), text.sanitize(F.lit(' a<b>:"c"\x01. .. ')), text.unix_to_string(F.lit(1_700_000_000)), text.history_name(F.lit("$$$/a/b=Text")), text.content_key(F.lit(b"x")))
    assert r[0] == ((((2024 * 372 + 2 * 31 + 1) * 24) * 60) * 60) + 3.5 and r[1] is None and r[2] == "a_b___c__. " and r[3] == "2023-11-14 22:13:20" and r[4] == "Text" and len(r[5]) == 24
    r = one(spark, *(text.rational(F.lit(v)) for v in (0.004, 2.8, 0.0, 0.7)))
    assert [tuple(x) for x in r] == [(1, 250), (28000, 10000), (0, 1), (7000, 10000)]
    r = one(spark, *(text.signed_number(F.lit(v)) for v in (1.0, -0.5, 0.0, 2.345)))
    assert list(r) == ["+1", "-0.50", "0", "+2.35"] or list(r) == ["+1", "-0.50", "0", "+2.34"]


def test_names(spark):
    df = spark.createDataFrame([("IMG_1.CR3", None, "", "2025-03-04 05:06:07", "T {seq}", "M", 3), (".x", 1, "Copy 2", None, "", None, 0)], "file_name string, master long, copy_name string, capture_time string, title string, model string, rating int")
    got = [r[0] for r in df.select(text.file_stem("{date}_{seq:4}_{name}", F.lit(7))).collect()]
    assert got == ["20250304_0007_IMG_1", "_0007_.x-Copy2"]
    assert [r[0] for r in df.select(text.file_stem("{title}", F.lit(7))).collect()] == ["T {seq}", ".x-Copy2"]
    assert [r[0] for r in df.select(text.file_stem("{custom}{time}{year}", F.lit(7), "{title}")).collect()] == ["{title}0506072025", "{title}"]
    parts = one(spark, *text.file_parts(F.lit("/a/b.c/IMG.cr3")), *text.file_parts(F.lit("x")))
    assert list(parts) == ["/a/b.c", "IMG.cr3", "CR3", "", "x", ""]


def test_lens_names(spark):
    r = one(spark, text.name_focal(F.lit("EF 24-105mm f/4L")), text.name_focal(F.lit("Lens 50 mm")), text.name_focal(F.lit("none")), text.lens_words(F.lit("EF24-105mm f/2.80 L II")), text.canon_spaced(F.lit("RF70-200mm")))
    assert tuple(r[0]) == (24.0, 105.0) and tuple(r[1]) == (50.0, 50.0) and r[2] is None and r[3] == ["105", "2.8", "24", "ef", "ii", "l"] and r[4] == "Canon RF 70-200mm"


def test_settings_patch(spark):
    old, new = {"exposure": 0, "temp": 5, "tint": 1, "curve": [[0, 0], [1, 1]], "masks": [{"a": 1}]}, {"exposure": 1, "temp": 5, "tint": 2, "curve": [[0, 0.1], [1, 1]], "masks": [{"a": 2}], "extra": 3}
    assert sorted(p for p, _ in settings.diff(old, new)) == [("curve", 0, 1), ("exposure",), ("extra",), ("masks",), ("tint",)]
    target = {"exposure": 9, "temp": 7, "tint": 8, "curve": [[0, 0], [1, 0.5]], "masks": [], "contrast": 4}
    assert settings.patched(target, old, new) == {"exposure": 1, "temp": 5, "tint": 2, "curve": [[0, 0.1], [1, 0.5]], "masks": [{"a": 2}], "contrast": 4}
    assert settings.copied(target, new, ["basic_tone"])["exposure"] == 1
    df = spark.createDataFrame([('{"a": 1}', '{"a": 1}', '{"a": 2}'), ("bad", "{}", "{}")], "t string, o string, n string")
    assert [r[0] for r in df.select(settings.json_patch("t", "o", "n")).collect()] == ['{"a": 2}', None]
    assert [r[0] for r in df.select(settings.json_changes("o", "n")).collect()] == [["a"], []]
    s = lambda v, k: F.struct(F.lit(v).alias("exposure"), F.lit(k).alias("temp_k"))
    r = one(spark, settings.is_default(s(0, 1), s(0, 2), F.lit(True), ["exposure", "temp_k"]), settings.is_default(s(0, 1), s(0, 2), F.lit(False), ["exposure", "temp_k"]), settings.copy_groups(s(0, 1), s(5, 6), ["exposure", "temp_k"], ["basic_tone"]))
    assert (r[0], r[1], tuple(r[2])) == (True, False, (5, 1))


def test_colour(spark):
    v = lambda *x: tuple(map(F.lit, x))
    r = one(spark, *color.hsv_to_rgb(*v(120.0, 1.0, 0.5)), *color.rotate_hue(*v(1.0, 0.0, 0.0), F.lit(120.0)), *color.lab(*v(1.0, 1.0, 1.0)), *color.band_of(F.lit(350.0), [0.0, 90.0, 180.0, 270.0]), *color.wb_from_sample(*v(0.5, 0.5, 0.5)))
    assert np.allclose(r[:3], (0, 0.5, 0)) and np.allclose(r[3:6], (0, 1, 0), atol=1e-9) and np.allclose(r[6:9], (100, 0, 0), atol=0.02)
    assert (r[9], r[10]) == (3, 0) and 0.9 < r[11] < 1 and (r[12], r[13]) == (0, 0)
    r = one(spark, vector.interp(F.lit(1.5), F.array(*v(0.0, 1.0, 2.0)), F.array(*v(0.0, 10.0, 30.0))), vector.interp(F.lit(9.0), F.array(*v(0.0, 1.0)), F.array(*v(0.0, 10.0))))
    assert tuple(r) == (20.0, 10.0)


def test_rules(spark):
    df = spark.createDataFrame([(3, 3200, ["Paris"], None)], "rating int, iso int, keywords array<string>, focal double")
    rules = (Rule("rating_at_least", 3), Rule("iso_at_least", 1600), Rule("keyword_contains", "par"))
    assert df.where(Rules(rules).column()).count() == 1 and df.where(Rules((Rule("rating_at_most", 2), *rules)).column()).count() == 0
    assert df.where(Rule("focal_at_most", 50.0).column()).count() == df.where(Rules((Rule("focal_at_least", 1.0),), False).column()).count() == 0
    assert df.where(Rule("keyword_contains", "").column()).count() == 1
    with pytest.raises(ValueError):
        Rule("none").column()


def test_planning(spark):
    r = one(spark, *planning.target_size(F.lit(6000), F.lit(4000), "long_edge", 2000), *planning.target_size(F.lit(6000), F.lit(4000), "long_edge", 9000, enlarge=False), *planning.target_size(F.lit(6000), F.lit(4000), "megapixels", 6))
    assert tuple(r) == (2000, 1333, 6000, 4000, 3000, 2000)
    items = spark.createDataFrame([(i, "/o", "a", "jpg", i) for i in range(3)] + [(9, "/o", "a-2", "jpg", 9), (10, "/o", "b", "jpg", 10)], "id long, dir string, stem string, ext string, seq long")
    files = spark.createDataFrame([("/o/a.jpg",), ("/o/a-3.jpg",)], "path string")
    got = {r.id: r.out_path for r in planning.export_paths(items, files).collect()}
    assert len(set(got.values())) == 5 and not {"/o/a.jpg", "/o/a-3.jpg"} & set(got.values()) and got[9] == "/o/a-2.jpg" and got[10] == "/o/b.jpg" and got[0] == "/o/a-4.jpg"
    assert {r.id: r.out_path for r in planning.export_paths(items, files, "skip").collect()} == {9: "/o/a-2.jpg", 10: "/o/b.jpg"}
    previews = spark.createDataFrame([("a", 100, 0), ("a", 400, 1), ("a", 800, 2), ("b", 50, 0), ("b", 90, 1)], "file string, edge int, idx int")
    assert {r.file: r.edge for r in planning.best_preview(previews, 300).collect()} == {"a": 400, "b": 90}
    assert len(planning.cells_mm(210, 297, 10, 5, 2, 3)) == 6


def test_people(spark):
    rows = [(1, [1.0, 0.0, 0.0], 5, 0.9), (2, [0.99, 0.1, 0.0], 0, 0.8), (3, [0.0, 1.0, 0.0], 0, 0.7), (4, [0.0, 0.99, 0.1], 0, 0.6), (5, [0.0, 0.0, 1.0], 0, 0.5), (6, [0.0, 1.0, 0.05], -1, 0.9)]
    faces = spark.createDataFrame(rows, "face_id long, emb array<double>, person long, score double")
    assert [(r.face_id, r.person) for r in people.assign_known(faces, 0.45).collect()] == [(2, 5)]
    rest = faces.where("person = 0 and face_id <> 2")
    groups = people.lead_groups(rest.withColumn("event", F.lit(1)), 0.45, "event")
    assert sorted((r.face_id, r.person) for r in groups.collect()) == [(3, people.NEW_BASE), (4, people.NEW_BASE)]
    persons = spark.createDataFrame([(5, "Ann"), (6, "Empty")], "id long, name string")
    after, left = people.apply_groups(faces, persons, groups)
    assert {r.face_id: r.person for r in after.collect()}[3] == 7 and sorted(r.id for r in left.collect()) == [5, 7]
    boxes = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 2, 1.0, 1.0, 10.0, 10.0, 0.8), (1, 3, 50.0, 50.0, 5.0, 5.0, 0.1)], "photo_id long, det_id long, x double, y double, w double, h double, score double")
    assert sorted(r.det_id for r in people.suppress(boxes).collect()) == [1, 3]


def test_lens_terms(spark):
    points = spark.createDataFrame([("l", f, [f / 100, 0.0, 0.0]) for f in (10.0, 20.0, 30.0, 40.0)], "lens string, focal double, t array<double>")
    shots = spark.createDataFrame([(1, "l", 20.0), (2, "l", 25.0), (3, "l", 5.0), (4, "l", 90.0)], "shot long, lens string, focal double")
    got = {r.shot: r.t[0] for r in lens.interpolated(shots, points, [True] * 3).collect()}
    y = [f * f / 100 for f in (10, 20, 30, 40)]
    s2, s3 = (y[2] - y[0]) / 2, (y[3] - y[1]) / 2
    want = (0.5 * y[1] + 0.125 * s2 + 0.5 * y[2] - 0.125 * s3) / 25
    assert np.allclose([got[i] for i in (1, 2, 3, 4)], [0.2, want, 0.1, 0.4])
    a = spark.createDataFrame([(1, i, [float(i), 0.0]) for i in range(3)], "g long, id long, v array<double>")
    b = spark.createDataFrame([(1, i, [float(i) + 0.01, 0.0]) for i in range(2)] + [(1, 7, [9.0, 9.0])], "g long, id long, v array<double>")
    assert sorted((r.a, r.b) for r in lens.nearest_mutual(a, b).collect()) == [(0, 0), (1, 1)]
    cams = spark.createDataFrame([("EOS R5", 1.0), ("nikon d500", 1.5)], "model string, crop double")
    shots = spark.createDataFrame([(1, "Canon", "Canon EOS R5"), (2, "Nikon", "D500"), (3, "X", "Y")], "shot long, make string, model string")
    assert {r.shot: r.crop for r in lens.camera_crop(shots, cams).collect()} == {1: 1.0, 2: 1.5}


def test_stats(spark):
    assert stats.pool(np.array([1.0, 3.0, 2.0, 4.0])).tolist() == sorted(stats.pool(np.array([1.0, 3.0, 2.0, 4.0])).tolist())
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([1, 3, 2, 4])], "k long, o long, v double")
    assert [r.v for r in stats.isotonic(df, "k", "o", "v").orderBy("o").collect()][0] == 1.0
    assert stats.upper_median(df.select("k", "v"), ["k"], "v", 1, 0.0).first().median == 3.0


def test_upsert_and_latest(spark):
    log = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 3, 1)], "k string, v int, seq int")
    assert sorted((r.k, r.v) for r in catalog.latest(log, ["k"], "seq").collect()) == [("a", 2), ("b", 3)]
    assert catalog.toggle_quick(spark.createDataFrame([(1,), (2,)], "photo_id long"), spark.createDataFrame([(1,), (2,)], "photo_id long")).count() == 0
