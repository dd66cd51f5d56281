"""Small state, sensor columns and registered SQL functions."""

import numpy as np
from pyspark.sql import functions as F

from fotolake.functions.register import register
from fotolake.operators import sensor, session
from fotolake.operators.views import numbered


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_registered(spark):
    assert "cosine" in register(spark)
    r = spark.sql("SELECT lens_words('EF24-105mm f/2.80 L II') AS w, name_focal('EF 24-105mm f/4L') AS f, name_focal('none') AS n, compose_hangul('\u1112\u1161\u11ab x') AS h").first()
    assert r.w == ["105", "2.8", "24", "ef", "ii", "l"] and tuple(r.f) == (24.0, 105.0) and r.n is None and r.h == "\ud55c x"
    r = spark.sql("SELECT cosine(array(1D, 2D), array(3D, 4D)) AS a, capture_secs('2024-02-01 00:00:03.5') AS b, capture_secs('no') AS c, srgb_decode(srgb_encode(0.3D)) AS d, json_patch('{\"a\": 1}', '{\"a\": 1}', '{\"a\": 5}') AS e, lua_to_json('x = { 1 }') AS f").first()
    assert r.a == 11 and r.b == ((((2024 * 372 + 2 * 31 + 1) * 24) * 60) * 60) + 3.5 and r.c is None and abs(r.d - 0.3) < 1e-12 and r.e == '{"a": 5}' and r.f == "[1]"


def test_numbering_is_total(spark):
    df = spark.range(0, 500).select(F.col("id"), (F.col("id") * 7919 % 500).alias("k")).repartition(7)
    assert sorted((r.rank, r.k) for r in numbered(df, [F.desc("k")]).collect()) == [(i, 499 - i) for i in range(500)]


def test_selection(spark):
    df = lambda *ids: spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "id long, seq long")
    assert [(r.id, r.seq) for r in session.toggled(df(1, 2, 3), df(2, 9)).orderBy("seq").collect()] == [(1, 0), (3, 2), (9, 4)]
    view = spark.createDataFrame([(10, 0), (11, 1), (12, 2)], "id long, rank int")
    now = spark.createDataFrame([("a", 11), ("b", 12)], "session string, id long")
    assert {r.session: r.id for r in session.stepped(view, now, 5).collect()} == {"a": 12, "b": 12}
    assert [r.id for r in session.restored(df(12, 99, 10), view).collect()] == [12, 10]
    kv = lambda *rows: spark.createDataFrame(rows, "key string, value string")
    assert sorted(tuple(r) for r in session.carried(kv(("prefs", "old"), ("x", "1")), kv(("prefs", "new"), ("session", "s")), ["prefs", "session"]).collect()) == [("prefs", "new"), ("x", "1")]


def test_templates(spark):
    labels = spark.createDataFrame([("Copy 3 of a",), ("Copy  of a",), ("other",), ("Name +0.65",)], "label string")
    templates = {"Copy {} of {}": "{}. Kopie von {}", "Copy {}": "K {}"}
    got = {r.label: r.text for r in session.translated(labels, templates).collect()}
    assert got["Copy 3 of a"] == "3. Kopie von a" and got["Copy  of a"] == "K  of a" and got["other"] == "other"
    assert labels.select(session.slider(F.col("label"), F.create_map(F.lit("Name"), F.lit("Nom")))).collect()[3][0] == "Nom +0.65"


def test_sensor(spark):
    for o in (1, 3, 6, 8):
        r = one(spark, *sensor.from_sensor(*sensor.to_sensor(F.lit(0.2), F.lit(0.7), F.lit(o)), F.lit(o)))
        assert np.allclose(tuple(r), (0.2, 0.7))
    r = one(spark, sensor.log_value(sensor.log_code(F.lit(0.37))), sensor.log_code(F.lit(0.0)), sensor.dynamic_range_ev(F.lit(400)), *sensor.placed(F.lit(100), F.lit(50), F.lit(10), F.lit(10), "bottom-right", 2.0), sensor.crop_to_aspect(*map(F.lit, (0.0, 0.0, 1.0, 1.0)), F.lit(1.5), 1.0), *sensor.distorted(F.lit(2.0), F.lit(4.0), F.lit(1.5), 0.5))
    assert abs(r[0] - 0.37) < 1e-3 and r[1] == 0 and r[2] == 2 and (r[3], r[4]) == (88, 38) and np.allclose(tuple(r[5]), (1 / 6, 0, 5 / 6, 1)) and (r[6], r[7]) == (2.5, 5)
    shots = spark.createDataFrame([(1, "Canon", "A", 50, "cr3"), (2, "X", "B", 50, "raw")], "shot long, make string, model string, iso int, ext string")
    steps = spark.createDataFrame([("b", -0.5)], "model string, ev double")
    assert {r.shot: r.ev for r in sensor.low_iso_ev(F.col("make"), F.col("model"), F.col("iso"), steps, shots).collect()} == {1: -1.0, 2: -0.5}
    rules = spark.createDataFrame([("canon", "CR3", True, False, True)], "make string, ext string, distortion boolean, ca boolean, vignetting boolean")
    assert sorted(tuple(r) for r in sensor.policy(shots, rules).collect()) == [(1, True, False, True), (2, False, False, False)]
