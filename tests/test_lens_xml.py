"""Lens files: names by language, numbers that are none, focal ranges, files that replace others."""

from pyspark.sql import functions as F

from fotolake.operators import lens
from fotolake.sources import lens_xml

FILE = """<!DOCTYPE lensdatabase SYSTEM "lensfun-database.dtd">
<lensdatabase version="2"><!-- a comment <lens><model>No</model></lens> -->
<mount><name>M</name></mount>
<camera><maker>Maker</maker><model>Body 1</model><model lang="en">Body One</model><mount>M</mount><cropfactor>1.5</cropfactor></camera>
<camera><model>Body 2</model><cropfactor>x</cropfactor></camera>
<lens><maker>Maker</maker><model lang="de">Zoom &amp; mehr 20-40mm</model><model>Zoom &amp; more 20-40mm</model><cropfactor>1.5</cropfactor><aspect-ratio>4:3</aspect-ratio>
<calibration><distortion model="ptlens" focal="20" a="0.1" b="x"/><distortion model="unknown" focal="3"/><distortion model="ptlens"/><distortion model="poly3" focal="30" k1="0.5"/>
<tca model="linear" focal="20" kr="1.01"/><vignetting model="pa" focal="20" aperture="2.8" k1="-0.5"/><vignetting model="pa" focal="20" k1="-0.5"/><vignetting model="x" focal="20" aperture="2"/></calibration></lens>
<lens><model>Stated</model><focal min="5" max="9"/><focal value="7"/><calibration><tca model="poly3" focal="6" br="0.25"/></calibration></lens>
<lens><model>From points</model><aspect-ratio>1.25</aspect-ratio><calibration><distortion model="poly5" focal="6" k2="0.5"/></calibration><calibration><distortion model="poly5" focal="8"/></calibration></lens>
<lens><model>No calibration 50mm</model></lens><lens><model></model><calibration><distortion model="poly3" focal="6"/></calibration></lens>
</lensdatabase>"""


def test_file(spark, tmp_path):
    (tmp_path / "a.XML").write_text(FILE)
    (tmp_path / "b.txt").write_text(FILE)
    rows, cams = lens_xml.database(spark, str(tmp_path))
    assert sorted(map(tuple, cams.select("model", "crop").collect())) == [("Body 1", 1.5), ("Body 2", 1.0), ("Body One", 1.5)]
    got = {r.lens: r for r in rows.collect()}
    assert set(got) == {"Zoom & more 20-40mm", "Stated", "From points"}
    zoom = got["Zoom & more 20-40mm"]
    assert (zoom.crop, round(zoom.aspect, 6), zoom.low, zoom.high) == (1.5, 1.333333, 20.0, 40.0)
    assert [(p.model, p.focal, p.t) for p in zoom.distortion] == [("ptlens", 20.0, [0.1, 0.0, 0.0]), ("poly3", 30.0, [0.5, 0.0, 0.0])]
    assert [p.t for p in zoom.tca] == [[1.01, 1.0, 0.0, 0.0, 0.0, 0.0]] and [(p.aperture, p.distance, p.t) for p in zoom.vignetting] == [(2.8, 1000.0, [-0.5, 0.0, 0.0])]
    assert (got["Stated"].low, got["Stated"].high, got["Stated"].aspect, got["Stated"].tca[0].t) == (7.0, 7.0, 1.5, [1.0, 1.0, 0.0, 0.0, 0.25, 0.0])
    assert (got["From points"].low, got["From points"].high, len(got["From points"].distortion)) == (6.0, 8.0, 2)
    assert lens_xml.points(rows, "distortion").count() == 4


def test_own_files_replace_bundled_ones(spark, tmp_path):
    one = "<lensdatabase><lens><model>{} 50mm</model><calibration><distortion model='poly3' focal='50' k1='0.1'/></calibration></lens></lensdatabase>"
    for folder, name, title in (("bundled", "a.xml", "A"), ("bundled", "b.xml", "B"), ("bundled", "c.xml", "C"), ("own", "B.XML", "Own"), ("own", "d.xml", "D")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(one.format(title))
    (tmp_path / "own" / "c.xml").write_text("<lensdatabase/>")
    rows, _ = lens_xml.database(spark, str(tmp_path / "bundled"), str(tmp_path / "own"))
    assert sorted(r.lens for r in rows.collect()) == ["A 50mm", "D 50mm", "Own 50mm"]


def test_ladder_without_a_crop(spark):
    lenses = spark.createDataFrame([(1, "A 50mm f/2", 1.0), (2, "B 60mm f/2", 1.6), (3, "C 70mm f/2", 5.0), (4, "C 70mm f/2", 1.6)], "at int, lens string, crop double")
    cams = spark.createDataFrame([("Body", 2.0)], "model string, crop double")
    rows = [(i, "Maker", "x", n, None, None) for i, n in enumerate(["A 50mm f/2", "B 60mm f/2", "C 70mm f/2", "D 80mm f/2"])]
    rows += [(10, "Maker", "Body", "B 60mm f/2", 1.0, None), (11, "Maker", "x", "B 60mm f/2", 1.0, None), (12, "Maker", "x", "zzz", None, "C 70mm f/2"), (13, "Maker", "Maker Body", "zzz", None, "C 70mm f/2"), (14, "Maker", "x", "A 50mm f/2", None, "none")]
    got = lens.chosen(spark.createDataFrame(rows, "shot int, make string, model string, name string, crop double, manual string"), lenses, cams)
    assert {r.shot: (r["at"], r.used) for r in got.collect()} == {0: (1, 1.0), 1: (2, 1.6), 2: (4, 1.6), 10: (2, 2.0), 12: (3, 5.0), 13: (3, 2.0)}


def test_vignetting_of_an_array_is_that_of_a_table(spark):
    pts = spark.createDataFrame([("L", 10.0, 50.0, float(f), float(a), 10.0, [f / 100, a / 10, 0.5]) for f in (10, 20, 50) for a in (2, 4, 8)], "lens string, low double, high double, focal double, aperture double, distance double, k array<double>")
    shots = spark.createDataFrame([(i, "L", 5.0 + i * 3, 1.0 + i % 9, 10.0) for i in range(40)] + [(99, "L", 10.0, 0.0, 10.0)], "shot int, lens string, focal double, aperture double, distance double")
    want = {r.shot: [round(x, 9) for x in r.k] for r in lens.vignetting(shots, pts).collect()}
    rows = pts.groupBy("lens").agg(F.collect_list(F.struct("focal", "aperture", "distance", F.col("k").alias("t"))).alias("p"))
    got = shots.join(rows, "lens").select("shot", lens.vig_at(F.col("p"), F.lit(10.0), F.lit(50.0), F.col("focal"), F.col("aperture"), F.col("distance")).alias("k")).where("k is not null")
    assert {r.shot: [round(x, 9) for x in r.k] for r in got.collect()} == want
