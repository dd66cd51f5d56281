"""What larger tables showed: ties, and work that is done more than once."""

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fotolake.functions.session import new_path
from fotolake.functions.vector import interp
from fotolake.operators import embedded, export, lens, people, session
from fotolake.plans.all import QUERIES
from fotolake.sources import files, lens_xml, masks, tags


def test_restored_ties_go_to_smaller_ids(spark):
    saved = spark.range(200).repartition(7).select((199 - F.col("id")).alias("id"), (F.col("id") % 2).alias("seq"))
    got = {r.id for r in session.restored(saved, saved.select("id"), 30).collect()}
    assert got == {i for i in range(60) if (199 - i) % 2 == 0}


def test_vignetting_ties_go_to_the_least_k(spark):
    shots = spark.createDataFrame([(1, 1, 20.0, 2.0, 10.0)], "shot int, lens int, focal double, aperture double, distance double")
    at = lambda k: (1, 10.0, 80.0, 20.0, 2.0, 10.0, [k, 0.0, 0.0])
    schema = "lens int, low double, high double, focal double, aperture double, distance double, k array<double>"
    for ks in ([0.3, 0.1, 0.2], [0.1, 0.2, 0.3], [0.2, 0.3, 0.1]):
        points = spark.createDataFrame([at(k) for k in ks], schema).coalesce(1)
        assert lens.vignetting(shots, points).first().k == [0.1, 0.0, 0.0]


def _times(df, word):
    return df._jdf.queryExecution().optimizedPlan().toString().count(word)


def test_a_packet_is_parsed_once(spark):
    """Filters and generators above must not parse it again."""
    rows = masks.components(masks.masks(spark.createDataFrame([(1, "<x/>")], "photo int, xmp string")))
    assert _times(rows, "from_xml") + _times(rows, "XmlToStructs") <= 1


def test_suppression_by_brute_force(spark, monkeypatch):
    """Small blocks, photos over several batches, null photos: the boxes that the plain rule keeps, and no Python group a photo."""
    rng = np.random.default_rng(3)
    rows = [(None if p == 5 else p, 1000 * p + i, *map(float, rng.uniform(0, 30, 2)), 10.0, 10.0, float(i % 7)) for p in range(8) for i in range(40 if p else 700)]
    df = spark.createDataFrame(rows, "photo_id long, det_id long, x double, y double, w double, h double, score double").repartition(5)
    want = set()
    for p in {r[0] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[0] == p), key=lambda r: (-r[6], r[1])):
            if all(_overlap(r, k) < 0.3 for k in kept):
                kept.append(r)
        want |= {k[1] for k in kept}
    out = people.suppress(df, 0.3)
    assert {r.det_id for r in out.collect()} == want
    assert _times(out, "FlatMapGroups") == 0


def _overlap(a, b):
    x, y = (max(0.0, min(a[i] + 10, b[i] + 10) - max(a[i], b[i])) for i in (2, 3))
    return x * y / max(200 - x * y, 1e-6)


def test_matches_by_brute_force_in_blocks(spark):
    """Groups of more rows than a block, equal vectors among them; no row for each pair."""
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(1300, 4)), rng.normal(size=(1200, 4))
    b[:600] = a[:600] + 0.01
    b[1] = b[0]
    frame = lambda v: spark.createDataFrame([(i % 2, i, x.tolist()) for i, x in enumerate(v)], "g int, id long, v array<double>")
    got = {(r.g, r.a, r.b) for r in lens.nearest_mutual(frame(a), frame(b), ratio=0.9).collect()}
    want = set()
    for g in (0, 1):
        d = ((a[g::2, None] - b[None, g::2]) ** 2).sum(2)
        near = lambda m: (m.argmin(1), np.sort(m, 1))
        (fa, sa), (fb, sb) = near(d), near(d.T)
        want |= {(g, g + 2 * i, g + 2 * int(j)) for i, j in enumerate(fa) if fb[j] == i and sa[i][0] < 0.9 * sa[i][1] and sb[j][0] < 0.9 * sb[j][1]}
    assert got == want and len(want) > 400


def test_lens_files_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lens_xml, "PER_FILE", 10)
    lenses = spark.range(35).coalesce(1).selectExpr("concat('L', id) AS lens", "1.0D AS crop", "1.5D AS aspect", "1.0D AS low", "2.0D AS high", "array(named_struct('model', 'poly3', 'focal', 1.0D, 't', array(0.5D, 0.0D, 0.0D))) AS distortion", "CAST(array() AS array<struct<model: string, focal: double, t: array<double>>>) AS tca", "CAST(array() AS array<struct<model: string, focal: double, t: array<double>, aperture: double, distance: double>>) AS vignetting")
    lens_xml.write(lenses, spark.range(25).coalesce(1).selectExpr("concat('C', id) AS model", "1.0D AS crop"), str(tmp_path / "db"))
    assert len(list((tmp_path / "db").glob("*.xml"))) == 4 + 3
    found, cameras = lens_xml.database(spark, str(tmp_path / "db"))
    assert found.select("lens").distinct().count() == 35 and cameras.select("model").distinct().count() == 25


def test_tags_come_in_batches(spark):
    """Not a batch a file, and each maker's rule over stored tags, not over another walk."""
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["rw2"] * 3), pa.array([bytes.fromhex("4D4D002A00000008000100300003000000010005000000000000")] * 3)], ["photo", "ext", "content"])
    assert [b.num_rows for b in tags._rows([batch], pa.int64())] == [3]
    files = spark.createDataFrame([(1, "rw2", bytearray(b""))], "photo int, ext string, content binary")
    assert _times(embedded.corrections(tags.tag_rows(files)), "MapInArrow") == 0


def test_looked_up_values_are_computed_once(spark):
    """A value that is itself a look-up is named once in the plan of what is looked up by it."""
    k = F.array(F.lit(0.0), F.lit(1.0))
    slow = F.aggregate(F.sequence(F.lit(1), F.col("id")), F.lit(0.0), lambda s, x: s + x * 0.125)
    out = spark.range(5).select(interp(slow, k, k).alias("v"))
    assert _times(out, "0.125") == 1 and [r.v for r in out.collect()][1] == 0.125
    points = F.array(*(F.struct(F.lit(float(f)).alias("focal"), F.array(F.lit(f / 10)).alias("t")) for f in (1, 2, 3)))
    assert _times(spark.range(5).select(lens.at_focal(points, slow, [True]).alias("t")), "0.125") == 1


def test_many_small_files(spark, tmp_path):
    """Listed and read by as many tasks as there are, with nested, hidden and empty files; export passes rows on by the batch."""
    for i in range(700):
        folder = tmp_path / "r" / f"d{i % 7}" / ("x" if i % 3 else ".h")
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"f {i}.txt").write_bytes(b"" if i % 50 == 1 else b"%d" % i)
    root = str(tmp_path / "r")
    spark_own = {(r.path, r.length, r.modificationTime) for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime").collect()}
    found = files.listed(spark, root)
    assert set(map(tuple, found.collect())) == spark_own and found.rdd.getNumPartitions() <= 8
    read = files.contents(found).collect()
    assert [r.path for r in read] == sorted(r.path for r in read) and {(r.path, len(r.content)) for r in read} == {x[:2] for x in spark_own}
    items = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array([f"a/{i}" for i in range(50)]), pa.array([b"x"] * 50), pa.array([False] * 50)], ["id", "dest", "content", "__done"])
    assert [b.num_rows for b in export._write([items], str(tmp_path / "t"), ".a", None, pa.int64())] == [50]


def test_vignetting_of_equal_settings_and_places(spark, monkeypatch):
    """Shots of one setting and points of one place meet once, in blocks; the rows are those of all pairs, repeated shots included."""
    monkeypatch.setattr(lens, "SETTINGS", 7)
    monkeypatch.setattr(lens, "PLACES", 5)
    rng = np.random.default_rng(11)
    points = [(int(x[0] % 2), 10.0, 10.0 if x[0] % 2 else 80.0, 20.0 + x[1], 2.0 + x[2], 1.0 + x[3], [float(v) for v in rng.normal(size=3)]) for x in rng.integers(0, 4, (300, 4)).tolist()]
    shots = [(i % 390, int(x[0] % 3), 20.0 + x[1], float(x[2]), 1.0 + x[3] * 1.5) for i, x in enumerate(rng.integers(0, 5, (400, 4)).tolist())]
    want = {}
    for shot in {s[0] for s in shots}:
        near = []
        for _, of, focal, aperture, distance in (s for s in shots if s[0] == shot and s[3] > 0):
            for _, low, high, pf, pa_, pd_, k in (p for p in points if p[0] == of):
                near.append((np.sqrt(((pf - focal) / ((high - low) or 1)) ** 2 + (4 / pa_ - 4 / aperture) ** 2 + (0.1 / pd_ - 0.1 / distance) ** 2), k))
        if near and min(near)[0] <= 1:
            w = np.array([max(d, 1e-9) ** -3.5 for d, _ in near])
            want[shot] = min(near)[1] if min(near)[0] < 1e-4 else (w @ np.array([k for _, k in near]) / w.sum()).tolist()
    asked = spark.createDataFrame(shots, "shot int, lens int, focal double, aperture double, distance double")
    out = lens.vignetting(asked, spark.createDataFrame(points, "lens int, low double, high double, focal double, aperture double, distance double, k array<double>"))
    got = {r.shot: r.k for r in out.collect()}
    assert set(got) == set(want) and all(np.allclose(got[s], want[s], rtol=1e-9, atol=0) for s in want) and len(want) > 100
    pairs = lens._in_blocks(asked.select("lens", "focal").distinct(), ["lens", "focal"], spark.createDataFrame(points, "lens int, low double, high double, pf double, a double, d double, k array<double>").select("lens", "pf").distinct(), ["lens", "pf"])
    assert pairs.count() == pairs.distinct().count() == 2 * 5 * 4


def test_lens_files_are_read_once_and_deleted(spark):
    """Shots, look-ups and models read what was stored; own tables are joined before calibrations, which are dealt once."""
    out = QUERIES["lens_source_decided"](spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "] xml" not in plan and out.count() > 0
    wide = [line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Project") and "distortion#" in line and " AS " not in line]
    assert len(wide) <= 1
    folder = new_path(spark, "x").rsplit("/", 1)[0]
    assert not [name for name in os.listdir(folder) if name.startswith("lenses-")]


def test_ranges_of_lenses_by_brute_force(spark, monkeypatch):
    """Names of figures alone find the only lens within the tolerance, wherever ranges lie in their cells; one row a lens and token, not nine."""
    rng = np.random.default_rng(13)
    around = lambda: [round(float(c + rng.integers(-12, 13) / 100), 2) for c in (rng.choice([20.25, 20.5, 20.75, 21.0]), rng.choice([70.25, 70.6, 71.0]))]
    lenses = [(f"L{i} {low}-{high}mm", float(rng.choice([1.0, 1.5])), low, high) for i, (low, high) in enumerate(around() for _ in range(60))]
    shots = [(i, f"{low}-{high}mm", 1.0, low, high) for i, (low, high) in enumerate(around() for _ in range(300))]
    want = {}
    for shot, _, _, low, high in shots:
        near = [x[0] for x in lenses if abs(x[2] - low) <= lens.FOCAL and abs(x[3] - high) <= lens.FOCAL and 1 / x[1] >= lens.CIRCLE]
        if len(near) == 1:
            want[shot] = near[0]
    table = spark.createDataFrame([x[:2] for x in lenses], "lens string, crop double")
    out = lens.find(spark.createDataFrame([x[:3] for x in shots], "shot int, name string, crop double"), table)
    assert {r.shot: r.lens for r in out.collect()} == want and len(want) > 30
    assert "named_struct(i, -1" not in out._jdf.queryExecution().optimizedPlan().toString() and _times(out, "[-1,-1]") == 0
