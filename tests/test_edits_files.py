"""Snapshots that were torn, edits that change nothing, folders with files that are none."""

import pytest
from pyspark.sql import functions as F

from fotolake.functions import settings, text
from fotolake.operators import edits, snapshots, store
from fotolake.sources import files, masks, presets, xmp


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "backups")
    df = spark.range(5)
    assert snapshots.newest(spark, root) is None
    with pytest.raises(FileNotFoundError):
        snapshots.restore(spark, root)
    for day in range(1, 8):
        snapshots.backup(spark, {"a": df.where(F.col("id") < day), "b": df}, root, f"2026-01-0{day} 120000", 1 if day in (3, 7) else None)
    assert snapshots.newest(spark, root) == "2026-01-06 120000"
    assert snapshots.restore(spark, root)["a"].count() == 5 and snapshots.restore(spark, root, "2026-01-02 120000")["a"].count() == 2
    (tmp_path / "backups" / "kept by hand").mkdir()
    # four whole ones of five stay with keep 4; the torn one before the newest goes, the later one may still be written
    assert snapshots.prune(spark, root, 4) == ["2026-01-01 120000", "2026-01-03 120000"]
    assert {r.name for r in snapshots.folders(spark, root).collect()} == {"2026-01-02 120000", "2026-01-04 120000", "2026-01-05 120000", "2026-01-06 120000", "2026-01-07 120000", "kept by hand"}
    for f in (tmp_path / "backups" / "2026-01-06 120000" / "b").glob("part-*"):
        if f.stat().st_size:
            f.unlink()
            break
    with pytest.raises(ValueError):
        snapshots.restore(spark, root)


def test_edits_that_change_nothing(spark):
    photos = spark.createDataFrame([(1, '{"a": 1, "b": {"c": 2}}', 0, 3), (2, None, 0, 3), (3, "broken", 0, 3)], "id long, develop string, edited_at long, thumb_ver long")
    history = spark.createDataFrame([(7, 1, "x", "{}", 1)], "id long, photo_id long, label string, settings string, ts long")
    both = spark.createDataFrame([(1,), (1,), (2,), (3,), (9,)], "id long")
    put, log = edits.auto_sync(photos, history, both, '{"a": 1}', '{"a": 1.0}', '{"a": 1}', "Sync", 50)
    assert sorted(put.collect()) == sorted(photos.collect()) and log.count() == 1
    put, log = edits.auto_sync(photos, history, both, '{"a": 0}', '{"a": 5}', '{"a": 1}', "Sync", 50)
    assert {r.id: (r.develop, r.edited_at, r.thumb_ver) for r in put.collect()} == {1: ('{"a": 5, "b": {"c": 2}}', 50, 4), 2: ('{"a": 5}', 50, 4), 3: ("broken", 0, 3)}
    assert sorted((r.id, r.photo_id, r.label) for r in log.collect()) == [(7, 1, "x"), (8, 1, "Sync"), (9, 2, "Sync")]


def test_edited_against_defaults(spark):
    default = {"a": 1, "as_shot": True, "temp_k": 5500, "n": {"x": "t", "y": False}, "masks": []}
    docs = ['{"a":1.0}', '{"a":2}', '{"temp_k":9}', '{"temp_k":9,"as_shot":false}', '{"n":{"y":true}}', '{"n":{"x":"t"},"new":5}', '{"masks":[{"k":1}]}', '{"masks":[]}', None, "{", "{}"]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, d string")
    got = [r.e for r in df.select("i", settings.edited(F.col("d"), F.lit(True), {True: default, False: {}}).alias("e")).orderBy("i").collect()]
    assert got == [False, True, False, True, True, False, True, False, False, False, False]


def test_changes_stay_one_row_a_photo(spark):
    photos = spark.createDataFrame([(1, "{}", 0, 0), (2, "{}", 0, 0)], "id long, develop string, thumb_ver long, edited_at long")
    twice = spark.createDataFrame([(1, '{"a":1}'), (1, '{"a":2}')], "id long, develop string")
    assert {(r.id, r.develop) for r in store.set_develop(photos, twice, 5).collect()} == {(1, '{"a":2}'), (2, "{}")}
    sets = spark.createDataFrame([(1, "n", "s")], "id long, name string, smart string")
    new = spark.createDataFrame([(1, "x", "a"), (1, "y", None)], "id long, name string, smart string")
    assert [tuple(r) for r in store.update_smart(sets, new).collect()] == [(1, "y", None)]


def test_numbers_of_exact_values(spark):
    values = [0.125, 2.675, -0.125, 1.005, 0.375, 3.0, 2.99995, -7.5, 0.0, 1e6 + 0.125]
    want = ["+0.12", "+2.67", "-0.12", "+1.00", "+0.38", "+3", "+3", "-7.50", "0", "+1000000.12"]
    got = [r.s for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", text.signed_number(F.col("v")).alias("s")).orderBy("i").collect()]
    assert got == want
    sizes = [0, 1023, 1280, 1408, 1024**2 - 1, 1024**2, 1024**3, int(1.005 * 1024**3), 5 * 1024**4]
    got = [r.s for r in spark.createDataFrame([(n,) for n in sizes], "n long").select("n", text.human_size(F.col("n")).alias("s")).orderBy("n").collect()]
    assert got == [f"{n} B" if n < 1024 else f"{n / 1024:.1f} KB" if n < 1024**2 else f"{n / 1024**2:.1f} MB" if n < 1024**3 else f"{n / 1024**3:.2f} GB" for n in sizes]


def test_preset_files_that_are_none(spark, tmp_path):
    (tmp_path / "set").mkdir()
    (tmp_path / "set" / "wide.lrtemplate").write_bytes(b"\xff\xfe" + 's = { type = "Develop", title = "$$$/x", value = { settings = { Dehaze = 5 } } }'.encode("utf-16-le"))
    (tmp_path / "set" / "marked.xmp").write_bytes(b"\xef\xbb\xbf" + b'<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description xmlns:crs="http://ns.adobe.com/camera-raw-settings/1.0/" crs:Dehaze="+7"/></rdf:RDF></x:xmpmeta>')
    (tmp_path / "set" / "bytes.xmp").write_bytes(b"\xff\x00\xfe")
    (tmp_path / "set" / "empty.lrtemplate").write_bytes(b" ")
    (tmp_path / "set" / "other.txt").write_text("x")
    got = {r.name: r for r in files.preset_files(spark, str(tmp_path)).collect()}
    assert set(got) == {"wide", "marked", "bytes", "empty"} and all(r.grp == "set" for r in got.values())
    assert (got["wide"].status, got["wide"].settings.dehaze, got["marked"].settings.dehaze) == ("ok", 5.0, 7.0)
    assert (got["bytes"].error, got["empty"].error) == ("no XML", "no Lua table")


def test_masks_as_elements_and_broken_packets(spark):
    head = '<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description xmlns:crs="http://ns.adobe.com/camera-raw-settings/1.0/">'
    old = head + '<crs:GradientBasedCorrections><rdf:Seq><rdf:li rdf:parseType="Resource"><crs:LocalExposure>0.5</crs:LocalExposure><crs:CorrectionMasks><rdf:Seq><rdf:li crs:What="Mask/Gradient" crs:ZeroX="0.1" crs:ZeroY="0.2" crs:FullX="0.3" crs:FullY="0.4"/><rdf:li crs:What="Mask/Gradient" crs:ZeroX="0.1"/></rdf:Seq></crs:CorrectionMasks></rdf:li></rdf:Seq></crs:GradientBasedCorrections></rdf:Description></rdf:RDF></x:xmpmeta>'
    off = old.replace("<crs:LocalExposure>", "<crs:CorrectionActive>false</crs:CorrectionActive><crs:LocalExposure>")
    df = spark.createDataFrame([(1, old), (2, off), (3, "<broken"), (4, None), (5, head + "</rdf:Description></rdf:RDF></x:xmpmeta>")], "photo int, xmp string")
    (r,) = masks.masks(df).collect()
    assert (r.photo, r["list"], r.local, r.left, len(r.components)) == (1, "GradientBasedCorrections", {"exposure": 2.0}, 1, 1)
    assert r.components[0].shape.values == {"ZeroX": 0.1, "ZeroY": 0.2, "FullX": 0.3, "FullY": 0.4}
    assert xmp.settings(df, photo_col="photo").where("masks is not null").count() == 1
    assert presets.NUMBERS["exposure"][0] == "basic_tone"
