"""SQLite, Lua, XMP, metadata bytes and migration, on fixtures made here."""

import json
import sqlite3
import struct
import unicodedata
import zlib

import pytest
from pyspark.sql import functions as F

from fotolake.operators.predicates import Rule
from fotolake.sources import images, lua, migration, presets, sqlite, xmp

DEVELOP = 's = { Exposure2012 = 0.5, Contrast2012 = 10, -- a comment\n Masks = { { Active = true, "x" }, [2] = [[long\nstring]] }, Name = "a \\"b\\"", n = nil }'


@pytest.fixture
def foreign(tmp_path):
    path = str(tmp_path / "foreign.db")
    con = sqlite3.connect(path)
    packed = zlib.compress(DEVELOP.encode())
    con.executescript("""
      CREATE TABLE Adobe_images (id_local INTEGER PRIMARY KEY, rootFile INTEGER, rating REAL, pick REAL, colorLabels TEXT, orientation TEXT, masterImage INTEGER, copyName TEXT, captureTime TEXT, fileFormat TEXT, touchTime REAL);
      CREATE TABLE AgLibraryFile (id_local INTEGER PRIMARY KEY, folder INTEGER, baseName TEXT, extension TEXT);
      CREATE TABLE AgLibraryFolder (id_local INTEGER PRIMARY KEY, rootFolder INTEGER, pathFromRoot TEXT);
      CREATE TABLE AgLibraryRootFolder (id_local INTEGER PRIMARY KEY, absolutePath TEXT);
      CREATE TABLE AgLibraryKeyword (id_local INTEGER PRIMARY KEY, name TEXT);
      CREATE TABLE AgLibraryKeywordImage (id_local INTEGER PRIMARY KEY, image INTEGER, tag INTEGER);
      CREATE TABLE Adobe_imageDevelopSettings (id_local INTEGER PRIMARY KEY, image INTEGER, text TEXT, hasDevelopAdjustmentsEx REAL);
      CREATE TABLE Adobe_libraryImageDevelopHistoryStep (id_local INTEGER PRIMARY KEY, image INTEGER, name TEXT, text TEXT, dateCreated REAL);
      CREATE TABLE AgLibraryCollection (id_local INTEGER PRIMARY KEY, name TEXT, parent INTEGER, creationId TEXT, systemOnly TEXT);
      CREATE TABLE AgLibraryCollectionImage (id_local INTEGER PRIMARY KEY, collection INTEGER, image INTEGER);
      CREATE TABLE AgLibraryFolderStackImage (id_local INTEGER PRIMARY KEY, stack INTEGER, image INTEGER, position REAL);
      INSERT INTO AgLibraryRootFolder VALUES (1, 'C:/photos/'); INSERT INTO AgLibraryFolder VALUES (1, 1, '2024/');
      INSERT INTO Adobe_images VALUES (10, 1, 4, 1, 'Rouge', 'BC', NULL, NULL, '2024-01-02T03:04:05', 'RAW', 5), (11, 2, NULL, -1, '', 'AB', NULL, NULL, NULL, 'JPG', 0), (12, 1, 9, 0, 'x', NULL, 10, 'Copy 1', NULL, 'RAW', 0);
      INSERT INTO AgLibraryKeyword VALUES (1, 'Paris'), (2, ''); INSERT INTO AgLibraryKeywordImage VALUES (1, 10, 1), (2, 10, 1), (3, 11, 2);
      INSERT INTO AgLibraryCollection VALUES (1, 'Set', NULL, 'group', NULL), (2, 'Inner', 1, 'group', NULL), (3, 'Leaf', 2, 'coll', NULL);
      INSERT INTO AgLibraryCollectionImage VALUES (1, 3, 10); INSERT INTO AgLibraryFolderStackImage VALUES (1, 7, 11, 1), (2, 7, 10, 2);
    """)
    con.execute("INSERT INTO AgLibraryFile VALUES (1, 1, ?, 'CR3')", (unicodedata.normalize("NFD", "사진é"),))
    con.execute("INSERT INTO AgLibraryFile VALUES (2, 1, 'b', 'jpg')")
    con.execute("INSERT INTO Adobe_imageDevelopSettings VALUES (1, 10, ?, 1), (2, 11, 's = { a = 1 }', 0)", (struct.pack(">I", len(DEVELOP)) + packed,))
    con.executemany("INSERT INTO Adobe_libraryImageDevelopHistoryStep VALUES (?, 10, ?, 's = {}', ?)", [(i, f"$$$/x/y=Step {i}", float(i)) for i in range(1, 71)])
    con.commit()
    con.close()
    return path


def test_migration(spark, foreign):
    before = open(foreign, "rb").read()
    cat = migration.read_catalogue(spark, foreign)
    rows = {r.id: r for r in cat.photos.collect()}
    assert rows[10].path == "C:\\photos\\2024\\" + unicodedata.normalize("NFC", "사진") + unicodedata.normalize("NFD", "é") + ".CR3"
    assert (rows[10].rating, rows[10].flag, rows[10].label, rows[10].capture_time, rows[10].touched) == (4, 1, 1, "2024-01-02 03:04:05", 978_307_205)
    assert (rows[11].rating, rows[11].flag, rows[11].touched) == (0, -1, 0) and (rows[12].rating, rows[12].master) == (5, 10)
    assert [tuple(r) for r in cat.keywords.collect()] == [(10, "Paris")]
    (d,) = cat.develop.collect()
    assert json.loads(d.settings)["Exposure2012"] == 0.5 and json.loads(d.settings)["Masks"]["2"] == "long\nstring"
    steps = cat.history.orderBy("step").collect()
    assert len(steps) == 60 and steps[-1].label == "Step 70"
    assert {r.id: r.group for r in cat.collections.collect()} == {1: "", 2: "Set", 3: "Set / Inner"}
    assert [(r.id, r.stack_id, r.stack_pos) for r in cat.stacks.orderBy("stack_pos").collect()] == [(11, 11, 0), (10, 11, 1)]
    have = spark.createDataFrame([(77, "c:\\PHOTOS\\2024\\b.jpg", None)], "id long, path string, master long")
    known, rest = migration.split_known(cat.photos, have)
    assert [tuple(r) for r in known.collect()] == [(11, 77)] and [r.id for r in rest.collect()] == [10]
    assert [tuple(r) for r in migration.mapped(cat.members, known, "photo_id").collect()] == []
    assert {r.id: r.turns for r in migration.turns(cat.photos, spark.createDataFrame([(10, 6), (11, 8)], "id long, orientation int")).collect()} == {10: 0, 11: 1}
    assert open(foreign, "rb").read() == before


def test_sqlite_partitions_and_refusal(spark, foreign, tmp_path):
    df = sqlite.read(spark, foreign, "Adobe_libraryImageDevelopHistoryStep", partitions=4)
    assert df.rdd.getNumPartitions() == 4 and df.count() == 70
    other = str(tmp_path / "other.db")
    con = sqlite3.connect(other)
    con.execute("CREATE TABLE foo (a)")
    con.commit()
    con.close()
    with pytest.raises(ValueError):
        migration.read_catalogue(spark, other)
    assert sqlite.text_of(b"\0\0\0\x05junk") is None and sqlite.text_of("x") == "x"


def test_lua_rules():
    source = 's = { { criteria = "rating", operation = ">", value = 5, value2 = 0 }, { criteria = "rating", operation = "==", value = 3 }, { criteria = "keywords", operation = "words", value = "par" }, { criteria = "labelColor", value = 2 }, { criteria = "labelColor", value = "Bleu" }, { criteria = "captureTime", operation = "inLast", value = 2, value_units = "weeks" }, { criteria = "aperture", operation = ">", value = 2 }, { criteria = "hasAdjustments", value = true }, combine = "union" }'
    rules, warnings = lua.smart_rules(source)
    assert not rules.match_all and warnings == ["aperture > is not supported"]
    assert rules.rules == (Rule("rating_at_least", 5), Rule("rating_at_least", 3), Rule("rating_at_most", 3), Rule("keyword_contains", "par"), Rule("label_is", 2), Rule("label_is", 4), Rule("captured_within_days", 14), Rule("has_edits", True))
    assert lua.to_json("no table") is None and lua.to_json("x = { 1, 2, { a = 0x10, 'q\\n' } }") == '[1, 2, {"a": 16, "1": "q\\n"}]'
    assert len(lua.smart_rules(source, strict=True)[1]) == 2


def test_xmp_round_trip(spark):
    df = spark.createDataFrame([("A & b", "", ["x<y", "z"], 4), ("", "c", [], 0)], "title string, caption string, keywords array<string>, rating int")
    names = F.create_map(F.lit("Exposure2012"), F.lit("1.25"), F.lit("Shadows2012"), F.lit("-20"))
    packets = df.withColumn("settings", presets.settings(names)).select("title", xmp.packet().alias("xmp"))
    out = xmp.settings(packets).withColumn("rating", xmp.rating(F.col("xmp"))).collect()
    assert [(r.settings.exposure, r.settings.shadows, r.settings.contrast, r.groups, r.rating) for r in out] == [(1.25, -20.0, None, ["basic_tone"], 4), (1.25, -20.0, None, ["basic_tone"], 0)]
    curve = '<x xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:crs="http://ns.adobe.com/camera-raw-settings/1.0/"><rdf:RDF><rdf:Description crs:Dehaze="+7"><crs:Vibrance>5</crs:Vibrance><crs:ToneCurvePV2012><rdf:Seq><rdf:li>0, 0</rdf:li><rdf:li>255, 51</rdf:li></rdf:Seq></crs:ToneCurvePV2012></rdf:Description></rdf:RDF></x>'
    (r,) = xmp.settings(spark.createDataFrame([(curve,)], "xmp string")).collect()
    assert (r.settings.dehaze, r.settings.vibrance, r.curves[0]) == (7.0, 5.0, [(0.0, 0.0), (1.0, 0.2)])
    assert xmp.settings(spark.createDataFrame([("<broken",), (None,)], "xmp string")).where("settings.exposure is null").count() == 2


def test_metadata_bytes():
    block = images.exif({0x10F: (2, "Maker"), 0x110: (2, "M")}, {0x829A: (5, (1, 250)), 0x8827: (3, 400)}, {1: (2, "N"), 2: (5, images.degrees(37.5))})
    back = images.read_exif(block)
    assert back[0][0x10F] == "Maker" and back[0x8769] == {0x829A: (1, 250), 0x8827: 400} and back[0x8825][2] == [(37, 1), (30, 1), (0, 10_000)]
    jpeg = images.inject_jpeg(b"\xff\xd8\xff\xe0\0\x04ab\xff\xd9", block, b"x" * 70_000)
    assert jpeg[8:10] == b"\xff\xe1" and b"Exif\0\0II*" in jpeg and len(jpeg) < 1000
    p = images.inject_png(images.png(2, 1, bytes(6)), block, "<x/>")
    assert p.index(b"IHDR") < p.index(b"eXIf") < p.index(b"iTXt") < p.index(b"IDAT")
    doc = images.pdf([(jpeg, 1, 1), (jpeg, 1, 1)], 595, 842)
    assert doc.count(b"/Type /Page ") == 2 and doc[int(doc.split(b"startxref\n")[1].split()[0]) :].startswith(b"xref")
    for bad in (images.inject_jpeg, images.inject_png):
        with pytest.raises(ValueError):
            bad(b"nothing")
