"""Queries of single rules that other queries leave out, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fotolake.functions import settings, text
from fotolake.functions.session import new_path
from fotolake.operators import export, people, planning, sidecars, stats, store
from fotolake.plans.queries import query
from fotolake.plans.shapes import spread, table
from fotolake.sources import masks, migration, presets, xmp


@query("""SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN concat('$$$/a/b=', p_name) WHEN 1 THEN concat(p_name, '=x') ELSE '$$$no' END AS raw,
CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN concat(p_name, '=x') ELSE '$$$no' END AS name FROM part""")
def history_names(spark, sf):
    k = F.col("p_partkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit("$$$/a/b="), "p_name")).when(k % 3 == 1, F.concat("p_name", F.lit("=x"))).otherwise("$$$no")
    return table(spark, sf, "part").select(k.alias("id"), raw.alias("raw"), text.history_name(raw).alias("name"))


WORDS = ["Red flag", "gelb", "초록", "BLEU", "Lila", "none", ""]


@query("SELECT c_custkey AS id, CAST(CASE c_custkey % 7 WHEN 5 THEN 0 WHEN 6 THEN 0 ELSE c_custkey % 7 + 1 END AS INTEGER) AS label FROM customer")
def labels_from_texts(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("id"), migration.label_of(F.get(F.array(*map(F.lit, WORDS)), (k % 7).cast("int"))).alias("label"))


@query("SELECT c_custkey AS id, concat(c_name, chr(44032 + CAST(c_custkey % 11172 AS INTEGER)), 'é') AS name FROM customer")
def hangul_composed(spark, sf):
    """Syllables taken apart by their numbers and composed again; what is no Hangul stays."""
    s = (F.col("c_custkey") % 11172).cast("int")
    jamo = lambda base, i: F.decode(F.unhex(F.lpad(F.hex((F.lit(base) + i).cast("long")), 4, "0")), "UTF-16BE")
    apart = F.concat("c_name", jamo(0x1100, F.floor(s / 588)), jamo(0x1161, F.floor(s % 588 / 28)), F.when(s % 28 > 0, jamo(0x11A7, s % 28)).otherwise(""), F.lit("é"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), migration.composed(apart).alias("name"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN '/fixed' ELSE concat('/p/', p_brand) END AS a, CASE WHEN p_partkey % 2 = 0 THEN '/fixed/sub_x' ELSE concat('/p/', p_brand, '/sub_x') END AS b FROM part")
def export_folders(spark, sf):
    """Where exports go: a fixed folder or the photo's own, and a folder below it whose name is made safe."""
    folder = F.concat(F.lit("/p/"), "p_brand")
    fixed = F.col("p_partkey") % 2 == 0
    pick = lambda **how: F.when(fixed, planning.dest_dir(fixed="/fixed", **how)).otherwise(planning.dest_dir(folder, **how))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), pick().alias("a"), pick(subfolder=" sub?x. ").alias("b"))


@query("SELECT o_orderkey AS id, 10.0 + (o_orderkey % 4) * 50 AS x, round(10 + CAST(floor((o_orderkey % 12) / 4.0) AS BIGINT) * ((297 - 20 - 10) / 3.0 + 5), 6) AS y FROM orders")
def print_cells(spark, sf):
    """The place of each item of a page in millimetres."""
    cells = planning.cells_mm(215, 297, 10, 5, 3, 4)
    # four columns of 45 mm in 215 mm with 10 mm about and 5 mm between
    cell = F.get(F.array(*(F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b, _, _ in cells)), (F.col("o_orderkey") % 12).cast("int"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.round(cell["x"], 6).alias("x"), F.round(cell["y"], 6).alias("y"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 4 < 3 THEN CAST(greatest(0, least(5, p_partkey % 9 - 1)) AS INTEGER) END AS rating FROM part")
def ratings_of_packets(spark, sf):
    k = F.col("p_partkey")
    value = (k % 9 - 1).cast("string")
    packet = F.when(k % 4 == 0, F.concat(F.lit('<r xmp:Rating="'), value, F.lit('"/>'))).when(k % 4 < 3, F.concat(F.lit("<r><xmp:Rating>"), value, F.lit("</xmp:Rating></r>"))).otherwise("<r/>")
    return table(spark, sf, "part").select(k.alias("id"), xmp.rating(packet).alias("rating"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN [] WHEN p_partkey % 3 = 1 THEN ['a', 'c/1'] ELSE ['a', 'c/1', 'd'] END AS changes,
concat('{"a": ', p_size + CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END, ', "b": 5, "c": [1, ', CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 9 END, ']}') AS patched FROM part""")
def documents_compared_and_patched(spark, sf):
    """Leaves that differ between two documents, and a third document with those that it has."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    document = lambda a, c, more: F.concat(F.lit('{"c": [1, '), F.lit(c), F.lit('], "a": '), a, F.lit(more), F.lit("}"))
    old = document(size, "2", "")
    new = F.when(k % 3 == 0, document(F.concat(size, F.lit(".0")), "2.0", "")).when(k % 3 == 1, document((F.col("p_size") + 1).cast("string"), "9", "")).otherwise(document((F.col("p_size") + 1).cast("string"), "9", ', "d": true'))
    target = F.concat(F.lit('{"b": 5, "c": [1, 2], "a": '), size, F.lit("}"))
    return table(spark, sf, "part").select(k.alias("id"), settings.json_changes(old, new).alias("changes"), settings.json_patch(target, old, new).alias("patched"))


@query("""SELECT c_custkey AS id, c_custkey % 3 <> 0 AND c_custkey % 2 = 0 AS is_default, CASE WHEN c_custkey % 2 = 0 THEN 1.0 ELSE 2.0 END AS exposure, 5.0 AS contrast, CASE WHEN c_custkey % 3 = 0 THEN 9.0 ELSE 0.0 END AS dehaze FROM customer""")
def groups_copied_and_compared(spark, sf):
    """A group of settings from another struct, and whether a struct is the default while Kelvin is free as shot."""
    k = F.col("c_custkey")
    made = lambda a, b, c, t: F.struct(a.alias("exposure"), b.alias("contrast"), c.alias("dehaze"), t.alias("temp_k"))
    one = F.lit(1.0)
    target = made(one, one, F.when(k % 3 == 0, 9.0).otherwise(0.0), F.lit(4000.0))
    source = made(F.when(k % 2 == 0, 1.0).otherwise(2.0), F.lit(5.0), F.lit(7.0), F.lit(5000.0))
    fields = ["exposure", "contrast", "dehaze", "temp_k"]
    df = table(spark, sf, "customer").select(k.alias("id"), settings.copy_groups(target, source, fields, ["basic_tone"]).alias("s"))
    same = settings.is_default(F.col("s"), made(one, F.lit(5.0), F.lit(0.0), F.lit(1.0)), F.lit(True), fields)
    return df.select("id", same.alias("is_default"), "s.exposure", "s.contrast", "s.dehaze")


FACES = "SELECT vec_id AS face_id, CAST(floor(vec_id / 4.0) AS BIGINT) AS photo_id, CAST(vec_id % 5 AS BIGINT) AS person FROM embeddings"


@query(f"""WITH f AS ({FACES}), n AS (SELECT face_id, CASE WHEN face_id % 10 = 0 THEN CASE WHEN face_id % 20 = 0 THEN 101 ELSE 102 END WHEN face_id % 10 = 1 THEN 2 ELSE person END AS person FROM f)
SELECT 'face' AS kind, face_id AS id, person FROM n UNION ALL SELECT 'person', p.id, NULL FROM (SELECT unnest([1, 2, 3, 4, 100, 101, 102]) AS id) p WHERE p.id IN (SELECT person FROM n)""")
def face_groups_applied(spark, sf):
    """Faces put into people, new ones among them, and the people that still have a face."""
    faces = spark.sql(FACES.replace("FROM embeddings", "FROM {embeddings}"), embeddings=table(spark, sf, "embeddings"))
    persons = faces.select(F.explode(F.array(*map(F.lit, (1, 2, 3, 4, 100)))).alias("id")).select(F.col("id").cast("long")).distinct().withColumn("name", F.lit(""))
    base = people.NEW_BASE
    change = F.when(F.col("face_id") % 20 == 0, base + 3).when(F.col("face_id") % 10 == 0, base + 7).when(F.col("face_id") % 10 == 1, 2)
    changes = faces.select("face_id", change.cast("long").alias("person")).where("person is not null")
    out, left = people.apply_groups(faces, persons, changes)
    return out.select(F.lit("face").alias("kind"), F.col("face_id").alias("id"), F.col("person").cast("long").alias("person")).unionByName(left.select(F.lit("person").alias("kind"), "id", F.lit(None).cast("long").alias("person")))


@query("""WITH d AS (SELECT CAST(floor(l_orderkey / 16.0) AS BIGINT) AS photo_id, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS det_id, (l_orderkey % 16) * 1000 + floor((l_linenumber - 1) / 2.0) * 100 AS x, l_orderkey % 3 AS apart, CAST((l_linenumber * 7 + l_orderkey) % 11 AS DOUBLE) AS score
  FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)), p AS (SELECT *, row_number() OVER (PARTITION BY photo_id, x ORDER BY score DESC, det_id) AS place FROM d)
SELECT photo_id, det_id FROM p WHERE place = 1 OR apart > 0""")
def boxes_suppressed(spark, sf):
    """Of boxes that overlap the best stays: pairs of boxes of 10 by 10 that lie 1, 5 or 9 apart, with overlaps of 0.82, 0.33 and 0.05; the most allowed is 0.4."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    boxes = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    boxes = boxes.select(F.floor(k / 16).alias("photo_id"), (k * 10 + n).cast("long").alias("det_id"), ((k % 16) * 1000 + F.floor((n - 1) / 2) * 100).cast("double").alias("x"), (n % 2 * (1 + k % 3 * 4)).cast("double").alias("y"), F.lit(10.0).alias("w"), F.lit(10.0).alias("h"), ((n * 7 + k) % 11).cast("double").alias("score"))
    return people.suppress(boxes, 0.4).select("photo_id", "det_id")


@query("""WITH s AS (SELECT c_custkey % 9 AS k, CAST(c_custkey AS BIGINT) AS i, CAST(c_custkey - (c_custkey % 18) * 2 AS DOUBLE) AS v FROM customer), r AS (SELECT *, lag(v) OVER (PARTITION BY k ORDER BY i) AS b FROM s)
SELECT CAST(k AS BIGINT) AS k, bool_and(b IS NULL OR b <= v) AS was_sorted, count(*) AS n, round(sum(v), 6) AS total, true AS sorted FROM r GROUP BY k""")
def values_made_monotone(spark, sf):
    """Least-squares monotone values: in order, with the total of each group kept where pools are whole."""
    from pyspark.sql import Window

    k = F.col("c_custkey")
    df = table(spark, sf, "customer").select((k % 9).cast("long").alias("k"), k.cast("long").alias("i"), (k - (k % 18) * 2).cast("double").alias("v"))
    before = lambda d, c: d.withColumn("b", F.lag(c).over(Window.partitionBy("k").orderBy("i"))).groupBy("k").agg(F.min(F.coalesce(F.col("b") <= F.col(c) + 1e-9, F.lit(True))).alias("s"))
    fitted = stats.isotonic(df, "k", "i", "v")
    out = df.groupBy("k").agg(F.count("*").alias("n"), F.round(F.sum("v"), 6).alias("total")).join(before(df, "v").withColumnRenamed("s", "was_sorted"), "k")
    return out.join(before(fitted, "v").withColumnRenamed("s", "sorted"), "k").select("k", "was_sorted", "n", "total", "sorted")


@query(f"WITH f AS ({FACES}) SELECT (SELECT count(*) FROM f) AS faces_before, 0 AS faces, 0 AS persons, 0 AS scanned")
def people_cleared(spark, sf):
    faces = spark.sql(FACES.replace("FROM embeddings", "FROM {embeddings}"), embeddings=table(spark, sf, "embeddings"))
    empty = store.clear_people(faces, faces.select(F.col("person").alias("id")).distinct(), faces.select("photo_id").distinct())
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(faces, "faces_before").join(n(empty[0], "faces")).join(n(empty[1], "persons")).join(n(empty[2], "scanned"))  # rows of one


@query("SELECT p_partkey AS photo, CASE p_partkey % 4 WHEN 0 THEN 'subject' WHEN 1 THEN 'sky' WHEN 2 THEN 'background' ELSE 'people' END AS subject, CAST(p_partkey % 2 AS INTEGER) AS left_out FROM part")
def mask_subjects_read(spark, sf):
    """Masks that a model makes: what they ask for is kept; kinds that are not known are counted."""
    k = F.col("p_partkey")
    kind = F.when(k % 4 == 0, 'crs:MaskSubType="1"').when(k % 4 == 1, 'crs:MaskSubType="2"').when(k % 4 == 2, 'crs:MaskSubType="0" crs:MaskSubCategoryID="22"').otherwise('crs:MaskSubType="0" crs:MaskSubCategoryID="3"')
    other = F.when(k % 2 == 1, '<rdf:li><rdf:Description crs:What="Mask/Unknown"/></rdf:li>').otherwise("")
    packet = F.concat(F.lit('<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description xmlns:crs="http://ns.adobe.com/camera-raw-settings/1.0/"><crs:MaskGroupBasedCorrections><rdf:Seq><rdf:li><rdf:Description crs:CorrectionName="m"><crs:CorrectionMasks><rdf:Seq><rdf:li crs:What="Mask/Image" '), kind, F.lit("/>"), other, F.lit("</rdf:Seq></crs:CorrectionMasks></rdf:Description></rdf:li></rdf:Seq></crs:MaskGroupBasedCorrections></rdf:Description></rdf:RDF></x:xmpmeta>"))
    found = masks.masks(spread(table(spark, sf, "part"), "p_partkey").select(k.alias("photo"), packet.alias("xmp")))
    return found.select("photo", F.get("components", F.lit(0))["shape"]["subject"].alias("subject"), F.col("left").alias("left_out"))


SIDES = "SELECT c_custkey AS id, concat('d', CAST(c_custkey % 7 AS STRING), '/', c_name, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN '.cr3' ELSE '.a.jpg' END) AS path, CASE WHEN c_custkey % 5 = 0 THEN c_custkey - 1 END AS master, CAST(c_custkey % 6 AS INT) AS rating, c_custkey % 90 AS e FROM customer"


def _sides(spark, sf):
    return spark.sql(SIDES.replace("FROM customer", "FROM {customer}"), customer=spread(table(spark, sf, "customer"), "c_custkey"))


@query(f"""WITH s AS ({SIDES}) SELECT id, CAST(CASE WHEN id % 4 > 0 THEN e END AS DOUBLE) AS exposure, rating FROM s WHERE master IS NULL""")
def sidecars_saved_and_loaded(spark, sf):
    """Sidecars of originals written as files and read back: settings where they say any, ratings always."""
    root = new_path(spark, "sidecars")
    photos = _sides(spark, sf)
    m = F.create_map(F.lit("Exposure2012"), F.when(F.col("id") % 4 > 0, F.col("e").cast("string")))
    made = photos.withColumns({"m": m, "title": F.lit(""), "caption": F.lit(""), "keywords": F.array(F.lit("k"))}).withColumn("settings", presets.settings(F.col("m")))
    sidecars.save(made, xmp.packet(), root, new_path(spark, "status"))
    return sidecars.load(photos, root).select("id", "settings.exposure", "rating")


@query(f"""WITH s AS ({SIDES}) SELECT 'a' AS folder, count(*) AS files, CAST(sum(length(path)) AS BIGINT) AS bytes FROM s UNION ALL SELECT 'b', count(*), CAST(sum(length(path)) AS BIGINT) FROM s WHERE id % 7 = 3""")
def folders_measured(spark, sf):
    """Files and bytes of a folder, and of one inside it."""
    root = new_path(spark, "sizes")
    export.export(_sides(spark, sf).select("id", F.col("path").alias("dest"), F.col("path").alias("content")), root, new_path(spark, "status"))
    return store.folder_sizes(spark, {"a": root, "b": f"{root}/d3"})


PRESETS = "SELECT CAST(p_partkey AS BIGINT) AS id, p_brand AS grp, p_name AS name, '{}' AS data FROM part"


@query(f"""WITH t AS ({PRESETS}), g AS (SELECT min(grp) AS grp FROM t), k AS (SELECT * FROM t WHERE id % 10 <> 0 AND grp <> (SELECT grp FROM g)),
n AS (SELECT c_mktsegment AS grp, c_name AS name, concat('{{"settings":{{"a":', c_custkey, '}},"groups":{{}}}}') AS data FROM customer)
SELECT * FROM k UNION ALL SELECT (SELECT max(id) FROM k) + row_number() OVER (ORDER BY grp, name, data), grp, name, data FROM n""")
def presets_saved_and_deleted(spark, sf):
    """Presets deleted by id and by group, and new ones saved after them."""
    t = spark.sql(PRESETS.replace("{", "{{").replace("}", "}}").replace("FROM part", "FROM {part}"), part=table(spark, sf, "part"))
    first = t.agg(F.min("grp").alias("grp"))
    t = store.delete_preset_group(store.delete_presets(t, t.where("id % 10 = 0")), first)
    new = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("grp"), F.col("c_name").alias("name"), F.concat(F.lit('{"a":'), F.col("c_custkey").cast("string"), F.lit("}")).alias("settings"), F.lit("{}").alias("groups"))
    return store.save_presets(t, new)


@query("""WITH t AS (SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(o_custkey AS BIGINT) AS photo_id, 'old' AS name, '{}' AS settings, CAST(1 AS BIGINT) AS ts FROM orders WHERE o_orderkey % 3 > 0)
SELECT * FROM t UNION ALL SELECT (SELECT max(id) FROM t) + row_number() OVER (ORDER BY c_custkey), CAST(c_custkey AS BIGINT), c_name, '{"x":1}', 9 FROM customer""")
def snapshots_added_and_deleted(spark, sf):
    t = table(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("id"), F.col("o_custkey").cast("long").alias("photo_id"), F.lit("old").alias("name"), F.lit("{}").alias("settings"), F.lit(1).cast("long").alias("ts"))
    t = store.delete_snapshots(t, t.where("id % 3 = 0"))
    return store.add_snapshot(t, table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("photo_id"), F.col("c_name").alias("name"), F.lit('{"x":1}').alias("settings")), 9)


@query("SELECT vec_id AS id, CAST(vec_id AS VARCHAR) AS thumb FROM embeddings WHERE vec_id % 4 = 0 AND vec_id % 3 > 0")
def face_thumbs_looked_up(spark, sf):
    e = table(spark, sf, "embeddings")
    faces = e.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 3 > 0, F.col("vec_id").cast("string").cast("binary")).alias("thumb"))
    return store.face_thumbs(faces, faces.where("id % 4 = 0")).select("id", F.col("thumb").cast("string").alias("thumb"))
