"""Queries of edits over selections, snapshots, and folders of files that Spark writes from the star schema and reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from fotolake.functions import settings
from fotolake.functions.session import new_path
from fotolake.operators import edits, export, snapshots
from fotolake.operators.predicates import Rule
from fotolake.plans.queries import query
from fotolake.plans.shapes import spread, table
from fotolake.plans.tag_queries import _directory
from fotolake.sources import files

DOCS = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN concat('{"contrast":1,"detail":{"noise":2},"exposure":', CAST(o_orderkey % 3 AS STRING), '}')
  ELSE concat('{"contrast":', CAST(o_orderkey % 5 AS STRING), ',"detail":{"noise":7},"exposure":1}') END AS develop, CAST(0 AS BIGINT) AS edited_at FROM orders"""
HISTORY = "SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS id, CAST(l_orderkey AS BIGINT) AS photo_id, 'old' AS label, '{}' AS settings, CAST(5 AS BIGINT) AS ts FROM lineitem"
DEFAULT = '{"contrast": 0, "detail": {"noise": 0}, "exposure": 0}'


def _docs(spark, sf):
    return spark.sql(DOCS.replace("{", "{{").replace("}", "}}").replace("FROM orders", "FROM {orders}"), orders=table(spark, sf, "orders"))


def _history(spark, sf):
    return spark.sql(HISTORY.replace("{}", "{{}}").replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf, "lineitem"))


def _synced(spark, sf):
    docs = _docs(spark, sf)
    chosen = docs.where("id % 2 = 0 or id % 4 = 1").select("id").unionByName(docs.where("id % 8 = 0").select("id"))
    return edits.auto_sync(docs, _history(spark, sf), chosen, '{"contrast": 0, "exposure": 0}', '{"contrast": 0, "exposure": 1}', DEFAULT, "Sync", 99)


#: In each document: what the selection makes of it. A document that says exposure 1 already is not edited.
SYNCED = f"""WITH d AS ({DOCS}), s AS (SELECT *, id % 4 <> 3 AND coalesce(CAST(json_extract(develop, '$.exposure') AS INTEGER), 0) <> 1 AS hit,
CAST(coalesce(json_extract(develop, '$.contrast'), '0') AS INTEGER) AS contrast, CAST(coalesce(json_extract(develop, '$.detail.noise'), '0') AS INTEGER) AS noise FROM d),
n AS (SELECT *, concat('{{"contrast": ', contrast, ', "detail": {{"noise": ', noise, '}}, "exposure": 1}}') AS put FROM s)"""


@query(SYNCED + " SELECT id, CASE WHEN hit THEN put ELSE develop END AS develop, CAST(CASE WHEN hit THEN 99 ELSE 0 END AS BIGINT) AS edited_at FROM n")
def edits_synced(spark, sf):
    """A change of one document put into a selection; documents that have it already are left alone."""
    return _synced(spark, sf)[0]


@query(SYNCED + f", h AS ({HISTORY}) SELECT * FROM h UNION ALL SELECT (SELECT max(id) FROM h) + row_number() OVER (ORDER BY id), id, 'Sync', put, 99 FROM n WHERE hit")
def edits_synced_history(spark, sf):
    """The history of the same, with ids after the last."""
    return _synced(spark, sf)[1]


@query(f"""WITH d AS ({DOCS}) SELECT id, CASE WHEN id % 3 = 0 AND coalesce(CAST(json_extract(develop, '$.detail.noise') AS INTEGER), 0) <> 7
THEN concat('{{"contrast": ', CAST(coalesce(json_extract(develop, '$.contrast'), '0') AS INTEGER), ', "detail": {{"noise": 7}}, "exposure": ', CAST(coalesce(json_extract(develop, '$.exposure'), '0') AS INTEGER), '}}') ELSE develop END AS develop FROM d""")
def settings_pasted(spark, sf):
    """One group of settings put into a selection."""
    docs = _docs(spark, sf)
    source = '{"exposure": 5, "contrast": 9, "detail": {"noise": 7}}'
    return edits.paste(docs, _history(spark, sf), docs.where("id % 3 = 0"), source, ["detail"], DEFAULT, "Paste", 99)[0].select("id", "develop")


@query(f"""WITH d AS ({DOCS}), f AS (SELECT CAST(o_orderkey AS BIGINT) AS id, o_orderkey % 6 AS e FROM orders WHERE o_orderkey % 2 = 1) SELECT d.id, coalesce(CAST(json_extract(develop, '$.exposure') AS INTEGER), 0) <> e AS edited, e AS exposure,
CAST(coalesce(json_extract(develop, '$.contrast'), '0') AS INTEGER) AS contrast FROM d JOIN f USING (id)""")
def fields_applied(spark, sf):
    """Numbers of each photo's own, as auto tone makes them, put into its document."""
    docs = _docs(spark, sf)
    fields = docs.where("id % 2 = 1").select("id", (F.col("id") % 6).alias("exposure"))
    put, _ = edits.apply_fields(docs, _history(spark, sf), fields, DEFAULT, "Auto", 99)
    number = lambda k: F.get_json_object("develop", f"$.{k}").cast("int").alias(k)
    return put.where("id % 2 = 1").select("id", (F.col("edited_at") == 99).alias("edited"), number("exposure"), number("contrast"))


@query(f"""WITH d AS ({DOCS}) SELECT id FROM d WHERE develop IS NOT NULL AND NOT (CASE WHEN id % 2 = 1 THEN CAST(json_extract(develop, '$.exposure') AS INTEGER) = 0 AND CAST(json_extract(develop, '$.contrast') AS INTEGER) = 1 AND CAST(json_extract(develop, '$.detail.noise') AS INTEGER) = 2
ELSE CAST(json_extract(develop, '$.exposure') AS INTEGER) = 1 AND CAST(json_extract(develop, '$.contrast') AS INTEGER) = 2 AND CAST(json_extract(develop, '$.detail.noise') AS INTEGER) = 7 END)""")
def rule_has_edits_of_documents(spark, sf):
    """The rule over documents, each against the default of its kind of file, whatever the order of keys and the form of numbers."""
    defaults = {True: {"exposure": 0, "contrast": 1, "detail": {"noise": 2.0}, "masks": []}, False: {"detail": {"noise": 7}, "exposure": 1.0, "contrast": 2}}
    docs = _docs(spark, sf).withColumn("edited", settings.edited(F.col("develop"), F.col("id") % 2 == 1, defaults))
    return docs.where(Rule("has_edits", True).column()).select("id")


@query("SELECT 'customer' AS \"table\", count(*) AS rows, sum(c_custkey) AS ids, '2026-01-03 000000' AS stamp FROM customer WHERE c_custkey % 3 <> 2 UNION ALL SELECT 'nation', count(*), sum(n_nationkey), '2026-01-03 000000' FROM nation")
def backup_restored(spark, sf):
    """The newest whole snapshot of two tables, though a later one was torn."""
    root = new_path(spark, "backups")
    customer, nation = table(spark, sf, "customer"), table(spark, sf, "nation")
    for day, rest, only in ((1, 0, None), (3, 2, None), (4, 1, 1)):
        snapshots.backup(spark, {"customer": customer.where(F.col("c_custkey") % 3 != rest), "nation": nation}, root, f"2026-01-0{day} 000000", only)
    stamp, out = snapshots.newest(spark, root), None
    for name, df in snapshots.restore(spark, root).items():
        part = df.agg(F.count("*").alias("rows"), F.sum(df.columns[0]).alias("ids")).select(F.lit(name).alias("table"), "rows", "ids", F.lit(stamp).alias("stamp"))
        out = part if out is None else out.unionByName(part)
    return out


FILES = "SELECT c_custkey AS k, concat('IMG_', CAST(c_custkey AS STRING), '.', CASE c_custkey % 4 WHEN 0 THEN 'CR2' WHEN 1 THEN 'jpg' WHEN 2 THEN 'txt' ELSE 'NEF' END) AS name, CASE c_custkey % 5 WHEN 0 THEN '.hidden/' WHEN 1 THEN '$trash/a/' WHEN 2 THEN 'a/b/' ELSE '' END AS dir FROM customer"


def _photo_files(spark, sf):
    """TIFF heads with a maker, an orientation and a time, of which some are missing; every seventh file is damaged."""
    k = F.col("k")
    rows = spark.sql(FILES.replace("FROM customer", "FROM {customer}"), customer=spread(table(spark, sf, "customer"), "c_custkey"))
    text = lambda s: [F.lit(b) for b in s.encode() + b"\0"]
    maker = (0x10F, 1, text("Maker"))
    at = 8 + 2 + 12 * 3 + 4 + 6
    first, end = _directory([maker, (0x112, 3, [1 + k % 8]), (0x8769, 4, [F.lit(at)])], 8)
    first = F.replace(first, F.lit("010F000100000006"), F.lit("010F000200000006"))
    taken = F.concat(F.lit("2024:03:"), F.lpad((1 + k % 28).cast("string"), 2, "0"), F.lit(" 10:20:30"))
    exif = F.concat(F.lit(f"00019003000200000014{at + 18:08X}00000000"), F.hex(F.encode(taken, "UTF-8")), F.lit("00"))
    none = F.lit("000000000000")
    content = F.unhex(F.concat(F.lit("4D4D002A00000008"), first, F.when(k % 3 == 0, none).otherwise(exif)))
    content = F.when(k % 7 == 0, F.substring(content, 1, 20)).otherwise(content)
    target = new_path(spark, "photos")
    export.export(rows.select(k.alias("id"), F.concat("dir", "name").alias("dest"), content.alias("content")), target, new_path(spark, "status"))
    return target


@query(f"SELECT name, lower(split_part(name, '.', 2)) AS ext, CASE WHEN k % 4 = 1 THEN 'raster' ELSE 'raw' END AS kind FROM ({FILES}) WHERE k % 4 <> 2 AND k % 5 > 1")
def folder_scanned(spark, sf):
    """Supported files of a folder, without hidden ones, from a listing alone."""
    return files.scan(spark, _photo_files(spark, sf)).select("name", "ext", "kind")


@query(f"""SELECT name, CASE WHEN k % 7 <> 0 AND k % 4 <> 1 THEN 'Maker' END AS make, CAST(CASE WHEN k % 7 <> 0 AND k % 4 <> 1 THEN 1 + k % 8 ELSE 1 END AS INTEGER) AS orientation, k % 7 = 0 OR k % 3 = 0 OR k % 4 = 1 AS from_file,
CASE WHEN k % 7 <> 0 AND k % 3 <> 0 AND k % 4 <> 1 THEN concat('2024-03-', lpad(CAST(1 + k % 28 AS STRING), 2, '0'), ' 10:20:30') END AS taken FROM ({FILES}) WHERE k % 4 <> 2 AND k % 5 > 1""")
def metadata_read(spark, sf):
    """What heads say, with the file's own time and an upright orientation where they say nothing or are damaged."""
    target = _photo_files(spark, sf)
    found = files.metadata(spark, target)
    plain = F.col("ext") == "jpg"  # these are no JPEG files, so their heads say nothing
    said = ~F.col("from_file") & ~plain
    return found.select("name", F.when(~plain, F.col("make")).alias("make"), F.when(plain, 1).otherwise(F.col("orientation")).alias("orientation"), (~said).alias("from_file"), F.when(said, F.col("capture_time")).alias("taken"))


PRESETS = "SELECT p_partkey AS k, concat('g', CAST(p_partkey % 5 AS STRING), '/p', CAST(p_partkey AS STRING), CASE WHEN p_partkey % 2 = 0 THEN '.XMP' ELSE '.lrtemplate' END) AS dest, p_size AS size FROM part"


@query(f"""WITH p AS ({PRESETS}), s AS (SELECT *, CASE WHEN k % 2 = 0 THEN CASE WHEN k % 10 = 0 THEN 'no XML' WHEN k % 10 = 2 THEN 'a preset without settings' END
  ELSE CASE k % 10 WHEN 1 THEN 'no Lua table' WHEN 3 THEN 'not a develop preset: Print' WHEN 5 THEN 'no settings' WHEN 7 THEN 'no develop settings' END END AS error FROM p)
SELECT dest, concat('g', k % 5) AS grp, CASE WHEN k % 10 = 4 THEN concat('N & ', k) WHEN k % 10 = 9 THEN concat('T ', k) WHEN k % 10 = 3 OR k % 10 = 5 OR k % 10 = 7 THEN concat('T ', k) ELSE concat('p', k) END AS name, CASE WHEN error IS NULL THEN 'ok' ELSE 'failed' END AS status, error,
CASE WHEN error IS NULL THEN CAST(size AS DOUBLE) END AS exposure, CASE WHEN error IS NULL THEN CASE WHEN k % 2 = 0 THEN 'Look ' || k ELSE 'L' || k END END AS profile, CASE WHEN error IS NULL THEN round((k % 256) / 255.0, 6) END AS y FROM s""")
def presets_from_files(spark, sf):
    """Packets and templates of a folder as one table; files that are none have a status and an error."""
    k, text = F.col("k"), lambda c: c.cast("string")
    rows = spark.sql(PRESETS.replace("FROM part", "FROM {part}"), part=spread(table(spark, sf, "part"), "p_partkey"))
    named = F.when(k % 10 == 4, F.concat(F.lit('<crs:Name><rdf:Alt><rdf:li xml:lang="x-default">N &amp; '), text(k), F.lit("</rdf:li></rdf:Alt></crs:Name>"))).otherwise("")
    packet = F.concat(F.lit('<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description xmlns:crs="http://ns.adobe.com/camera-raw-settings/1.0/" crs:Exposure2012="'), text(F.col("size")), F.lit('"'), F.when(k % 10 == 2, ' crs:HasSettings="False"').otherwise(""), F.lit(">"), named, F.lit("<crs:ToneCurvePV2012><rdf:Seq><rdf:li>0, 0</rdf:li><rdf:li>255, "), text(k % 256), F.lit('</rdf:li></rdf:Seq></crs:ToneCurvePV2012><crs:Look><rdf:Description crs:Name="Look '), text(k), F.lit('" crs:Amount="1"><crs:Parameters><rdf:Description crs:Exposure2012="99"/></crs:Parameters></rdf:Description></crs:Look></rdf:Description></rdf:RDF></x:xmpmeta>'))
    packet = F.when(k % 10 == 0, "<broken").otherwise(packet)
    inner = F.when(k % 10 == 7, "HasCrop = false").otherwise(F.concat(F.lit("Exposure2012 = "), text(F.col("size")), F.lit(", ToneCurvePV2012 = {0, 0, 255, "), text(k % 256), F.lit('}, Look = { Name = "L'), text(k), F.lit('", Amount = 0.5 }')))
    body = F.when(k % 10 == 5, "value = {}").otherwise(F.concat(F.lit("value = { settings = { "), inner, F.lit(" } }")))
    lua = F.concat(F.lit('s = { type = "'), F.when(k % 10 == 3, "Print").otherwise("Develop"), F.lit('", title = "T '), text(k), F.lit('", '), body, F.lit(" }"))
    lua = F.when(k % 10 == 1, "no table").otherwise(lua)
    content = F.when(k % 2 == 0, packet).otherwise(lua)
    wide = F.concat(F.unhex(F.lit("FFFE")), F.encode(content, "UTF-16LE"))
    target = new_path(spark, "presets")
    export.export(rows.select(k.alias("id"), "dest", F.when(k % 4 == 0, wide).otherwise(content.cast("binary")).alias("content")), target, new_path(spark, "status"))
    found = files.preset_files(spark, target)
    curve = F.get("curves", F.lit(0))
    return found.select(F.regexp_extract("path", r"(g\d/[^/]*)$", 1).alias("dest"), "grp", "name", "status", "error", "settings.exposure", "settings.profile", F.round(F.try_element_at(curve, F.lit(-1))["y"], 6).alias("y"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN p_partkey % 5 > 0 THEN least(100.0, p_size * 4) END AS opacity, CASE WHEN p_partkey % 5 > 0 THEN CAST(p_partkey % 9 AS INTEGER) END AS anchor,
CASE WHEN p_partkey % 5 > 0 THEN CAST(CASE WHEN p_size * 20 > 900 THEN p_size * 20 - 1080 WHEN p_size * 20 > 540 THEN p_size * 20 - 720 WHEN p_size * 20 > 180 THEN p_size * 20 - 360 ELSE p_size * 20 END AS DOUBLE) END AS shadow_angle, CASE WHEN p_partkey % 5 > 0 THEN p_name END AS text_shown, CASE WHEN p_partkey % 5 > 0 THEN 'arial' END AS font FROM part""")
def watermarks_from_files(spark, sf):
    """Watermarks of a folder of templates, limits and choices applied."""
    part, k = spread(table(spark, sf, "part"), "p_partkey"), F.col("p_partkey")
    anchor = F.get(F.array(*map(F.lit, files.ANCHORS)), (k % 9).cast("int"))
    text = F.concat(F.lit('s = { type = "'), F.when(k % 5 == 0, "Develop").otherwise("WatermarkingPreset"), F.lit('", value = { items = { { kind = "text", text = "'), F.col("p_name"), F.lit('", textFontName = "Arial-Bold", opacity = '), (F.col("p_size") * 4 / 100).cast("string"), F.lit(", textShadowAngle = "), (F.col("p_size") * 20).cast("string"), F.lit(', anchor = "'), anchor, F.lit('" } } } }'))
    target = new_path(spark, "watermarks")
    export.export(part.select(k.alias("id"), F.concat(F.lit("w"), k.cast("string"), F.lit(".lrtemplate")).alias("dest"), text.alias("content")), target, new_path(spark, "status"))
    found = files.watermark_files(spark, target)
    return found.select(F.regexp_extract("path", r"w(\d+)\.[^/]*$", 1).cast("long").alias("id"), "status", "opacity", "anchor", "shadow_angle", "text_shown", "font")
