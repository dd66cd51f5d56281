"""Queries of scalar functions and small joins, over columns of the star schema, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fotolake.functions import color, text, vector
from fotolake.operators import lens, people, planning, sensor, session, stats
from fotolake.plans.queries import FC, LENS_NAME, P, PIXELS, pixels, query
from fotolake.plans.shapes import faces, photos, table
from fotolake.sources import presets

c = F.col

# Text -----------------------------------------------------------------------------------------------------------------------


@query("SELECT event_id, strftime(make_timestamp(CAST(1700000000 + event_id * 3601 AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') AS t FROM events")
def times_written(spark, sf):
    return table(spark, sf, "events").select("event_id", text.unix_to_string(F.lit(1_700_000_000).cast("long") + c("event_id") * 3601).alias("t"))


@query("SELECT event_id, CASE event_id % 4 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 0 END AS corner, CASE event_id % 9 WHEN 6 THEN 1 WHEN 3 THEN 2 WHEN 8 THEN 3 ELSE 0 END AS exif FROM events")
def quarter_turns(spark, sf):
    code = F.element_at(F.array(*map(F.lit, ("AB", "BC", "CD", "DA"))), (c("event_id") % 4 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", text.orientation_steps(code).alias("corner"), text.exif_steps(c("event_id") % 9).alias("exif"))


@query("SELECT l_orderkey, l_linenumber, concat(CASE WHEN v > 0 THEN '+' ELSE '' END, CASE WHEN abs(v - round(v)) < 1e-4 THEN CAST(CAST(round(v) AS BIGINT) AS STRING) ELSE format('{:.2f}', v) END) AS s FROM (SELECT l_orderkey, l_linenumber, CAST(l_linenumber * 25 - l_orderkey % 200 AS DOUBLE) / 8 + CAST(l_orderkey % 9 AS DOUBLE) / 1000 AS v FROM lineitem)")
def numbers_signed(spark, sf):
    v = (c("l_linenumber") * 25 - c("l_orderkey") % 200).cast("double") / 8 + (c("l_orderkey") % 9).cast("double") / 1000
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.signed_number(v).alias("s"))


@query("SELECT o_orderkey, CASE WHEN n < 1024 THEN concat(CAST(n AS STRING), ' B') WHEN n < 1048576 THEN format('{:.1f} KB', n / 1024.0::DOUBLE) WHEN n < 1073741824 THEN format('{:.1f} MB', n / 1048576.0::DOUBLE) ELSE format('{:.2f} GB', n / 1073741824.0::DOUBLE) END AS s FROM (SELECT o_orderkey, CAST(o_orderkey AS BIGINT) * CAST(o_orderkey AS BIGINT) * 512 + 512 * (o_orderkey % 2) AS n FROM orders)")
def sizes_written(spark, sf):
    k = c("o_orderkey").cast("long")
    return table(spark, sf, "orders").select("o_orderkey", text.human_size(k * k * 512 + 512 * (k % 2)).alias("s"))


@query("SELECT p_partkey, concat(p_name, ' & <', p_brand, '>') AS title FROM part WHERE p_partkey % 5 <> 0 UNION ALL SELECT p_partkey, NULL FROM part WHERE p_partkey % 5 = 0")
def titles_of_packets(spark, sf):
    title = text.escape(F.concat("p_name", F.lit(" & <"), "p_brand", F.lit(">")))
    packet = F.when(c("p_partkey") % 5 == 0, "<dc:title/>").otherwise(F.concat(F.lit("<x><dc:title><rdf:Alt>\n<rdf:li xml:lang='a'>"), title, F.lit("</rdf:li><rdf:li>no</rdf:li></rdf:Alt></dc:title></x>")))
    return table(spark, sf, "part").select("p_partkey", text.xmp_title(packet).alias("title"))


@query(f"{P} SELECT id, CASE WHEN title <> '' THEN title ELSE file_name END AS title, file_name AS file FROM p")
def captions_for_print(spark, sf):
    return photos(spark, sf).select("id", text.caption("title").alias("title"), text.caption("file").alias("file"))


@query("SELECT c_custkey, concat('Hello ', c_name, ' of ', c_mktsegment, '!') AS s FROM customer")
def tokens_expanded(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", text.expand_tokens("Hello {name} of {seg}{none}!", {"name": c("c_name"), "seg": c("c_mktsegment"), "none": F.lit(None).cast("string")}).alias("s"))


@query(f"{P} SELECT id, folder AS dir, file_name AS name, ext FROM p")
def paths_taken_apart(spark, sf):
    folder, name, ext = text.file_parts(c("path"))
    return photos(spark, sf).select("id", folder.alias("dir"), name.alias("name"), ext.alias("ext"))


@query(f"SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(replace(lower(n), 'f/2.80', 'f 2.8'), '([0-9][0-9.]*|[a-z]+)'), lambda w: w NOT IN ('mm', 'f')))), ' ') AS w FROM (SELECT p_partkey, {LENS_NAME} AS n FROM part)")
def lens_name_words(spark, sf):
    name = F.expr("concat(p_brand, ' EF', cast(10 + p_size as string), '-', cast(60 + p_size * 2 as string), 'mm f/2.80 ', split_part(p_name, ' ', 1), ' ', split_part(p_name, ' ', 2))")
    return table(spark, sf, "part").select("p_partkey", F.array_join(text.lens_words(name), " ").alias("w"))


# Colour ---------------------------------------------------------------------------------------------------------------------

RGB = f"SELECT DISTINCT r / 255.0::DOUBLE AS r, g / 255.0::DOUBLE AS g, b / 255.0::DOUBLE AS b FROM ({PIXELS})"


def rgb(spark, sf):
    return pixels(spark, sf).select(*((c(x) / 255.0).alias(x) for x in "rgb")).distinct()


@query(f"SELECT r, g, b, round(r * cs + sn * (b - g) + m, 9) AS r2, round(g * cs + sn * (r - b) + m, 9) AS g2, round(b * cs + sn * (g - r) + m, 9) AS b2 FROM (SELECT *, cos(radians(r * 90)) AS cs, sin(radians(r * 90)) / sqrt(3.0::DOUBLE) AS sn, (r + g + b) / 3 * (1 - cos(radians(r * 90))) AS m FROM ({RGB}))")
def hues_rotated(spark, sf):
    out = color.rotate_hue(c("r"), c("g"), c("b"), c("r") * 90)
    return rgb(spark, sf).select("r", "g", "b", *(F.round(x, 9).alias(f"{n}2") for n, x in zip("rgb", out)))


HSV = "v - v * s * greatest(0.0::DOUBLE, least({k}, 4 - {k}, 1.0::DOUBLE))"


@query("SELECT h, s, v, " + ", ".join(f"round({HSV.format(k=f'((({n} + h / 60) % 6))')}, 9) AS {x}" for n, x in ((5, "r"), (3, "g"), (1, "b"))) + " FROM (SELECT DISTINCT CAST(l_orderkey % 360 AS DOUBLE) AS h, CAST(l_linenumber AS DOUBLE) / 7 AS s, CAST(l_discount AS DOUBLE) * 10 AS v FROM lineitem)")
def colours_from_hsv(spark, sf):
    df = table(spark, sf, "lineitem").select((c("l_orderkey") % 360).cast("double").alias("h"), (c("l_linenumber").cast("double") / 7).alias("s"), (c("l_discount").cast("double") * 10).alias("v")).distinct()
    return df.select("h", "s", "v", *(F.round(x, 9).alias(n) for n, x in zip("rgb", color.hsv_to_rgb(c("h"), c("s"), c("v")))))


LIN = "CASE WHEN {0} <= 0.04045 THEN {0} / 12.92 ELSE pow(({0} + 0.055) / 1.055, 2.4) END"
CURVE = "CASE WHEN {0} > 216.0::DOUBLE / 24389 THEN pow({0}, 1.0::DOUBLE / 3) ELSE (24389.0::DOUBLE / 27 * {0} + 16) / 116 END"
LAB = f"""SELECT r, g, b, 116 * fy - 16 AS l, 500 * (fx - fy) AS a, 200 * (fy - fz) AS bb FROM (SELECT r, g, b, {CURVE.format('x')} AS fx, {CURVE.format('y')} AS fy, {CURVE.format('z')} AS fz FROM
(SELECT r, g, b, (0.4124564 * lr + 0.3575761 * lg + 0.1804375 * lb) / 0.95047 AS x, 0.2126729 * lr + 0.7151522 * lg + 0.0721750 * lb AS y, (0.0193339 * lr + 0.1191920 * lg + 0.9503041 * lb) / 1.08883 AS z FROM
(SELECT r, g, b, {LIN.format('r')} AS lr, {LIN.format('g')} AS lg, {LIN.format('b')} AS lb FROM ({RGB}))))"""


@query(f"SELECT r, g, b, round(l, 6) AS l, round(a, 6) AS a, round(bb, 6) AS bb, round(sqrt(pow(l - 50, 2) + a * a + bb * bb), 6) AS e FROM ({LAB})")
def colours_in_lab(spark, sf):
    lab = color.lab(c("r"), c("g"), c("b"))
    grey = (F.lit(50.0), F.lit(0.0), F.lit(0.0))
    return rgb(spark, sf).select("r", "g", "b", *(F.round(x, 6).alias(n) for n, x in zip(("l", "a", "bb"), lab)), F.round(color.delta_e(lab, grey), 6).alias("e"))


@query(f"SELECT r, g, b, round(greatest(-1.0, least(1.0, log2(greatest(b, 1e-4) / greatest(r, 1e-4)))), 9) AS temp, round(greatest(-1.0, least(1.0, log2(greatest(g, 1e-4) / sqrt(greatest(r, 1e-4) * greatest(b, 1e-4))))), 9) AS tint FROM ({RGB})")
def white_balances(spark, sf):
    temp, tint = color.wb_from_sample(c("r"), c("g"), c("b"))
    return rgb(spark, sf).select("r", "g", "b", F.round(temp, 9).alias("temp"), F.round(tint, 9).alias("tint"))


@query("SELECT h, CAST(CASE WHEN h < 30 THEN 3 WHEN h < 60 THEN 0 WHEN h < 180 THEN 1 WHEN h < 300 THEN 2 ELSE 3 END AS INT) AS band, round(t * t * (3 - 2 * t), 9) AS w FROM (SELECT h, CASE WHEN h < 30 THEN (h + 60) / 90 WHEN h < 60 THEN (h - 30) / 30 WHEN h < 180 THEN (h - 60) / 120 WHEN h < 300 THEN (h - 180) / 120 ELSE (h - 300) / 90 END AS t FROM (SELECT DISTINCT CAST(l_partkey % 360 AS DOUBLE) AS h FROM lineitem))")
def hue_bands(spark, sf):
    df = table(spark, sf, "lineitem").select((c("l_partkey") % 360).cast("double").alias("h")).distinct()
    first, _, weight = color.band_of(c("h"), [30.0, 60.0, 180.0, 300.0])
    return df.select("h", first.cast("int").alias("band"), F.round(weight, 9).alias("w"))


@query(f"SELECT r, g, b, round(greatest(0.0, least(1.0, (r - 0.1) / 0.8)), 9) AS v FROM ({RGB})")
def values_stretched(spark, sf):
    return rgb(spark, sf).select("r", "g", "b", F.round(color.stretched(c("r"), 0.1, 0.9), 9).alias("v"))


# Numbers --------------------------------------------------------------------------------------------------------------------


@query("SELECT event_id, round(CASE WHEN x <= 1 THEN 10.0 WHEN x >= 7 THEN 5.0 WHEN x < 3 THEN 10 + (x - 1) / 2 * 20 ELSE 30 + (x - 3) / 4 * -25 END, 9) AS y FROM (SELECT event_id, CAST(event_id % 90 AS DOUBLE) / 10 AS x FROM events)")
def values_interpolated(spark, sf):
    knots, values = F.array(*map(F.lit, (1.0, 3.0, 7.0))), F.array(*map(F.lit, (10.0, 30.0, 5.0)))
    return table(spark, sf, "events").select("event_id", F.round(vector.interp((c("event_id") % 90).cast("double") / 10, knots, values), 9).alias("y"))


@query("SELECT event_id, round((2 * t * t * t - 3 * t * t + 1) * 2 + (t * t * t - 2 * t * t + t) * 2.5 + (3 * t * t - 2 * t * t * t) * 6 + (t * t * t - t * t) * 4, 9) AS y FROM (SELECT event_id, CAST(event_id % 100 AS DOUBLE) / 100 AS t FROM events)")
def hermite_between(spark, sf):
    y = vector.hermite(F.lit(1.0), F.lit(2.0), F.lit(6.0), F.lit(None).cast("double"), (c("event_id") % 100).cast("double") / 100)
    return table(spark, sf, "events").select("event_id", F.round(y, 9).alias("y"))


@query("SELECT image, channel, bin, sum(n) AS n FROM (SELECT l_suppkey % 20 AS image, 'l' AS channel, CAST(l_linenumber AS INT) AS bin, 1 AS n FROM lineitem UNION ALL SELECT o_custkey % 20, 'l', CAST(o_orderkey % 9 AS INT), 2 FROM orders) GROUP BY 1, 2, 3")
def histograms_merged(spark, sf):
    a = table(spark, sf, "lineitem").select((c("l_suppkey") % 20).alias("image"), F.lit("l").alias("channel"), c("l_linenumber").cast("int").alias("bin"), F.lit(1).alias("n"))
    b = table(spark, sf, "orders").select((c("o_custkey") % 20).alias("image"), F.lit("l").alias("channel"), (c("o_orderkey") % 9).cast("int").alias("bin"), F.lit(2).alias("n"))
    return stats.merge_histograms(a, b)


XY = "SELECT l_suppkey % 10 AS image, l_partkey % 64 AS x, l_orderkey % 48 AS y, CAST(l_linenumber AS DOUBLE) AS r, CAST(l_linenumber % 3 AS DOUBLE) AS g, CAST(l_orderkey % 5 AS DOUBLE) AS b FROM lineitem"


def xy(spark, sf):
    return spark.sql(XY.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf, "lineitem"))


@query(f"SELECT image, x // 8 AS cx, y // 8 AS cy, round(avg(0.2126 * r + 0.7152 * g + 0.0722 * b), 6) AS luma FROM ({XY}) GROUP BY 1, 2, 3")
def luma_of_cells(spark, sf):
    return stats.small_luma(xy(spark, sf), 8).withColumn("luma", F.round("luma", 6))


@query(f"SELECT image, x, y, round(avg(r) OVER w, 6) AS r, round(avg(g) OVER w, 6) AS g, round(avg(b) OVER w, 6) AS b FROM ({XY}) WINDOW w AS (PARTITION BY image, x // 8, y // 8)")
def mosaics(spark, sf):
    return stats.mosaic(xy(spark, sf), 8).select("image", "x", "y", *(F.round(n, 6).alias(n) for n in "rgb"))


# Sensors --------------------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey AS shot, round(CASE WHEN c_custkey % 7 = 3 THEN 0.5 WHEN c_custkey % 2 = 0 AND iso < 100 THEN -log2(100.0 / iso) ELSE 0.0 END, 9) AS ev, round(CASE WHEN c_custkey % 5 > 0 THEN log2((c_custkey % 5) * 100 / 100.0) ELSE 0.0 END, 9) AS dr FROM (SELECT *, 25 * (1 + c_custkey % 6) AS iso FROM customer)")
def iso_offsets(spark, sf):
    shots = table(spark, sf, "customer").select(c("c_custkey").alias("shot"), F.when(c("c_custkey") % 2 == 0, "CANON").otherwise("Nikon").alias("make"), F.concat(F.lit("Model "), (c("c_custkey") % 7).cast("string")).alias("model"), (25 * (1 + c("c_custkey") % 6)).alias("iso"), (c("c_custkey") % 5 * 100).alias("percent"))
    steps = spark.createDataFrame([("model 3", 0.5)], "model string, ev double")
    ev = sensor.low_iso_ev(c("make"), c("model"), c("iso"), steps, shots)
    return shots.select("shot", F.round(sensor.dynamic_range_ev(c("percent")), 9).alias("dr")).join(ev.withColumn("ev", F.round("ev", 9)), "shot")


TURN = "CASE o WHEN 3 THEN 1 - {0} WHEN 6 THEN {1} WHEN 8 THEN {2} ELSE {0} END"


@query("SELECT event_id, round(" + TURN.format("x", "y", "1 - y") + ", 9) AS sx, round(" + TURN.format("y", "1 - x", "x") + ", 9) AS sy, x AS bx, y AS \"by\" FROM (SELECT event_id, CAST(event_id % 101 AS DOUBLE) / 101 AS x, CAST(event_id % 37 AS DOUBLE) / 37 AS y, 1 + event_id % 9 AS o FROM events)")
def sensor_places(spark, sf):
    """Display places in the sensor's frame, and back."""
    df = table(spark, sf, "events").select("event_id", ((c("event_id") % 101).cast("double") / 101).alias("x"), ((c("event_id") % 37).cast("double") / 37).alias("y"), (1 + c("event_id") % 9).alias("o"))
    sx, sy = sensor.to_sensor(c("x"), c("y"), c("o"))
    bx, by = sensor.from_sensor(c("sx"), c("sy"), c("o"))
    df = df.withColumns({"sx": sx, "sy": sy}).withColumns({"bx": bx, "by": by})
    return df.select("event_id", F.round("sx", 9).alias("sx"), F.round("sy", 9).alias("sy"), F.when(F.abs(c("bx") - c("x")) < 1e-12, c("x")).alias("bx"), F.when(F.abs(c("by") - c("y")) < 1e-12, c("y")).alias("by"))


@query("SELECT event_id, round(x * (1 + (k - 1) * 0.5), 9) AS x, CASE WHEN v <= 0 THEN 0 ELSE CAST(greatest(1, least(65535, round((log2(v) + 12) / 24 * 65534) + 1)) AS INT) END AS code FROM (SELECT event_id, CAST(event_id % 21 - 10 AS DOUBLE) / 10 AS x, 1 + CAST(event_id % 5 AS DOUBLE) / 50 AS k, CAST(event_id % 300 - 20 AS DOUBLE) / 100 AS v FROM events)")
def sensor_codes(spark, sf):
    x, k = (c("event_id") % 21 - 10).cast("double") / 10, 1 + (c("event_id") % 5).cast("double") / 50
    sx, _ = sensor.distorted(x, x, k, 0.5)
    return table(spark, sf, "events").select("event_id", F.round(sx, 9).alias("x"), sensor.log_code((c("event_id") % 300 - 20).cast("double") / 100).alias("code"))


@query(f"{P} SELECT id AS shot, coalesce(make = 'Canon' AND ext = 'CR3', false) AS distortion, coalesce(make = 'SONY', false) AND ext = 'NEF' AS ca, coalesce(make = 'Canon' AND ext = 'CR3', false) AS vignetting FROM p")
def corrections_by_maker(spark, sf):
    rules = spark.createDataFrame([("canon", "cr3", True, False, True), ("Sony", "NEF", False, True, False)], "make string, ext string, distortion boolean, ca boolean, vignetting boolean")
    return sensor.policy(photos(spark, sf).select(c("id").alias("shot"), "make", "ext"), rules)


BOX = "SELECT vec_id AS id, CAST(floor(vec_id / 4.0) AS BIGINT) AS photo_id, CAST(vec_id % 7 AS DOUBLE) AS x, CAST(vec_id % 5 AS DOUBLE) AS y, CAST(2 + vec_id % 3 AS DOUBLE) AS w, CAST(1 + vec_id % 4 AS DOUBLE) AS h FROM embeddings"


def boxes(spark, sf):
    return spark.sql(BOX.replace("FROM embeddings", "FROM {embeddings}"), embeddings=table(spark, sf, "embeddings"))


@query(f"SELECT photo_id, x + w / 2 AS cx, y + h / 2 AS cy, round(w / 2 * 1.2, 9) AS rx, round(h / 2 * 1.2, 9) AS ry FROM ({BOX})")
def faces_to_hide(spark, sf):
    return sensor.redaction_ellipses(boxes(spark, sf)).withColumns({"rx": F.round("rx", 9), "ry": F.round("ry", 9)})


@query(f"WITH b AS ({BOX}), j AS (SELECT a.id AS a, b.id AS b, greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0.0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0.0) AS i, a.w * a.h + b.w * b.h AS s FROM b a JOIN b ON a.photo_id = b.photo_id AND a.id < b.id) SELECT a, b, round(i / greatest(s - i, 1e-6), 9) AS iou FROM j")
def boxes_over_boxes(spark, sf):
    one = boxes(spark, sf).select("photo_id", c("id").alias("a"), F.struct("x", "y", "w", "h").alias("p"))
    two = boxes(spark, sf).select("photo_id", c("id").alias("b"), F.struct("x", "y", "w", "h").alias("q"))
    return one.join(two, "photo_id").where("a < b").select("a", "b", F.round(people.iou(c("p"), c("q")), 9).alias("iou"))


@query("SELECT p_partkey, CAST(p_size * 40 - 300 - 25 AS DOUBLE) AS x, CAST((p_size * 30 - 90) / 2.0 AS DOUBLE) AS y FROM part")
def layers_placed(spark, sf):
    x, y = sensor.placed(c("p_size") * 40.0, c("p_size") * 30.0, F.lit(300.0), F.lit(90.0), "middle-right", 25.0)
    return table(spark, sf, "part").select("p_partkey", x.alias("x"), y.alias("y"))


@query("SELECT p_partkey, round(0.5 - nw / 2, 9) AS l, round(0.5 - nh / 2, 9) AS t FROM (SELECT p_partkey, CASE WHEN f > 1.5 THEN h * 1.5 / (f * h / w) ELSE w END AS nw, CASE WHEN f > 1.5 THEN h ELSE w * (f * h / w) / 1.5 END AS nh FROM (SELECT p_partkey, w, h, w / h * 1.2 AS f FROM (SELECT p_partkey, 0.2 + p_size / 100.0::DOUBLE AS w, 0.4::DOUBLE AS h FROM part)))")
def crops_reshaped(spark, sf):
    w = 0.2 + c("p_size") / 100.0
    r = sensor.crop_to_aspect(0.5 - w / 2, F.lit(0.3), 0.5 + w / 2, F.lit(0.7), F.lit(1.2), 1.5)
    return table(spark, sf, "part").select("p_partkey", r.alias("r")).select("p_partkey", F.round("r.left", 9).alias("l"), F.round("r.top", 9).alias("t"))


# Lenses and people ------------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey AS shot, CAST(1 + n_nationkey % 3 AS DOUBLE) AS crop FROM customer JOIN nation ON c_nationkey = n_nationkey")
def camera_crops(spark, sf):
    n = table(spark, sf, "nation")
    cameras = n.select(F.when(c("n_nationkey") % 2 == 0, c("n_name")).otherwise(F.concat(F.lit("Maker "), "n_name")).alias("model"), (1 + c("n_nationkey") % 3).cast("double").alias("crop"))
    shots = table(spark, sf, "customer").join(n, c("c_nationkey") == c("n_nationkey")).select(c("c_custkey").alias("shot"), F.lit("Maker").alias("make"), F.when(c("c_custkey") % 2 == 0, F.concat(F.lit("MAKER "), "n_name")).otherwise(F.lower("n_name")).alias("model"))
    return lens.camera_crop(shots, cameras)


@query("SELECT s_suppkey, round(1 + 0.01 * q + 0.02 * q * q + 0.03 * q * q * q, 9) AS v, round(1.001 + 0.0005 * r + 0.002 * q, 9) AS red, round((1 - 0.05 + 0.05 * q) / (1 - 0.05), 9) AS d FROM (SELECT s_suppkey, r, r * r AS q FROM (SELECT s_suppkey, CAST(s_suppkey % 100 AS DOUBLE) / 100 AS r FROM supplier))")
def lens_formulas(spark, sf):
    r = (c("s_suppkey") % 100).cast("double") / 100
    v = lens.vig_value(F.array(*map(F.lit, (0.01, 0.02, 0.03))), r)
    red, _ = lens.tca_ratio("poly3", F.array(*map(F.lit, (1.001, 0.999, 0.0005, 0.0, 0.002, 0.0))), r)
    d = lens.dist_ratio("poly3", F.array(F.lit(0.05)), r)
    return table(spark, sf, "supplier").select("s_suppkey", F.round(v, 9).alias("v"), F.round(red, 9).alias("red"), F.round(d, 9).alias("d"))


@query(f"""{FC}, a AS (SELECT photo_id % 50 AS g, face_id AS a, emb AS x FROM f WHERE face_id % 2 = 0), b AS (SELECT photo_id % 50 AS g, face_id AS b, emb AS y FROM f WHERE face_id % 2 <> 0),
d AS (SELECT g, a, b, list_sum(list_transform(range(1, len(x) + 1), lambda i: pow(CAST(x[i] AS DOUBLE) - CAST(y[i] AS DOUBLE), 2))) AS d FROM a JOIN b USING (g)),
p AS (SELECT *, row_number() OVER (PARTITION BY g, a ORDER BY d, b) AS ra, lead(d) OVER (PARTITION BY g, a ORDER BY d, b) AS na, row_number() OVER (PARTITION BY g, b ORDER BY d, a) AS rb, lead(d) OVER (PARTITION BY g, b ORDER BY d, a) AS nb FROM d)
SELECT g, a, b FROM p WHERE ra = 1 AND rb = 1 AND (na IS NULL OR d < 0.9 * na) AND (nb IS NULL OR d < 0.9 * nb)""")
def features_matched(spark, sf):
    f = faces(spark, sf).select((c("photo_id") % 50).alias("g"), c("face_id").alias("id"), c("emb").cast("array<double>").alias("v"))
    return lens.nearest_mutual(f.where("id % 2 = 0"), f.where("id % 2 <> 0"), ratio=0.9)


@query(f"{P}, f AS (SELECT DISTINCT path FROM p WHERE id % 3 <> 0) SELECT id, path NOT IN (SELECT path FROM f) AS missing FROM p")
def files_missing(spark, sf):
    df = photos(spark, sf)
    return planning.missing(df, df.where("id % 3 <> 0").select("path"))


@query(f"{FC} SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey IN (SELECT person FROM f)")
def people_without_faces_dropped(spark, sf):
    return people.drop_empty(table(spark, sf, "nation").select(c("n_nationkey").alias("id"), c("n_name").alias("name")), faces(spark, sf))


@query("SELECT p_brand AS file, CASE WHEN max(p_size) >= 40 THEN min(p_size) FILTER (p_size >= 40) ELSE max(p_size) END AS edge FROM part GROUP BY 1")
def previews_chosen(spark, sf):
    p = table(spark, sf, "part").select(c("p_brand").alias("file"), c("p_size").alias("edge"), c("p_partkey").alias("idx"))
    return planning.best_preview(p, 40).select("file", "edge")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN concat('Belichtung +', CAST(c_custkey AS STRING)) ELSE concat('Other +', CAST(c_custkey AS STRING)) END AS s FROM customer")
def sliders_translated(spark, sf):
    label = F.concat(F.when(c("c_custkey") % 2 == 0, "Exposure").otherwise("Other"), F.lit(" +"), c("c_custkey").cast("string"))
    return table(spark, sf, "customer").select("c_custkey", session.slider(label, F.create_map(F.lit("Exposure"), F.lit("Belichtung"))).alias("s"))


# Presets ----------------------------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE greatest(2000.0, least(50000.0, p_size * 1100.0)) END AS temp_k,
CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE round(greatest(-100.0, least(100.0, 1e6 / 5500.0::DOUBLE - 1e6 / greatest(p_size * 1100.0, 1000.0)))) END AS temp,
CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS DOUBLE) ELSE -p_size END AS highlights, CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE p_size - 25.0 END AS contrast, CASE WHEN p_partkey % 4 = 0 THEN 3.0 ELSE CAST(p_size AS DOUBLE) END AS clarity,
greatest(0.05, least(0.95, p_size * 2 / 100.0::DOUBLE)) AS split, CAST(p_size * 5 AS DOUBLE) AS hue, CASE WHEN p_partkey % 5 = 0 THEN 0.1 END AS crop_left, CASE WHEN p_partkey % 5 = 0 THEN p_size / 10.0::DOUBLE + 1 ELSE 1.0 END AS angle,
concat('basic_tone,color_grading,crop,', 'presence,tone_curve,', 'white_balance') AS groups FROM part""")
def presets_mapped(spark, sf):
    """Foreign settings by name, older names among them, as settings and the groups they touch."""
    size, at = c("p_size"), c("p_partkey")
    entry = lambda k, v, when=F.lit(True): F.when(when, F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")))
    entries = [entry("WhiteBalance", F.when(at % 3 == 0, "As Shot").otherwise("Custom")), entry("Temperature", size * 1100), entry("Highlights2012", size, at % 2 == 0), entry("HighlightRecovery", size), entry("Contrast", size, at % 2 != 0), entry("Clarity2012", F.lit(3), at % 4 == 0), entry("Clarity", size)]
    entries += [entry("ParametricShadowSplit", size * 2), entry("SplitToningShadowHue", size * 5), entry("HasCrop", F.when(at % 5 == 0, "True").otherwise("False")), entry("CropLeft", F.lit(0.1)), entry("CropTop", F.lit(0.0)), entry("CropRight", F.lit(1.0)), entry("CropBottom", F.lit(1.0)), entry("CropAngle", size / 10), entry("PerspectiveRotate", F.lit(1))]
    df = table(spark, sf, "part").select(at.alias("id"), F.map_from_entries(F.array_compact(F.array(*entries))).alias("m"))
    df = df.select("id", presets.settings(c("m")).alias("s"), "m").withColumn("groups", F.array_join(presets.groups(c("s"), c("m")), ","))
    return df.select("id", "s.temp_k", "s.temp", "s.highlights", "s.contrast", "s.clarity", c("s.curve_split_0").alias("split"), c("s.grade_shadow_hue").alias("hue"), "s.crop_left", "s.angle", "groups")
