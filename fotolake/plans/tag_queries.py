"""Queries of embedded corrections: files of tags whose bytes Spark makes from the star schema, walked and decoded, with SQL on the columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fotolake.functions.vector import held
from fotolake.operators import embedded
from fotolake.plans.queries import query
from fotolake.plans.shapes import spread, table
from fotolake.sources import tags

SIZES = {1: 1, 3: 2, 4: 4, 7: 1, 8: 2, 10: 8}


def _hex(value: Column, n: int) -> Column:
    return F.lpad(F.hex(F.pmod(value.cast("bigint"), F.lit(1 << (8 * n)))), 2 * n, "0")


def _directory(entries: list[tuple[int, int, list[Column]]], at: int) -> tuple[Column, int]:
    """A big-endian directory that starts at `at`, in hexadecimal, and where it ends. entries: tag, type, values."""
    place, heads, data = at + 2 + 12 * len(entries) + 4, [F.lpad(F.hex(F.lit(len(entries))), 4, "0")], []
    for tag, kind, values in entries:
        size = SIZES[kind] * len(values)
        body = F.concat(*(_hex(v, SIZES[kind]) for v in values))
        heads.append(F.lit(f"{tag:04X}{kind:04X}{len(values):08X}"))
        if size <= 4:
            heads.append(F.rpad(body, 8, "0"))
        else:
            heads.append(F.lit(f"{place:08X}"))
            data.append(body)
            place += size
    return F.concat(*heads, F.lit("00000000"), *data), place


def _file(root: list[tuple[int, int, list[Column]]], pointer: int | None = None, sub: list[tuple[int, int, list[Column]]] | None = None, at: int = 0) -> Column:
    """The bytes of a file with a first directory and, under `pointer`, one more."""
    head = F.lit("4D4D002A00000008")
    if pointer is None:
        return F.unhex(F.concat(head, _directory(root, 8)[0]))
    end = _directory([*root, (pointer, 4, [F.lit(0)])], 8)[1]
    first = _directory([*root, (pointer, 4, [F.lit(end)])], 8)[0]
    return F.unhex(F.concat(head, first, _directory(sub, end)[0]))


def _files_of(spark, sf):
    return spread(table(spark, sf, "customer").select(F.col("c_custkey").alias("photo"), (F.col("c_custkey") * 7 + F.col("c_nationkey") * 31).cast("long").alias("c")), "photo")


KNOTS = 11


def _sony(spark, sf):
    """11 knots of distortion and colour, 7 of vignetting; every fifth file has a colour table of another size."""
    c = F.col("c")
    value = lambda i: (c * (i + 1)) % 2001 - 1000
    ca = [F.when(c % 5 == 0, 20).otherwise(22), *(value(i) * 3 for i in range(2 * KNOTS))]
    sub = [(0x7032, 8, [F.lit(7), *((c * (i + 2)) % 3000 for i in range(7))]), (0x7035, 8, ca), (0x7037, 8, [F.lit(KNOTS), *map(value, range(KNOTS))])]
    return _files_of(spark, sf).select("photo", F.lit("arw").alias("ext"), _file([], 0x14A, sub).alias("content"))


O = "o AS (SELECT c_custkey AS photo, CAST(c_custkey * 7 + c_nationkey * 31 AS BIGINT) AS c FROM customer)"


@query(f"""WITH {O}, n AS (SELECT unnest(range(22)) AS i) SELECT photo, i, tag, value FROM (
SELECT photo, i, 28727 AS tag, CAST(CASE i WHEN 0 THEN 11 ELSE (c * i) % 2001 - 1000 END AS DOUBLE) AS value FROM o, n WHERE i < 12
UNION ALL SELECT photo, i, 28725, CAST(CASE i WHEN 0 THEN CASE WHEN c % 5 = 0 THEN 20 ELSE 22 END ELSE 3 * ((c * i) % 2001 - 1000) END AS DOUBLE) FROM o, (SELECT unnest(range(23)) AS i)
UNION ALL SELECT photo, i, 28722, CAST(CASE i WHEN 0 THEN 7 ELSE (c * (i + 1)) % 3000 END AS DOUBLE) FROM o, n WHERE i < 8)""")
def tags_walked(spark, sf):
    """Each value of each tag, by a walk through the directories of a file's bytes."""
    return tags.tag_rows(_sony(spark, sf)).select("photo", "tag", F.posexplode("values").alias("i", "value"))


@query(f"""WITH {O}, n AS (SELECT unnest(range(11)) AS i), v AS (SELECT *, 1 + ((c * (i + 1)) % 2001 - 1000) / pow(2, 14) AS g FROM o, n)
SELECT photo, CAST(i AS INTEGER) AS i, round((i + 0.5) / 10, 9) AS kd, round(g, 9) AS g, round(g * (1 + CASE WHEN c % 5 = 0 THEN 0 ELSE 3 * ((c * (i + 1)) % 2001 - 1000) END / pow(2, 21)), 9) AS r,
round(g * (1 + CASE WHEN c % 5 = 0 THEN 0 ELSE 3 * ((c * (i + 12)) % 2001 - 1000) END / pow(2, 21)), 9) AS b, round(CASE WHEN i < 7 THEN pow(2, 0.5 - pow(2, ((c * (i + 2)) % 3000) / pow(2, 13) - 1)) END, 9) AS vig FROM v""")
def corrections_of_tables(spark, sf):
    """Tables of knots: ratios of the three colours and of the brightness."""
    found = embedded.corrections(tags.tag_rows(_sony(spark, sf)))
    rows = found.select("photo", F.posexplode("kd").alias("i", "kd"), "g", "r", "b", "vig")
    return rows.select("photo", "i", F.round("kd", 9).alias("kd"), *(F.round(F.get(x, F.col("i")), 9).alias(x) for x in ("g", "r", "b", "vig")))


@query(f"""WITH {O}, n AS (SELECT unnest(range(1, 33)) AS i), p AS (SELECT photo, (c % 4000) / 32768 AS a, (c % 3001 - 1500) / 32768 AS b, (c % 501) / 32768 AS d, 1 / (1 + (c % 2000) / 32768) AS s FROM o),
x AS (SELECT *, 1.1 * i / 32 AS r FROM p, n)
SELECT photo, CAST(i AS INTEGER) AS i, round(list_reduce(list_prepend(r, CAST(range(6) AS DOUBLE[])), lambda q, _: r / (1 + s * (a * q * q + b * q * q * q * q + d * q * q * q * q * q * q))) / r, 9) AS g FROM x""")
def corrections_inverted(spark, sf):
    """A polynomial from source to output radius, inverted by fixed-point steps inside a fold."""
    c = F.col("c")
    zero = F.lit(0)
    v = [zero, zero, zero, zero, c % 3001 - 1500, c % 2000, zero, F.lit(1), c % 4000, zero, zero, c % 501, zero, zero, zero, zero]
    bytes_ = [x for y in v for x in (F.floor(F.pmod(y, F.lit(65536)) / 256), F.pmod(y, F.lit(256)))]
    files = _files_of(spark, sf).select("photo", F.lit("rw2").alias("ext"), _file([(0x0119, 7, bytes_)]).alias("content"))
    found = embedded.corrections(tags.tag_rows(files))
    return found.select("photo", F.posexplode("g").alias("i", "g")).where("i > 0").select("photo", "i", F.round("g", 9).alias("g"))


@query(f"""WITH {O}, k AS (SELECT photo, c, list_prepend(0.0, list_transform(range(9), lambda i: (10 + 10 * i) / 100.0)) AS k, list_prepend(1.0, list_transform(range(9), lambda i: 1 + ((c * (i + 1)) % 41 - 20) / 100.0 / 100)) AS m,
list_prepend(0.0, list_transform(range(9), lambda i: ((c * (i + 3)) % 21 - 10) / 10000.0)) AS cr FROM o),
x AS (SELECT *, i, i / 47.0 AS rin, CAST(least(floor(i / 47.0 * 10 + 1e-12), 8) AS INTEGER) AS j FROM k, (SELECT unnest(range(48)) AS i)),
y AS (SELECT *, CASE WHEN rin >= k[10] THEN m[10] ELSE m[j + 1] + (rin - k[j + 1]) * (m[j + 2] - m[j + 1]) / (k[j + 2] - k[j + 1]) END AS g, CASE WHEN rin >= k[10] THEN cr[10] ELSE cr[j + 1] + (rin - k[j + 1]) * (cr[j + 2] - cr[j + 1]) / (k[j + 2] - k[j + 1]) END AS o FROM x)
SELECT photo, CAST(i AS INTEGER) AS i, round(rin / g, 9) AS kd, round(g, 9) AS g, round(g * (1 + o), 9) AS r FROM y""")
def corrections_resampled(spark, sf):
    """Tables over source radii, resampled at 48 knots over output radii."""
    c = F.col("c")
    head = lambda values: [(F.lit(n), F.lit(100)) for n in [0, *(10 + 10 * i for i in range(9))]] + values
    m = [((c * (i + 1)) % 41 - 20, F.lit(100)) for i in range(9)]
    ca = [((c * (i + 3)) % 21 - 10, F.lit(10000)) for i in range(9)]
    full = [(F.lit(100), F.lit(1))] * 9
    pairs = lambda values: [x for q in values for x in q]
    rationals = [(0xF00B, head(m)), (0xF00F, head(ca + ca) + [(F.lit(0), F.lit(1))]), (0xF010, head(full))]
    first = 112  # a header, the place of the directories at its hundredth byte, and those from here on
    sub_at = 8 + 2 + 12 + 4
    root, _ = _directory([(0xF000, 4, [F.lit(sub_at)])], 8)
    place, heads, data = sub_at + 2 + 12 * 3 + 4, [F.lit("0003")], []
    for tag, values in rationals:
        heads.append(F.lit(f"{tag:04X}{10:04X}{len(values):08X}{place:08X}"))
        data.append(F.concat(*(_hex(x, 4) for x in pairs(values))))
        place += 8 * len(values)
    content = F.unhex(F.concat(F.lit("46554A49" + "00" * 96 + f"{first:08X}" + "00" * 8 + "4D4D002A00000008"), root, *heads, F.lit("00000000"), *data))
    files = _files_of(spark, sf).select("photo", F.lit("raf").alias("ext"), content.alias("content"))
    found = embedded.fuji(tags.tag_rows(files))
    rows = found.select("photo", F.posexplode("kd").alias("i", "kd"), "g", "r")
    return rows.select("photo", "i", F.round("kd", 9).alias("kd"), *(F.round(F.get(x, F.col("i")), 9).alias(x) for x in ("g", "r")))


@query(f"""WITH {O} SELECT photo, CAST(CASE c % 3 WHEN 0 THEN 3000 + c % 50 WHEN 1 THEN 4000 + c % 7 - c % 5 ELSE 16 END AS DOUBLE) AS width, CAST(CASE c % 3 WHEN 0 THEN 2000 + c % 60 WHEN 1 THEN 3000 ELSE 9 END AS DOUBLE) AS height FROM o WHERE c % 3 < 2 OR c % 2 = 1""")
def aspects_of_cameras(spark, sf):
    """The aspect a camera was set to, as three makers write it; an id of zero is the usual one."""
    c = F.col("c")
    sony = _file([], 0x14A, [(0x74C8, 3, [3000 + c % 50, 2000 + c % 60])])
    pana = _file([(0x2F, 3, [F.lit(10)]), (0x30, 3, [c % 5]), (0x31, 3, [F.lit(3010)]), (0x32, 3, [4000 + c % 7])])
    exif_at = 8 + 2 + 12 + 4
    note_at = exif_at + 2 + 12 + 4
    exif = F.concat(F.lit(f"0001927C0007{64:08X}{note_at:08X}00000000"))
    canon = F.unhex(F.concat(F.lit(f"4D4D002A00000008000187690004{1:08X}{exif_at:08X}00000000"), exif, _directory([(0x9A, 4, [c % 2, F.lit(16), F.lit(9)])], note_at)[0]))
    files = _files_of(spark, sf).select("photo", F.when(c % 3 == 0, "arw").when(c % 3 == 1, "rw2").otherwise("cr2").alias("ext"), F.when(c % 3 == 0, sony).when(c % 3 == 1, pana).otherwise(canon).alias("content"))
    return embedded.aspects(tags.tag_rows(files))


@query("""WITH p AS (SELECT p_partkey AS id, p_size / 1000.0 AS k, (p_partkey % 97 + 1) / 90.0 AS rg, (p_partkey % 3) / 2.0 AS amount FROM part),
s AS (SELECT *, list_reduce(list_prepend(rg, CAST(range(8) AS DOUBLE[])), lambda x, _: rg / greatest(1 + (1 + k * least(x, 1.0) - 1) * amount, 0.1)) AS ro FROM p), t AS (SELECT *, least(ro, 1.0) AS x, 1 + k * least(ro, 1.0) * amount AS g FROM s)
SELECT id, round((g + k * x * 0.5) / g, 9) AS red, round((g - k * x * 0.25) / g, 9) AS blue FROM t""")
def side_colours_read(spark, sf):
    """Where red and blue are read, by fixed-point steps from green's place."""
    k = F.col("p_size") / 1000.0
    lines = lambda slope: F.array(F.lit(1.0), 1 + k * slope)
    knots = F.array(F.lit(0.0), F.lit(1.0))
    rg, amount = (F.col("p_partkey") % 97 + 1) / 90.0, (F.col("p_partkey") % 3) / 2.0
    s = embedded.side_ratios(rg, knots, lines(1.5), lines(1.0), lines(0.75), amount)
    rows = spread(table(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey").select(F.col("p_partkey").alias("id"), s.alias("s"))
    s = F.col("s")
    return held(rows).select("id", F.round(s["red"], 9).alias("red"), F.round(s["blue"], 9).alias("blue"))


@query("""SELECT p_partkey AS id, round(CASE WHEN p_partkey % 3 < 2 AND p_size * 40 <= 1000 AND p_partkey % 16000 + 3000 >= 4000 THEN log2((p_partkey % 16000 + 3000 - p_size * 40) / (p_partkey % 16000 + 3000 - 2048.0)) ELSE 0 END, 9) AS ev FROM part""")
def black_levels_evened(spark, sf):
    camera = F.when(F.col("p_partkey") % 3 == 0, "Body A").when(F.col("p_partkey") % 3 == 1, "BODY B").otherwise("Body C")
    ev = embedded.black_offset(camera, (F.col("p_partkey") % 16000 + 3000).cast("double"), F.col("p_size") * 40, ["Body A", "Body B"])
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.round(ev, 9).alias("ev"))
