"""Strings, names and times as columns."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F


def capture_secs(t: Column) -> Column:
    """Pseudo-seconds of `YYYY-MM-DD HH:MM:SS[.f]` with years of 372 days and months of 31; null if it does not parse."""
    part = lambda i: F.regexp_extract(F.trim(t), r"^(\d+)[-:](\d+)[-:](\d+)[ T](\d+):(\d+)(?::(\d+(?:\.\d+)?))?", i)
    number = lambda i: F.nullif(part(i), F.lit("")).cast("double")
    return (((number(1) * 372 + number(2) * 31 + number(3)) * 24 + number(4)) * 60 + number(5)) * 60 + F.coalesce(number(6), F.lit(0.0))


def unix_to_string(seconds: Column) -> Column:
    """Epoch seconds as `YYYY-MM-DD HH:MM:SS` UTC, whatever the session's zone."""
    return F.date_format(F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)")), "yyyy-MM-dd HH:mm:ss")


def sanitize(s: Column) -> Column:
    """A name without characters that file systems refuse: each becomes `_`; outer space and last dots go."""
    clean = F.regexp_replace(s, r'[<>:"/\\|?*\x00-\x1f\x7f-\x9f]', "_")
    return F.regexp_replace(F.regexp_replace(clean, r"^\s+|\s+$", ""), r"\.+$", "")


def file_parts(path: Column) -> tuple[Column, Column, Column]:
    """Folder, file name, extension in upper case (empty if none)."""
    name = F.substring_index(path, "/", -1)
    folder = F.when(F.contains(path, F.lit("/")), F.substr(path, F.lit(1), F.length(path) - F.length(name) - 1)).otherwise("")
    return folder, name, F.upper(F.regexp_extract(name, r"[^.].*\.([^.]*)$", 1))


def stem_of(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def file_stem(template: str, seq: Column, custom: str = "", rename: bool = True) -> Column:
    """The export name of a row, from `file_name, master, copy_name, capture_time, title, model, rating` and a number."""
    import re

    stem = stem_of(F.col("file_name"))
    original = F.when(F.col("master").isNotNull(), F.concat(stem, F.lit("-"), F.replace(F.col("copy_name"), F.lit(" "), F.lit("")))).otherwise(stem)
    if not rename:
        return sanitize(original)
    time = F.coalesce(F.col("capture_time"), F.lit(""))
    digits = lambda start, n, least: F.when(F.length(time) >= least, F.regexp_replace(F.substring(time, start, n), "[^0-9]", "")).otherwise("")
    number = seq.cast("string")
    out: Column = F.lit(template)
    for m in sorted(set(re.findall(r"\{seq:([^}]*)\}", template))):
        width = int(m) if m.isdigit() else 1
        padded = F.when(F.length(number) < width, F.lpad(number, width, "0")).otherwise(number)
        out = F.replace(out, F.lit("{seq:" + m + "}"), padded)
    tokens = {"{name}": original, "{seq}": number, "{date}": digits(1, 10, 10), "{time}": digits(12, 8, 19), "{year}": F.substring(time, 1, 4), "{title}": F.col("title"), "{custom}": F.lit(custom), "{camera}": F.coalesce(F.col("model"), F.lit("")), "{rating}": F.col("rating").cast("string")}
    for token, value in tokens.items():  # in this order: a token inside an earlier value is expanded too
        out = F.replace(out, F.lit(token), F.coalesce(value, F.lit("")))
    clean = sanitize(out)
    return F.when(clean == "", sanitize(original)).otherwise(clean)


def lens_words(name: Column) -> Column:
    """Distinct sorted tokens of a lens name: letters and numbers apart, units dropped, `2.80` as `2.8`."""
    low = F.replace(F.replace(F.lower(name), F.lit("f/"), F.lit("f ")), F.lit("ƒ"), F.lit("f"))
    found = F.regexp_extract_all(low, F.lit(r"([0-9][0-9.]*|(?:(?![0-9])[\p{L}\p{N}])+)"), 1)
    short = F.transform(found, lambda w: F.when(F.contains(w, F.lit(".")), F.regexp_replace(F.regexp_replace(w, "0+$", ""), r"\.+$", "")).otherwise(w))
    return F.array_sort(F.array_distinct(F.filter(short, lambda w: ~w.isin("mm", "f"))))


def name_focal(name: Column) -> Column:
    """struct(low, high) of the focal range in a lens name, null if it has none."""
    at = lambda i: F.regexp_extract(F.lower(name), r"(?:^|[^a-z0-9]|f)([0-9][0-9.]*)(?:-([0-9][0-9.]*))?\s*mm", i)
    low = F.nullif(at(1), F.lit("")).try_cast("double")
    high = F.coalesce(F.nullif(at(2), F.lit("")).try_cast("double"), low)
    return F.when(low.isNotNull(), F.struct(low.alias("low"), high.alias("high")))


def canon_spaced(name: Column) -> Column:
    """The maker before, and a space after, mount prefixes that stand against the focal length."""
    return F.regexp_replace(F.trim(name), r"^(EF-S|EF-M|RF-S|EF|RF)(?=\d)", "Canon $1 ")


def history_name(s: Column) -> Column:
    """`$$$/a/b=Text` is Text."""
    return F.when(s.startswith("$$$"), F.substring_index(s, "=", -1)).otherwise(s)


def unescape(s: Column) -> Column:
    return functools.reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")], s)


def escape(s: Column) -> Column:
    return functools.reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")], s)


def xmp_title(packet: Column) -> Column:
    """The first list item inside dc:title."""
    return F.nullif(unescape(F.regexp_extract(packet, r"(?s)<dc:title>.*?<rdf:li[^>]*>(.*?)</rdf:li>", 1)), F.lit(""))


def orientation_steps(code: Column) -> Column:
    """Quarter turns of a corner code."""
    return F.when(code == "BC", 1).when(code == "CD", 2).when(code == "DA", 3).otherwise(0)


def exif_steps(orientation: Column) -> Column:
    return F.when(orientation == 6, 1).when(orientation == 3, 2).when(orientation == 8, 3).otherwise(0)


def content_key(data: Column) -> Column:
    """The first 12 bytes of SHA-256 as hex."""
    return F.substring(F.sha2(data, 256), 1, 24)


def rational(v: Column) -> Column:
    """struct(num, den); below one the form 1/x where it is within one percent."""
    d = F.greatest(F.round(1 / v), F.lit(1.0))
    whole = F.struct(F.round(v * 10000).cast("long").alias("num"), F.lit(10000).cast("long").alias("den"))
    part = F.struct(F.lit(1).cast("long").alias("num"), d.cast("long").alias("den"))
    none = F.struct(F.lit(0).cast("long").alias("num"), F.lit(1).cast("long").alias("den"))
    return F.when(v <= 0, none).when((v < 1) & (F.abs(1 / d - v) < v * 0.01), part).otherwise(whole)


def _hundredths(a: Column) -> Column:
    """A non-negative double's hundredths, to the nearest of its exact value, ties to even.

    t, the double nearest to the tie above k, parts all doubles but itself; on which side of the tie t lies is told by 200 t - (2 k + 1),
    with t in two halves whose products are exact.
    """
    k = F.floor(a * 100)
    t = (k + 0.5) / 100
    c = t * 134217729.0
    high = c - (c - t)
    side = (high * 200 - (2 * k + 1)) + (t - high) * 200
    up = (a > t) | ((a == t) & ((side > 0) | ((side == 0) & (k % 2 == 1))))
    return k + up.cast("long")


def _two_decimals(h: Column) -> Column:
    return F.concat(F.floor(h / 100).cast("string"), F.lit("."), F.lpad((h % 100).cast("string"), 2, "0"))


def unsigned_number(v: Column) -> Column:
    """Integer text within 1e-4 of an integer, else two decimals of the exact value."""
    r = F.round(v)
    body = F.concat(F.when(v < 0, "-").otherwise(""), _two_decimals(_hundredths(F.abs(v))))
    return F.when(F.abs(v - r) < 1e-4, r.cast("long").cast("string")).otherwise(body)


def signed_number(v: Column) -> Column:
    """`unsigned_number` with a plus sign before positive values."""
    return F.when(v > 0, F.concat(F.lit("+"), unsigned_number(v))).otherwise(unsigned_number(v))


def human_size(n: Column) -> Column:
    """Bytes, or KB and MB with one decimal and GB with two, of the exact quotient, ties to even."""
    n = n.cast("long")

    def parts(unit: int, scale: int) -> Column:
        q, r = F.call_function("div", n * scale, F.lit(unit)), (n * scale) % unit
        return q + ((r * 2 > unit) | ((r * 2 == unit) & (q % 2 == 1))).cast("long")

    one = lambda unit: (lambda t: F.concat(F.call_function("div", t, F.lit(10)).cast("string"), F.lit("."), (t % 10).cast("string")))(parts(unit, 10))
    kb, mb = F.concat(one(1024), F.lit(" KB")), F.concat(one(1024**2), F.lit(" MB"))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, kb).when(n < 1024**3, mb).otherwise(F.concat(_two_decimals(parts(1024**3, 100)), F.lit(" GB")))


def caption(kind: str) -> Column:
    """A print caption: none, file, title (the file name if empty) or exif, from the photo's columns."""
    title = F.when(F.coalesce(F.col("title"), F.lit("")) != "", F.col("title")).otherwise(F.col("file_name"))
    shutter = F.when(F.col("exposure") < 1, F.concat(F.lit("1/"), F.round(1 / F.col("exposure")).cast("int").cast("string"))).otherwise(F.round("exposure", 1).cast("string"))
    exif = F.concat_ws("  ", F.col("model"), F.concat(F.round("focal", 0).cast("int").cast("string"), F.lit(" mm")), F.concat(F.lit("f/"), F.round("fnumber", 1).cast("string")), F.concat(shutter, F.lit(" s")), F.concat(F.lit("ISO "), F.col("iso").cast("string")))
    return {"none": F.lit(""), "file": F.col("file_name"), "title": title, "exif": exif}[kind]


def expand_tokens(template: str, values: dict[str, Column]) -> Column:
    """A text with `{token}` replaced one after another, empty for missing values."""
    out: Column = F.lit(template)
    for token, value in values.items():
        out = F.replace(out, F.lit("{" + token + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out
