"""Folders as tables: photo files with what their heads say, and preset files with a status row each.

Listings never read contents: folders are walked for paths, lengths and times only. Where contents are read, their first bytes go
to Python in Arrow batches, and a file that cannot be read is a row with an error, not the end of a job. Files of no bytes are not listed.
"""

from __future__ import annotations

import functools
import os
import struct
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from fotolake.functions.text import unescape
from fotolake.functions.vector import held
from fotolake.operators.predicates import kind_of
from fotolake.sources import presets, xmp
from fotolake.sources.images import read_exif
from fotolake.sources.lua import to_json

#: Bytes of a file's head that hold its metadata.
HEAD = 1 << 20


#: Rows, and bytes of contents, after which a batch is passed on.
SHARE, BYTES = 4096, 16 << 20
_LISTED = "path string, length long, modificationTime timestamp"


def _entries(store, folder: str) -> Iterator[tuple[str, bool, int, int]]:
    """(path, whether a folder, bytes, time in milliseconds) of a folder's entries, one after the other where the store can."""
    from pyarrow import fs

    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(folder) as entries:
            for e in entries:
                at = e.stat()
                yield e.path, e.is_dir(), at.st_size, at.st_mtime_ns // 1_000_000
    else:
        for e in store.get_file_info(fs.FileSelector(folder)):
            yield e.path, e.type == fs.FileType.Directory, e.size or 0, (e.mtime_ns or 0) // 1_000_000


def _listing(batches: Iterable[pa.RecordBatch], recursive: bool) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        path, size, time = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(path), pa.array(size, pa.int64()), pa.array([t * 1000 for t in time], pa.timestamp("us", "UTC"))], ["path", "length", "modificationTime"])

    for roots in batches:
        for root in roots.column("root").to_pylist():
            store, base = fs.FileSystem.from_uri(root)
            head = "file:" if isinstance(store, fs.LocalFileSystem) else root[: root.index("://") + 3]
            folders, rows = [base.rstrip("/")], []
            while folders:
                for path, folder, size, time in _entries(store, folders.pop()):
                    if path.rpartition("/")[2].startswith((".", "_")):
                        continue
                    if folder:
                        folders += [path] * recursive
                    elif size:
                        rows.append((head + path, size, time))
                    if len(rows) >= SHARE:
                        yield batch(rows)
                        rows = []
            if rows:
                yield batch(rows)


def walked(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(path, length, modificationTime) of the files below a folder.

    A task walks the folders, one after the other; nothing goes through the driver, and files are shared out by number. Spark's own source
    lists on the driver and takes a file for at least 4 MB, so that thirty small files make a task. Like there, names that start
    with `.` or `_` are skipped.
    """
    return spark.createDataFrame([(root,)], "root string").coalesce(1).mapInArrow(functools.partial(_listing, recursive=recursive), _LISTED)


def listed(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """`walked` in order of paths and over all tasks."""
    found = walked(spark, root, recursive)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return found.repartitionByRange(tasks, "path").sortWithinPartitions("path")


def _read(batches: Iterable[pa.RecordBatch], most: int | None) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    store = None
    for batch in batches:
        rows, size = [], 0
        for path in batch.column("path").to_pylist():
            if store is None:
                store = fs.LocalFileSystem() if path.startswith("file:") else fs.FileSystem.from_uri(path)[0]
            with store.open_input_stream(path.partition(":")[2] if path.startswith("file:") else path.partition("://")[2], compression=None) as f:
                rows.append((path, f.read(most)))
            size += len(rows[-1][1])
            if size >= BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.binary()), strict=True)], ["path", "content"])
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.binary()), strict=True)], ["path", "content"])


def contents(files: DataFrame, most: int | None = None) -> DataFrame:
    """(path, content) of files (path), in their order; at most the first `most` bytes."""
    return files.select("path").mapInArrow(functools.partial(_read, most=most), "path string, content binary")


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(_name(path), r"[^.]\.([^.]*)$", 1))


def scan(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(path, name, ext, kind, bytes, modified) of the supported files below a folder, in order of paths, without their contents.

    Names that start with `.` or `$`, of files or folders below the root, are skipped.
    """
    found = listed(spark, root, recursive)
    base = F.regexp_replace(F.lit(root), r"^[a-z]+:/+|/+$|^/+", "")
    below = F.split(F.call_function("substring_index", F.col("path"), F.concat(base, F.lit("/")), F.lit(-1)), "/")
    hidden = F.exists(below, lambda x: x.startswith(".") | x.startswith("$"))
    rows = found.where(~hidden).select("path", _name(F.col("path")).alias("name"), _extension(F.col("path")).alias("ext"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    rows = rows.withColumn("kind", kind_of(F.col("ext"))).where("kind is not null")
    return rows.select("path", "name", "ext", "kind", "bytes", "modified")


def _exif_block(data: bytes) -> bytes | None:
    """The TIFF structure of a file: all of it, or what a JPEG's segment holds."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    at = data.find(b"Exif\0\0") if data[:2] == b"\xff\xd8" else -1
    return data[at + 6 :] if at >= 0 else None


_META = "taken string, orientation int, make string, model string, iso int, focal double, fnumber double, exposure double, error string"


def _meta(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["path", "taken", "orientation", "make", "model", "iso", "focal", "fnumber", "exposure", "error"]
    types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.string()]
    number = lambda v: None if v is None else float(v[0] / v[1] if v[1] else 0.0) if isinstance(v, tuple) else float(v)
    whole = lambda v: None if v is None else int(v[0] if isinstance(v, list) else v)
    for batch in batches:
        rows = []
        for path, head in zip(*batch.columns, strict=True):
            found, error = {}, None
            try:
                block = _exif_block(head.as_py() or b"")
                found = read_exif(block) if block else {}
                error = None if block else "no metadata"
            except (struct.error, IndexError, ValueError, KeyError) as e:
                error = f"{type(e).__name__}: {e}"[:200]
            first, exif = found.get(0, {}), found.get(0x8769, {})
            rows.append((path.as_py(), exif.get(0x9003) or first.get(0x132), whole(first.get(0x112)), first.get(0x10F), first.get(0x110), whole(exif.get(0x8827)), number(exif.get(0x920A)), number(exif.get(0x829D)), number(exif.get(0x829A)), error))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names)


def metadata(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """`scan` with metadata: capture_time is what the head says, else the file's time in UTC; orientation 1 if none is said."""
    files = scan(spark, root, recursive)
    heads = contents(files, HEAD).mapInArrow(_meta, "path string, " + _META)
    taken = F.regexp_replace(F.regexp_replace("taken", r"^(\d{4}):(\d\d):(\d\d)", "$1-$2-$3"), r"\.\d+$", "")
    taken = F.when(taken.rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$"), taken)
    out = files.join(heads, "path").withColumn("from_file", taken.isNull())
    return out.withColumn("capture_time", F.coalesce(taken, F.date_format("modified", "yyyy-MM-dd HH:mm:ss"))).withColumn("orientation", F.coalesce("orientation", F.lit(1))).drop("taken").orderBy("path")


def texts(spark: SparkSession, root: str, extensions: list[str]) -> DataFrame:
    """(path, folder, stem, ext, text) of the files below a folder that have one of the extensions, in either case; UTF-8, or UTF-16 with its mark."""
    ends = F.lower(F.element_at(F.split(_name(F.col("path")), r"\."), -1)).isin(extensions) & F.contains(_name(F.col("path")), F.lit("."))
    files = held(contents(listed(spark, root).where(ends)))
    wide = F.hex(F.substring("content", 1, 2)) == "FFFE"
    plain = F.make_valid_utf8(F.col("content").cast("string"))
    text = F.when(wide, F.decode(F.when(wide, F.expr("substring(content, 3, 2 * ((length(content) - 2) div 2))")), "UTF-16LE")).otherwise(F.regexp_replace(plain, "^\ufeff", ""))
    parts = F.split("path", "/")
    return files.select("path", F.element_at(parts, -2).alias("folder"), F.regexp_replace(_name(F.col("path")), r"\.[^.]*$", "").alias("stem"), _extension(F.col("path")).alias("ext"), text.alias("text"))


@pandas_udf(StringType())
def lua_json(sources: pd.Series) -> pd.Series:
    """JSON texts of Lua tables, in Arrow batches; null for what does not parse."""
    return sources.map(lambda s: to_json(s if isinstance(s, str) else None))


def template_map(json: Column) -> Column:
    """Names and texts of a template's settings (JSON of its Lua table), curves as `x,y;x,y`, the look by name and amount."""
    m = F.from_json(F.get_json_object(json, "$.value.settings"), "map<string,string>")
    pairs = lambda v: F.array_join(F.transform(F.from_json(v, "array<double>"), lambda x, i: F.concat(x.cast("string"), F.when(i % 2 == 0, ",").otherwise(";"))), "")
    table = F.map_filter(m, lambda k, v: k.startswith("ToneCurvePV2012") | ~v.rlike(r"^[\[{]"))
    table = F.transform_values(table, lambda k, v: F.when(k.startswith("ToneCurvePV2012"), F.regexp_replace(pairs(v), "[;,]$", "")).otherwise(v))
    look = lambda part: F.get_json_object(json, f"$.value.settings.Look.{part}")
    more = F.map_filter(F.map_from_arrays(F.array(F.lit("LookName"), F.lit("LookAmount")), F.array(F.nullif(look("Name"), F.lit("")), look("Amount"))), lambda k, v: v.isNotNull())
    return F.when(m.isNotNull(), F.map_concat(F.map_filter(table, lambda k, v: ~k.isin("LookName", "LookAmount")), more))


def _look(text: Column) -> tuple[Column, Column, Column]:
    """(the packet without its look, the look's name, the amount in its head)."""
    block = F.regexp_extract(text, r"(?s)<crs:Look.*?(?:</crs:Look>|\z)", 0)
    head = F.substring_index(block, "<crs:Parameters", 1)
    part = lambda where, name: F.nullif(unescape(F.regexp_extract(where, rf'crs:{name}="([^"]*)"', 1)), F.lit(""))
    return F.regexp_replace(text, r"(?s)<crs:Look>.*?</crs:Look>", ""), part(block, "Name"), part(head, "Amount")


def _item(text: Column, name: str) -> Column:
    """The first list entry of an element that is not empty."""
    body = F.regexp_extract(text, rf"(?s)<crs:{name}>(.*?)</crs:{name}>", 1)
    return F.nullif(unescape(F.trim(F.regexp_extract(body, r"(?s)<rdf:li[^>]*[^/>]>\s*([^<\s][^<]*)</rdf:li>", 1))), F.lit(""))


def preset_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, grp, name, status, error, settings, groups, curves) of each preset file: packets and templates by their extension.

    status is `ok` or `failed`: no XML or Lua, a template of another kind or without settings, a packet that says it has none, or settings of no group.
    """
    df = texts(spark, root, ["xmp", "lrtemplate"])
    bare, look, amount = _look(F.col("text"))
    packets = df.where("ext = 'xmp'").withColumn("m", xmp.crs_map(bare))
    more = F.map_filter(F.map_from_arrays(F.array(F.lit("LookName"), F.lit("LookAmount")), F.array(look, amount)), lambda k, v: v.isNotNull())
    none = F.coalesce(F.lower(F.try_element_at("m", F.lit("HasSettings"))) == "false", F.lit(False))
    packets = packets.select("path", F.coalesce(_item(F.col("text"), "Group"), "folder").alias("grp"), F.coalesce(_item(F.col("text"), "Name"), "stem").alias("name"), F.when(F.col("m").isNull(), "no XML").when(none, "a preset without settings").alias("error"), F.map_concat("m", more).alias("m"))
    json = F.col("json")
    kind, title = F.get_json_object(json, "$.type"), F.nullif(F.get_json_object(json, "$.title"), F.lit(""))
    templates = df.where("ext = 'lrtemplate'").withColumn("json", lua_json("text"))
    error = F.when(json.isNull(), "no Lua table").when(kind.isNotNull() & (kind != "") & (kind != "Develop"), F.concat(F.lit("not a develop preset: "), kind)).when(template_map(json).isNull(), "no settings")
    templates = templates.select("path", F.col("folder").alias("grp"), F.when(title.startswith("$$$") | title.isNull(), F.col("stem")).otherwise(title).alias("name"), error.alias("error"), template_map(json).alias("m"))
    both = packets.unionByName(templates).withColumn("settings", presets.settings(F.col("m")))
    both = both.withColumn("groups", F.when(F.col("error").isNull(), presets.groups(F.col("settings"), F.col("m"))))
    error = F.coalesce("error", F.when(F.size("groups") == 0, "no develop settings"))
    curves = F.array(*(presets.curve(F.try_element_at("m", F.lit(c))) for c in xmp.CURVES))
    return both.select("path", "grp", "name", F.when(error.isNull(), "ok").otherwise("failed").alias("status"), error.alias("error"), F.when(error.isNull(), F.col("settings")).alias("settings"), "groups", F.when(error.isNull(), curves).alias("curves"))


#: Anchors of a watermark in the order of their numbers, and its other choices.
ANCHORS = ["topleft", "top", "topright", "left", "center", "right", "bottomleft", "bottom", "bottomright"]


def watermark_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, name, status, error, kind, text, image, opacity, colour, font, align, shadow..., size_mode, size, inset_h, inset_v, anchor)."""
    df = texts(spark, root, ["lrtemplate"]).withColumn("json", lua_json("text"))
    get = lambda p: F.get_json_object("json", f"$.{p}")
    item = lambda k: get(f"value.items[0].{k}")
    number = lambda k: item(k).try_cast("double")
    within = lambda v, low, high: F.when(v.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), v)))
    error = F.when(F.col("json").isNull(), "no Lua table").when(F.coalesce(get("type"), F.lit("")) != "WatermarkingPreset", "not a watermark preset").when(get("value.items[0]").isNull(), "no items")
    colour = F.array(*(F.least(F.lit(255), F.greatest(F.lit(0), F.floor(number(f"textColor{c}") * 255))).cast("int") for c in ("Red", "Green", "Blue")))
    angle = number("textShadowAngle")
    choice = lambda k, known, default: F.when(item(k).isin(known), item(k)).otherwise(default)
    anchor = functools.reduce(lambda c, e: F.when(F.lower(item("anchor")) == e[1], e[0]).otherwise(c), enumerate(ANCHORS), F.lit(None).cast("int"))
    columns = {
        "name": F.coalesce(get("title"), F.col("stem")), "kind": F.when(item("kind") == "image", "graphic").otherwise("text"), "text_shown": item("text"), "image": item("imagePath"),
        "opacity": within(number("opacity") * 100, 0.0, 100.0), "colour": F.when(~F.exists(colour, lambda x: x.isNull()), colour), "font": F.lower(F.split_part(item("textFontName"), F.lit("-"), F.lit(1))),
        "align": choice("textHorizontalAlignment", ["left", "right"], "center"), "shadow": item("textShadowEnabled").try_cast("boolean"), "shadow_opacity": number("textShadowOpacity") * 100, "shadow_offset": number("textShadowOffset") * 100,
        "shadow_radius": number("textShadowRadius") * 100, "shadow_angle": angle - 360 * F.greatest(F.ceil((angle - 180) / 360), F.lit(0)), "size_mode": choice("sizeKind", ["fit", "fill"], "proportional"),
        "size": within(number("sizeRelativeAmount") * 100, 1.0, 100.0), "inset_h": within(number("horizontalPadding") * 200, 0.0, 100.0), "inset_v": within(number("verticalPadding") * 200, 0.0, 100.0), "anchor": anchor,
    }
    return df.select("path", F.when(error.isNull(), "ok").otherwise("failed").alias("status"), error.alias("error"), *(F.when(error.isNull(), v).alias(k) for k, v in columns.items()))
