"""Plans of import, relinking, renaming and export; files are rows (path, size), never touched here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fotolake.functions.text import file_parts, file_stem, sanitize
from fotolake.operators.predicates import HEIF_EXTENSIONS, RASTER_EXTENSIONS, RAW_EXTENSIONS


def importable(files: DataFrame) -> DataFrame:
    """Files of known extensions, without names that start with `.` or `$`."""
    _, name, ext = file_parts(F.col("path"))
    return files.where(ext.isin(*RAW_EXTENSIONS, *RASTER_EXTENSIONS, *HEIF_EXTENSIONS) & ~name.rlike(r"^[.$]"))


def new_files(files: DataFrame, photos: DataFrame) -> DataFrame:
    """Importable files whose path, in lower case, no original has."""
    known = photos.where("master is null").select(F.lower("path").alias("__low")).distinct()
    return importable(files).withColumn("__low", F.lower("path")).join(known, "__low", "left_anti").drop("__low")


def missing(photos: DataFrame, files: DataFrame) -> DataFrame:
    """(id, missing) of each photo against a listing."""
    there = files.select("path").distinct().withColumn("there", F.lit(True))
    return photos.select("id", "path").join(there, "path", "left").select("id", F.col("there").isNull().alias("missing"))


def relink(photos: DataFrame, files: DataFrame) -> DataFrame:
    """(id, path, new_path) of missing originals: the file of that name, of equal size first, then the first by path."""
    name = F.substring_index("path", "/", -1)
    found = files.select(F.lower(name).alias("n"), F.col("path").alias("new_path"), F.col("size"))
    lost = photos.where("missing and master is null").select("id", "path", F.lower("file_name").alias("n"), "file_size")
    # One row for each name and size, and one for each name: common names do not multiply.
    exact = found.groupBy("n", "size").agg(F.min("new_path").alias("exact"))
    first = exact.groupBy("n").agg(F.min("exact").alias("first"))
    met = lost.join(first, "n").join(exact.withColumnRenamed("size", "file_size"), ["n", "file_size"], "left")
    return met.select("id", "path", F.when(F.col("file_size") == 0, F.col("first")).otherwise(F.coalesce("exact", "first")).alias("new_path"))


def relocate(photos: DataFrame, files: DataFrame, old: str, new: str) -> DataFrame:
    """(id, new_path) of photos under `old` whose file is under `new`."""
    old, new = old.rstrip("/"), new.rstrip("/")
    moved = photos.where(F.startswith("path", F.lit(old + "/"))).select("id", F.concat(F.lit(new), F.substr("path", F.lit(len(old) + 1))).alias("new_path"))
    return moved.join(files.select(F.col("path").alias("new_path")).distinct(), "new_path", "left_semi").select("id", "new_path")


def rename_plan(selection: DataFrame, files: DataFrame, template: str, custom: str = "", start: int = 1) -> DataFrame:
    """(id, path, new_path, conflict) of a selection with `seq` (0-based order): repeated or taken names conflict."""
    stem = file_stem(template, F.col("seq") + start, custom)
    ext = F.regexp_extract("file_name", r"[^.].*\.([^.]*)$", 1)
    plan = selection.select("id", "path", "seq", F.concat("folder", F.lit("/"), stem, F.lit("."), ext).alias("new_path"))
    again = F.row_number().over(Window.partitionBy(F.lower("new_path")).orderBy("seq")) > 1
    plan = plan.withColumn("again", again)
    leaving = plan.select(F.col("path").alias("new_path")).distinct().withColumn("leaves", F.lit(True))
    taken = files.select(F.col("path").alias("new_path")).distinct().withColumn("taken", F.lit(True))
    plan = plan.join(taken, "new_path", "left").join(leaving, "new_path", "left")
    conflict = F.col("again") | ((F.col("new_path") != F.col("path")) & F.coalesce("taken", F.lit(False)) & F.col("leaves").isNull())
    return plan.select("id", "path", "new_path", conflict.alias("conflict"))


def target_size(w: Column, h: Column, mode: str, a: float, b: float = 0, enlarge: bool = True) -> tuple[Column, Column]:
    """Width and height by long_edge, short_edge, box (a by b), megapixels or percent."""
    w, h = w.cast("double"), h.cast("double")
    k = {"long_edge": a / F.greatest(w, h), "short_edge": a / F.least(w, h), "box": F.least(a / w, b / h), "megapixels": F.sqrt(a * 1e6 / (w * h)), "percent": F.lit(a / 100)}[mode]
    k = k if enlarge else F.least(k, F.lit(1.0))
    side = lambda x: F.greatest(F.round(x * k).cast("long"), F.lit(1).cast("long"))
    return side(w), side(h)


def dest_dir(folder: Column | None = None, fixed: str | None = None, subfolder: str = "") -> Column:
    base = F.lit(fixed) if fixed is not None else (F.col("folder") if folder is None else folder)
    return F.concat(base, F.lit("/"), sanitize(F.lit(subfolder))) if subfolder.strip() else base


def export_paths(items: DataFrame, files: DataFrame, policy: str = "unique") -> DataFrame:
    """(id, out_path) of items (id, dir, stem, ext, seq) against files (path): unique, overwrite or skip.

    Unique: the n-th free name in the order of `seq`, counting from the plain name, then `-2`, `-3`. Items and taken numbers of a
    name are ranked by one window; numbered names that items of the
    job take plainly count as taken too.
    """
    first = F.concat("dir", F.lit("/"), "stem", F.lit("."), "ext")
    items = items.withColumn("first", first)
    order = Window.partitionBy("first").orderBy("seq", "id")
    taken = files.select(F.col("path").alias("first")).distinct()
    if policy == "overwrite":
        return items.select("id", F.col("first").alias("out_path"))
    if policy == "skip":
        return items.withColumn("rn", F.row_number().over(order)).where("rn = 1").join(taken, "first", "left_anti").select("id", F.col("first").alias("out_path"))
    # Numbers 1, 2, ... of a name: those on disk or reserved plainly by the job are out; the n-th item gets the n-th left.
    plain = items.select(F.col("first").alias("path")).unionByName(files.select("path")).distinct()
    split = plain.select("path", F.regexp_extract("path", r"^(.*)-(\d+)\.([^./]*)$", 1).alias("a"), F.regexp_extract("path", r"^(.*)-(\d+)\.([^./]*)$", 2).alias("n"), F.regexp_extract("path", r"^(.*)-(\d+)\.([^./]*)$", 3).alias("e")).where("n <> '' and not startswith(n, '0') and length(n) < 10 and n <> '1'")
    numbered = split.select(F.concat("a", F.lit("."), "e").alias("first"), F.col("n").cast("int").alias("n"))
    used = numbered.unionByName(taken.select("first", F.lit(1).alias("n"))).distinct()
    # The i-th used number u stands before the items from the (u - i + 1)-th on, each of which it shifts by one.
    at = Window.partitionBy("first").orderBy("n")
    shifts = used.select("first", (F.col("n") - F.row_number().over(at) + 1).alias("rn"), F.lit(1).alias("used"))
    ranked = items.withColumns({"rn": F.row_number().over(order), "used": F.lit(0)})
    both = ranked.unionByName(shifts, allowMissingColumns=True)
    free = F.col("rn") + F.sum("used").over(Window.partitionBy("first").orderBy("rn", F.desc("used"), "seq", "id").rowsBetween(Window.unboundedPreceding, 0))
    placed = both.withColumn("free", free).where("used = 0")
    suffix = F.when(F.col("free") > 1, F.concat(F.lit("-"), F.col("free").cast("string"))).otherwise("")
    return placed.select("id", F.concat("dir", F.lit("/"), "stem", suffix, F.lit("."), "ext").alias("out_path"))


def pages(items: DataFrame, rows: int, columns: int) -> DataFrame:
    """`items` (with 0-based seq) with page, row and column of a print grid."""
    per = rows * columns
    at = F.col("seq") % per
    return items.withColumns({"page": F.floor(F.col("seq") / per), "row": F.floor(at / columns), "column": at % columns})


def cells_mm(page_w: float, page_h: float, margin: float, gap: float, rows: int, columns: int) -> list[tuple[float, float, float, float]]:
    w, h = (page_w - 2 * margin - gap * (columns - 1)) / columns, (page_h - 2 * margin - gap * (rows - 1)) / rows
    return [(margin + c * (w + gap), margin + r * (h + gap), w, h) for r in range(rows) for c in range(columns)]


def best_preview(previews: DataFrame, want: int) -> DataFrame:
    """For each file the smallest preview at least `want` wide, else the widest (file, edge, idx)."""
    enough = (F.col("edge") >= want).cast("int")
    key = F.struct((1 - enough).alias("a"), F.when(F.col("edge") >= want, F.col("edge")).otherwise(-F.col("edge")).alias("b"), "idx")
    return previews.groupBy("file").agg(F.min_by(F.struct("edge", "idx"), key).alias("x")).select("file", "x.edge", "x.idx")
