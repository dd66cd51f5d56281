"""Sources, filters and smart rules, compiled to columns that Catalyst can push down.

A missing value makes a rule false, not null. Time is a parameter (`now`, epoch seconds), never read from the clock.
"""

from __future__ import annotations

import datetime as dt
import functools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Extensions of the kinds; the last raw one is that of merged exposures.
RAW_EXTENSIONS = ("3FR", "ARW", "CR2", "CR3", "CRW", "DCR", "DNG", "ERF", "IIQ", "KDC", "MOS", "MRW", "NEF", "NRW", "ORF", "PEF", "RAF", "RW2", "SR2", "SRF", "SRW", "DRHDR")
RASTER_EXTENSIONS = ("JPG", "JPEG", "PNG", "TIF", "TIFF")
HEIF_EXTENSIONS = ("HEIC", "HEIF", "HIF")


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _low(c: Column | str) -> Column:
    return F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))


def kind_of(ext: Column) -> Column:
    """raw, raster or heif by extension, in either case; null for others."""
    e = F.upper(ext)
    return F.when(e.isin(*RAW_EXTENSIONS), "raw").when(e.isin(*RASTER_EXTENSIONS), "raster").when(e.isin(*HEIF_EXTENSIONS), "heif")


def text_match(query: str) -> Column:
    """Every word of the query occurs in file name, title, caption, keywords, make, model or lens."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("file_name", "title", "caption")] + [F.array_join("keywords", " ")] + [F.coalesce(F.col(c), F.lit("")) for c in ("make", "model", "lens")]
    hay = F.lower(F.concat_ws(" ", *parts))
    return functools.reduce(lambda a, b: a & b, (F.contains(hay, F.lit(w)) for w in query.lower().split()), F.lit(True))


def days_ago(days: int, now: int) -> str:
    """Midnight UTC so many days before `now`, as text."""
    return (dt.datetime.fromtimestamp(now, dt.UTC) - dt.timedelta(days=days)).strftime("%Y-%m-%d 00:00:00")


@dataclass(frozen=True)
class Rule:
    """One smart rule: its kind and argument."""

    kind: str
    value: object = None

    def column(self, now: int = 0) -> Column:
        v, c = self.value, F.col
        number = lambda name, least: _sure(c(name) >= F.lit(v) if least else c(name) <= F.lit(v))
        match self.kind:
            case "rating_at_least" | "iso_at_least" | "focal_at_least":
                return number(self.kind.split("_")[0], True)
            case "rating_at_most" | "iso_at_most" | "focal_at_most":
                return number(self.kind.split("_")[0], False)
            case "flag_is":
                return _sure(c("flag") == v)
            case "label_is":
                return _sure(c("label") == v)
            case "keyword_contains":
                return _sure(F.exists("keywords", lambda k: F.contains(F.lower(k), F.lit(v.lower()))))
            case "text_contains":
                return text_match(v)
            case "camera_contains":
                return F.contains(F.concat_ws(" ", _low("make"), _low("model")), F.lit(v.lower()))
            case "lens_contains":
                return F.contains(_low("lens"), F.lit(v.lower()))
            case "captured_after":
                return _sure(c("capture_time") >= F.lit(v))
            case "captured_before":
                return _sure(c("capture_time") <= F.lit(v))
            case "file_type_is":
                return _sure(F.upper("ext") == v.upper())
            case "has_edits":
                return _sure(c("edited")) == F.lit(bool(v))
            case "in_folder":
                return F.contains(_low("folder"), F.lit(v.lower()))
            case "has_keywords":
                return _sure(F.size("keywords") > 0) == F.lit(bool(v))
            case "captured_within_days":
                return _sure(c("capture_time") >= F.lit(days_ago(v, now)))
            case "edited_within_days":
                return _sure((c("edited_at") > 0) & (c("edited_at") >= now - v * 86400))
        raise ValueError(f"no such rule: {self.kind}")


@dataclass(frozen=True)
class Rules:
    """All or any of some rules; none of them match everything."""

    rules: tuple[Rule, ...]
    match_all: bool = True

    def column(self, now: int = 0) -> Column:
        found = [r.column(now) for r in self.rules]
        if not found:
            return F.lit(True)
        return functools.reduce((lambda a, b: a & b) if self.match_all else (lambda a, b: a | b), found)


@dataclass(frozen=True)
class Filter:
    """The library's filter bar."""

    text: str = ""
    rating: int = 0
    rating_op: str = "at_least"  # exactly, at_most
    flag: str = "all"  # picked, unflagged, rejected, not_rejected
    labels: tuple[int, ...] = field(default_factory=tuple)
    kind: str = "all"  # raw, jpeg, heif, other
    edited: bool | None = None
    exported: bool | None = None

    def column(self) -> Column:
        c = F.col
        ext = F.upper("ext")
        parts = [{"at_least": c("rating") >= self.rating, "exactly": c("rating") == self.rating, "at_most": c("rating") <= self.rating}[self.rating_op]]
        if self.text.strip():
            parts.append(text_match(self.text))
        if self.flag != "all":
            parts.append({"picked": c("flag") == 1, "unflagged": c("flag") == 0, "rejected": c("flag") == -1, "not_rejected": c("flag") != -1}[self.flag])
        if self.labels:
            parts.append(c("label").isin(*self.labels))
        if self.kind != "all":
            parts.append({"raw": c("is_raw"), "jpeg": ext.isin("JPG", "JPEG"), "heif": ext.isin(*HEIF_EXTENSIONS), "other": ~c("is_raw") & ~ext.isin("JPG", "JPEG", *HEIF_EXTENSIONS)}[self.kind])
        if self.edited is not None:
            parts.append(_sure(c("edited")) == self.edited)
        if self.exported is not None:
            parts.append(_sure(c("exported_at") > 0) == self.exported)
        return functools.reduce(lambda a, b: a & b, map(_sure, parts))


def of_source(photos: DataFrame, source: str, arg=None, *, members: DataFrame | None = None, faces: DataFrame | None = None, rules: Rules | None = None, now: int = 0) -> DataFrame:
    """Rows of a source: all, quick, last_import, missing, folder, collection or person.

    `members` has the ids of the quick collection (photo_id) or of collections (collection_id, photo_id).
    """
    ids = lambda df: df.select(F.col("photo_id").alias("id"))
    match source:
        case "all":
            return photos
        case "quick":
            return photos.join(ids(members), "id", "left_semi")
        case "last_import":
            return photos.where((F.col("import_id") == arg) & (F.col("import_id") != 0))
        case "missing":
            return photos.where("missing")
        case "folder":
            return photos.where(F.col("folder") == arg)
        case "collection":
            if rules is not None:
                return photos.where(rules.column(now))
            return photos.join(ids(members.where(F.col("collection_id") == arg)), "id", "left_semi")
        case "person":
            return photos.join(ids(faces.where(F.col("person") == arg)), "id", "left_semi")
    raise ValueError(f"no such source: {source}")


def count_rules(photos: DataFrame, sets: dict[str, Rules], now: int = 0) -> DataFrame:
    """(name, n) of each rule set, all counted in one pass."""
    one = photos.agg(*(F.count(F.when(r.column(now), 1)).alias(name) for name, r in sets.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n in sets))).alias("x")).select("x.*")
