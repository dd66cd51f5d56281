"""Settings documents as JSON: differences, patches, groups of fields."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

#: Fixed names of the stored document. Fields that change together:
WHITE_BALANCE = ("wb_custom", "temp_k", "tint_k", "temp", "tint")
#: fields of each group that can be copied;
GROUPS = {
    "white_balance": WHITE_BALANCE,
    "basic_tone": ("exposure", "contrast", "highlights", "shadows", "whites", "blacks"),
    "presence": ("texture", "clarity", "dehaze", "vibrance", "saturation"),
    "treatment": ("profile", "profile_amount", "treatment", "bw_mix"),
    "tone_curve": ("curve",),
    "hsl": ("hsl",),
    "point_color": ("point_colors",),
    "color_grading": ("grading",),
    "detail": ("detail",),
    "lens": ("lens",),
    "crop": ("geometry",),
    "effects": ("effects",),
    "calibration": ("calibration",),
    "masks": ("masks",),
}
#: sections of the editor, as groups.
SECTIONS = {"basic": ("white_balance", "basic_tone", "presence", "treatment"), "curve": ("tone_curve",), "color": ("hsl", "point_color"), "grading": ("color_grading",), "detail": ("detail",), "lens": ("lens",), "geometry": ("crop",), "effects": ("effects",), "calibration": ("calibration",), "masks": ("masks",)}


def diff(old, new) -> list[tuple[tuple, object]]:
    """(path, new value) of changed leaves; masks, and arrays of other lengths, are one leaf. Fields gone are no change."""
    out: list[tuple[tuple, object]] = []
    stack = [((), old, new)]
    while stack:
        path, a, b = stack.pop()
        if type(a) is type(b) and a == b or (not isinstance(a, bool) and not isinstance(b, bool) and isinstance(a, (int, float)) and a == b):
            continue
        inside = path[:1] != ("masks",)
        if inside and isinstance(a, dict) and isinstance(b, dict):
            for k in reversed(b):
                if k in a:
                    stack.append(((*path, k), a[k], b[k]))
                else:
                    out.append(((*path, k), b[k]))
        elif inside and path and isinstance(a, list) and isinstance(b, list) and len(a) == len(b):
            stack += [((*path, i), x, y) for i, (x, y) in reversed([*enumerate(zip(a, b, strict=True))])]
        else:
            out.append((path, b))
    return out


def put(root, path: tuple, value):
    """`root` with a value at a path; nothing if a parent or the place itself is missing."""
    if not path:
        return value
    at = root
    for k in path[:-1]:
        at = at.get(k) if isinstance(at, dict) else at[k] if isinstance(at, list) and isinstance(k, int) and k < len(at) else None
    last = path[-1]
    if isinstance(at, dict) and last in at or isinstance(at, list) and isinstance(last, int) and last < len(at):
        at[last] = value
    return root


def patched(target, old, new):
    """`target` with what changed from `old` to `new`; any change of white balance brings all of it."""
    changes = diff(old, new)
    if any(p[:1] and p[0] in WHITE_BALANCE for p, _ in changes):
        changes += [((k,), new[k]) for k in WHITE_BALANCE if k in new]
    out = json.loads(json.dumps(target))
    for path, value in changes:
        out = put(out, path, value)
    return out


def copied(target: dict, source: dict, groups: list[str]) -> dict:
    """`target` with the fields of the given groups from `source`."""
    return target | {f: source[f] for g in groups for f in GROUPS[g] if f in source}


def _load(s):
    try:
        return json.loads(s)
    except (TypeError, ValueError):
        return None


@pandas_udf(StringType())
def json_patch(target: pd.Series, old: pd.Series, new: pd.Series) -> pd.Series:
    """Arrow-batched `patched` on JSON texts; null if one does not parse."""
    docs = [tuple(map(_load, x)) for x in zip(target, old, new, strict=True)]
    return pd.Series([None if any(d is None for d in x) else json.dumps(patched(*x), sort_keys=True) for x in docs], dtype=object)


@pandas_udf(ArrayType(StringType()))
def json_changes(old: pd.Series, new: pd.Series) -> pd.Series:
    """Paths of changed leaves, slash-joined and sorted."""
    docs = [(_load(a), _load(b)) for a, b in zip(old, new, strict=True)]
    return pd.Series([sorted("/".join(map(str, p)) for p, _ in diff(a, b)) for a, b in docs], dtype=object)


@pandas_udf(StringType())
def json_copied(target: pd.Series, source: pd.Series, groups: pd.Series) -> pd.Series:
    """Arrow-batched `copied` on JSON texts, groups joined by commas; null if one does not parse."""
    docs = [(_load(a), _load(b), g.split(",") if g else []) for a, b, g in zip(target, source, groups, strict=True)]
    return pd.Series([None if not isinstance(a, dict) or not isinstance(b, dict) else json.dumps(copied(a, b, g), sort_keys=True) for a, b, g in docs], dtype=object)


def edited(develop: Column, raw: Column, defaults: dict[bool, dict]) -> Column:
    """Whether a settings document (JSON) says anything else than the default of its kind of file (`defaults` by raw or not).

    Documents are compared by value: the order of keys and the form of numbers do not matter, a missing field is at its default,
    unknown fields say nothing. Kelvin and tint do not count while `as_shot` is true. No document is no edit; neither is one that does not parse.
    """
    doc = F.try_parse_json(develop)

    def leaves(d: dict, path: str = "$") -> list[tuple[str, object]]:
        return [x for k, v in d.items() for x in (leaves(v, f"{path}.{k}") if isinstance(v, dict) and v else [(f"{path}.{k}", v)])]

    def differs(path: str, value) -> Column:
        if isinstance(value, bool):
            return F.coalesce(F.try_variant_get(doc, path, "boolean"), F.lit(value)) != value
        if isinstance(value, (int, float)):
            return F.coalesce(F.try_variant_get(doc, path, "double"), F.lit(float(value))) != float(value)
        if isinstance(value, str):
            return F.coalesce(F.try_variant_get(doc, path, "string"), F.lit(value)) != value
        text = F.to_json(F.try_variant_get(doc, path, "variant"))
        return F.coalesce(F.nullif(text, F.lit("null")), F.lit(json.dumps(value))) != json.dumps(value, separators=(",", ":"))

    def any_of(default: dict) -> Column:
        shot = F.coalesce(F.try_variant_get(doc, "$.as_shot", "boolean"), F.lit(bool(default.get("as_shot"))))
        out = F.lit(False)
        for path, value in leaves(default):
            one = differs(path, value)
            out = out | (~shot & one if path in ("$.temp_k", "$.tint_k") else one)
        return out

    return F.coalesce(F.when(raw, any_of(defaults[True])).otherwise(any_of(defaults[False])), F.lit(False))


def copy_groups(target: Column, source: Column, fields: list[str], groups: list[str]) -> Column:
    """Struct `target` with the fields of the groups from struct `source`, without leaving the JVM."""
    wanted = {f for g in groups for f in GROUPS[g]}
    return F.struct(*((source if f in wanted else target)[f].alias(f) for f in fields))


def is_default(settings: Column, default: Column, as_shot: Column, fields: list[str]) -> Column:
    """Equal to the default, Kelvin and tint apart while white balance is as shot."""
    free = F.coalesce(as_shot, F.lit(False))
    parts = [(free if f in ("temp_k", "tint_k") else F.lit(False)) | settings[f].eqNullSafe(default[f]) for f in fields]
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out
