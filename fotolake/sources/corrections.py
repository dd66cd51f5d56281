"""Foreign local corrections: lists of a parsed Lua table as masks with components and scaled adjustments."""

from __future__ import annotations

#: Correction lists, component kinds, and local settings with the factor to our scale; the first name of each wins.
LISTS = ("GradientBasedCorrections", "CircularGradientBasedCorrections", "PaintBasedCorrections", "MaskGroupBasedCorrections")
KINDS = {"Mask/Gradient": "linear", "Mask/CircularGradient": "radial", "Mask/Paint": "brush", "Mask/Aggregate": "group", "Mask/RangeMask": "range"}
LOCAL = {
    "exposure": (("LocalExposure2012", "LocalExposure"), 4.0),
    "contrast": (("LocalContrast2012", "LocalContrast"), 100.0),
    "highlights": (("LocalHighlights2012", "LocalHighlights"), 100.0),
    "shadows": (("LocalShadows2012", "LocalShadows"), 100.0),
    "whites": (("LocalWhites2012",), 100.0),
    "blacks": (("LocalBlacks2012",), 100.0),
    "clarity": (("LocalClarity2012", "LocalClarity"), 100.0),
    "dehaze": (("LocalDehaze",), 100.0),
    "saturation": (("LocalSaturation",), 100.0),
    "sharpness": (("LocalSharpness",), 100.0),
    "temp": (("LocalTemperature",), 100.0),
    "tint": (("LocalTint",), 100.0),
    "hue": (("LocalHue",), 180.0),
    "texture": (("LocalTexture",), 100.0),
    "noise": (("LocalLuminanceNoise",), 100.0),
}
#: What each shape needs; without it a component is left out.
NEEDED = {"linear": ("ZeroX", "ZeroY", "FullX", "FullY"), "radial": ("Top", "Left", "Bottom", "Right")}


def _number(v) -> float | None:
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return float(v)
    try:
        return float(v)
    except (TypeError, ValueError):
        return None


def adjustments(c: dict) -> dict[str, float]:
    """Local settings that are not zero."""
    out = {}
    for name, (keys, factor) in LOCAL.items():
        value = next((x for k in keys if (x := _number(c.get(k))) is not None), 0.0)
        if value:
            out[name] = value * factor
    return out


def _numbers(text) -> list[float]:
    return [n for x in str(text).split() if (n := _number(x)) is not None]


def _brush(m: dict) -> dict | None:
    """A stroke: its points (`d x y`), size, feather, flow and whether it erases; None without points."""
    dabs = m.get("Dabs") or []
    points = [tuple(v[:2]) for d in (dabs.values() if isinstance(dabs, dict) else dabs) if len(v := _numbers(str(d).partition(" ")[2])) >= 2]
    if not points:
        return None
    inside = lambda v: min(1.0, max(0.0, v))
    given = lambda k, default: default if (v := _number(m.get(k))) is None else v
    return {"points": points, "size": given("Radius", 0.05), "feather": inside(1 - given("CenterWeight", 0.5)), "flow": inside(given("Flow", 1.0)), "erase": given("MaskValue", 1.0) <= 0}


def _luminance(m: dict) -> dict | None:
    """A range of luminance: the middles of its outer and inner ends, and its softness; None for other ranges."""
    r = m.get("CorrectionRangeMask")
    if not isinstance(r, dict) or int(_number(r.get("Type")) or 0) != 2:
        return None
    v = _numbers(r.get("LumRange", ""))
    low, high = ((v[0] + v[1]) / 2, (v[2] + v[3]) / 2) if len(v) >= 4 else (0.0, 1.0)
    return {"low": low, "high": high, "smooth": 0.5 if (f := _number(r.get("LumFeather"))) is None else f}


def component(m: dict) -> dict | None:
    """Kind, how it joins the mask, inversion and shape; None for kinds that need a model, and shapes that lack a part."""
    kind = KINDS.get(str(m.get("What", "")))
    if kind is None:
        return None
    inverted = bool(m.get("MaskInverted"))
    blend = _number(m.get("MaskBlendMode")) or 0
    how = ("subtract" if inverted else "intersect") if blend == 1 else "add"
    if kind == "brush":
        shape = _brush(m)
    elif kind == "range":
        shape = _luminance(m)
    else:
        shape = {k: n for k in ("ZeroX", "ZeroY", "FullX", "FullY", "Top", "Left", "Bottom", "Right", "Angle", "Feather", "Radius", "Flow") if (n := _number(m.get(k))) is not None}
        shape = shape if all(k in shape for k in NEEDED.get(kind, ())) else None
    if shape is None:
        return None
    turned = (inverted and how != "subtract") != (kind == "radial" and bool(m.get("Flipped")))
    return {"kind": kind, "how": how, "inverted": turned, "amount": 1.0 if (v := _number(m.get("MaskValue"))) is None else v, "shape": shape}


def masks(settings: dict) -> tuple[list[dict], list[str]]:
    """Masks of a settings table, and at most one warning that counts components left out.

    Inactive corrections and those without a component are dropped.
    """
    out, left = [], 0
    for name in LISTS:
        for c in settings.get(name) or []:
            if not isinstance(c, dict) or c.get("CorrectionActive") is False:
                continue
            found = [component(m) for m in c.get("CorrectionMasks") or [] if isinstance(m, dict)]
            left += sum(x is None for x in found)
            parts = [x for x in found if x]
            if parts:
                out.append({"name": c.get("CorrectionName", ""), "amount": 1.0 if (v := _number(c.get("CorrectionAmount"))) is None else v, "parts": parts, "local": adjustments(c)})
    return out, [f"{left} mask components are not supported"] if left else []


def spots(settings: dict) -> list[dict]:
    """Retouch spots of the new form (areas) or the old (texts of `key = value` pairs)."""
    out = []
    for a in settings.get("RetouchAreas") or []:
        first = next((m for m in (a.get("Masks") or []) if isinstance(m, dict)), {}) if isinstance(a, dict) else {}
        place = [_number(first.get(k)) for k in ("X", "Y")] + [_number(a.get(k)) for k in ("OffsetX", "OffsetY")] if first else []
        if place and None not in place:
            out.append({"x": place[0], "y": place[1], "source": (place[2], place[3]), "radius": _number(first.get("Radius")) or _number(first.get("SizeX")) or 0.0, "heal": a.get("Method", "heal") == "heal"})
    for s in settings.get("RetouchInfo") or []:
        pairs = dict(p.split("=", 1) for p in str(s).replace(" ", "").split(",") if "=" in p)
        n = {k: _number(v) for k, v in pairs.items()}
        if None not in (n.get("centerX"), n.get("centerY"), n.get("radius")):
            out.append({"x": n["centerX"], "y": n["centerY"], "source": (n.get("sourceX"), n.get("sourceY")), "radius": n["radius"], "heal": pairs.get("spotType", "heal") == "heal"})
    return out
