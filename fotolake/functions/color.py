"""Colour arithmetic as columns, from the published sRGB, HSV and CIE formulas."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def srgb_encode(v: Column) -> Column:
    return F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, 1 / 2.4) - 0.055)


def srgb_decode(v: Column) -> Column:
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, 2.4))


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def hue_chroma(r: Column, g: Column, b: Column) -> tuple[Column, Column]:
    """Hue in degrees (0 without chroma) and chroma."""
    most, least = F.greatest(r, g, b), F.least(r, g, b)
    c = most - least
    six = F.when(most == r, F.pmod((g - b) / c, F.lit(6.0))).when(most == g, (b - r) / c + 2).otherwise((r - g) / c + 4)
    return F.when(c > 0, six * 60).otherwise(F.lit(0.0)), c


def rotate_hue(r: Column, g: Column, b: Column, degrees: Column) -> tuple[Column, Column, Column]:
    """Rotation about the grey axis (Rodrigues)."""
    a = F.radians(degrees)
    cos, sin, mean = F.cos(a), F.sin(a) / math.sqrt(3), (r + g + b) / 3 * (1 - F.cos(a))
    return r * cos + sin * (b - g) + mean, g * cos + sin * (r - b) + mean, b * cos + sin * (g - r) + mean


def hsv_to_rgb(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    part = lambda n: v - v * s * F.greatest(F.lit(0.0), F.least(k := F.pmod(F.lit(float(n)) + h / 60, F.lit(6.0)), 4 - k, F.lit(1.0)))
    return part(5), part(3), part(1)


def smoothstep(a: Column | float, b: Column | float, x: Column) -> Column:
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - a) / (b - a)))
    return t * t * (3 - 2 * t)


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE Lab under D65 of encoded sRGB in 0 to 1."""
    r, g, b = map(srgb_decode, (r, g, b))
    xyz = ((0.4124564 * r + 0.3575761 * g + 0.1804375 * b) / 0.95047, 0.2126729 * r + 0.7151522 * g + 0.0721750 * b, (0.0193339 * r + 0.1191920 * g + 0.9503041 * b) / 1.08883)
    x, y, z = (F.when(t > 216 / 24389, F.pow(t, 1 / 3)).otherwise((24389 / 27 * t + 16) / 116) for t in xyz)
    return 116 * y - 16, 500 * (x - y), 200 * (y - z)


def delta_e(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0)))


def wb_from_sample(r: Column, g: Column, b: Column, reach: float = 1.0) -> tuple[Column, Column]:
    """Warmth and tint, in stops of blue against red and of green against both, that neutralise a sample."""
    safe = lambda c: F.greatest(c, F.lit(1e-4))
    temp = F.log2(safe(b) / safe(r))
    tint = F.log2(safe(g) / F.sqrt(safe(r) * safe(b)))
    clamp = lambda c: F.greatest(F.lit(-reach), F.least(F.lit(reach), c))
    return clamp(temp), clamp(tint)


def band_of(hue: Column, centres: list[float]) -> tuple[Column, Column, Column]:
    """The bands on either side of a hue and the smooth weight of the second; `centres` ascending in degrees."""
    n = len(centres)
    first, weight = F.lit(n - 1), None
    span = centres[0] + 360 - centres[-1]
    weight = smoothstep(0.0, 1.0, F.pmod(hue - centres[-1], F.lit(360.0)) / span)
    for i in range(n - 1):
        inside = (hue >= centres[i]) & (hue < centres[i + 1])
        first = F.when(inside, F.lit(i)).otherwise(first)
        weight = F.when(inside, smoothstep(0.0, 1.0, (hue - centres[i]) / (centres[i + 1] - centres[i]))).otherwise(weight)
    return first, F.pmod(first + 1, F.lit(n)), weight


def apply_matrix(m: list[list[float]], r: Column, g: Column, b: Column) -> tuple[Column, ...]:
    return tuple(x * r + y * g + z * b for x, y, z in m)


def ev_of(exposure: Column, iso: Column, fnumber: Column) -> Column:
    """Light received, in stops; null if a value is missing or not positive."""
    return F.when((exposure > 0) & (iso > 0) & (fnumber > 0), F.log2(exposure) + F.log2(iso / 100.0) - 2 * F.log2(fnumber))


def point_weight(hue: Column, sat: Column, lum: Column, at: tuple[float, float, float], ranges: tuple[float, float, float]) -> Column:
    """Influence of a picked colour: a product of smooth windows of hue (degrees), saturation and lightness distance.

    Ranges are half-widths. Near grey, hue says nothing: it does not count for a grey pick, and fades out for grey pixels.
    """
    apart = F.abs(F.pmod(hue - at[0] + 180.0, F.lit(360.0)) - 180.0)

    def window(d: Column, r: float) -> Column:
        t = F.least(F.abs(d) / r, F.lit(1.0))
        return F.pow(1 - t * t, F.lit(2.0))

    near = F.lit(1.0) if at[1] < 0.06 else window(apart, ranges[0]) * smoothstep(0.0, 0.05, sat)
    return near * window(sat - at[1], ranges[1]) * window(lum - at[2], ranges[2])


def stretched(v: Column, black: float, white: float) -> Column:
    """A linear value with black and white points taken to 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - black) / (white - black)))
