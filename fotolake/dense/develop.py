"""A develop pipeline of nine stages as numpy functions; response curves and tuning are parameters, neutral by default.

Settings: exposure (stops), temp, tint (stops), highlights, shadows, clarity, contrast, whites, blacks (-1 to 1), curve
(points in 0 to 1), saturation, vibrance (-1 to 1), hsl (8 bands of hue, saturation, luminance), sharpen, noise, vignette, grain,
mask (function of a tile's coordinates), crop and geometry outside, by `Frame`.
"""

from __future__ import annotations

import numpy as np

from fotolake.dense.filters import gauss_blur, guided_self, luma, monotone_spline, noise, unsharp

BANDS = np.arange(8) * 45.0


def encode(v: np.ndarray) -> np.ndarray:
    v = np.clip(v, 0, None)
    return np.where(v <= 0.0031308, v * 12.92, 1.055 * v ** (1 / 2.4) - 0.055)


def linear(a: np.ndarray, s: dict) -> np.ndarray:
    """White balance and exposure."""
    temp, tint = s.get("temp", 0.0), s.get("tint", 0.0)
    gain = 2.0 ** (s.get("exposure", 0.0) + np.array([temp / 2, -tint, -temp / 2]))
    return a * gain


def local_tone(a: np.ndarray, s: dict) -> np.ndarray:
    """Highlights, shadows and clarity on an edge-preserving base of log luma."""
    high, low, clear = s.get("highlights", 0.0), s.get("shadows", 0.0), s.get("clarity", 0.0)
    if not (high or low or clear):
        return a
    y = np.log2(np.maximum(luma(a), 1e-4))
    base = guided_self(y, 12, 0.3)
    bright = np.clip((base + 2.5) / 2.5, 0, 1)
    gain = high * bright**2 + low * (1 - bright) ** 2 + clear * 0.5 * (y - base)
    return a * (2.0**gain)[..., None]


def tone_lut(s: dict, n: int = 1024) -> np.ndarray:
    """Contrast, whites, blacks and the curve on encoded values, forced monotone."""
    x = np.linspace(0, 1, n)
    y = x + s.get("contrast", 0.0) * 0.3 * np.sin((x - 0.5) * 2 * np.pi) / np.pi
    y = y + s.get("whites", 0.0) * 0.25 * x**3 + s.get("blacks", 0.0) * 0.25 * (1 - x) ** 3
    curve = s.get("curve") or []
    if len(curve) > 1:
        xs, ys = np.array(sorted(curve)).T
        y = monotone_spline(xs, ys, np.clip(y, 0, 1))
    return np.maximum.accumulate(np.clip(y, 0, 1))


def tone(a: np.ndarray, s: dict) -> np.ndarray:
    lut = tone_lut(s)
    return np.interp(np.clip(encode(a), 0, 1), np.linspace(0, 1, len(lut)), lut)


def hue_of(a: np.ndarray) -> np.ndarray:
    r, g, b = np.moveaxis(a, -1, 0)
    return np.degrees(np.arctan2(np.sqrt(3) * (g - b), 2 * r - g - b)) % 360


def colour(a: np.ndarray, s: dict) -> np.ndarray:
    """Saturation, vibrance and eight hue bands."""
    sat, vib, bands = s.get("saturation", 0.0), s.get("vibrance", 0.0), s.get("hsl")
    y = luma(a)[..., None]
    chroma = (a.max(axis=-1) - a.min(axis=-1))[..., None]
    gain = 1 + sat + vib * (1 - np.clip(chroma * 1.5, 0, 1))
    light = np.ones_like(y)
    if bands is not None:
        bands = np.asarray(bands, float)
        at = hue_of(a) / 45
        i, t = np.floor(at).astype(int) % 8, at - np.floor(at)
        t = (t * t * (3 - 2 * t))[..., None]
        mix = bands[i] * (1 - t) + bands[(i + 1) % 8] * t
        turn = np.radians(mix[..., 0])
        k = (1 - np.cos(turn)) / 3
        c, q = np.cos(turn), np.sin(turn) / np.sqrt(3)
        r, g, b = np.moveaxis(a, -1, 0)
        total = r + g + b
        a = np.stack([r * c + q * (b - g) + k * total, g * c + q * (r - b) + k * total, b * c + q * (g - r) + k * total], axis=-1)
        gain, light = gain + mix[..., 1:2], 1 + mix[..., 2:3] * np.clip(chroma * 2, 0, 1)
    return np.clip((y + (a - y) * np.maximum(gain, 0)) * light, 0, 1)


def detail(a: np.ndarray, s: dict) -> np.ndarray:
    if s.get("noise"):
        y = luma(a)
        smooth = guided_self(y, 4, (0.1 * s["noise"]) ** 2)
        a = a + (smooth - y)[..., None]
    return unsharp(a, 1.0, s["sharpen"]) if s.get("sharpen") else np.clip(a, 0, 1)


def effects(a: np.ndarray, s: dict, row: dict) -> np.ndarray:
    """Vignette and grain by the place in the full image, so tiles agree."""
    h, w = a.shape[:2]
    yy, xx = np.mgrid[:h, :w]
    x, y = xx + row["x"] - row["halo_l"], yy + row["y"] - row["halo_t"]
    if s.get("vignette"):
        r = np.hypot((x - row["full_w"] / 2) / row["full_w"], (y - row["full_h"] / 2) / row["full_h"]) * np.sqrt(2)
        a = a * (1 + s["vignette"] * r**2)[..., None]
    if s.get("grain"):
        a = a + s["grain"] * (noise(x / 1.7, y / 1.7, 7) - 0.5)[..., None]
    return np.clip(a, 0, 1)


def render(a: np.ndarray, s: dict, row: dict | None = None) -> np.ndarray:
    """Linear RGB to encoded output; NaN marks what is outside the source and stays."""
    row = row or {"x": 0, "y": 0, "halo_l": 0, "halo_t": 0, "full_w": a.shape[1], "full_h": a.shape[0]}
    gone = np.isnan(a)
    a = np.where(gone, 0.0, a)
    out = effects(detail(colour(tone(local_tone(linear(a, s), s), s), s), s), s, row)
    if s.get("mask") and s.get("local"):
        weight = s["mask"](a.shape[:2], row)[..., None]
        out = out * (1 - weight) + render(a, {**s, **s["local"], "mask": None}, row) * weight
    return np.where(gone, np.nan, out)


def histogram(a: np.ndarray) -> np.ndarray:
    """4 by 256 counts of r, g, b and luma of an encoded image; NaN is skipped."""
    v = a.reshape(-1, 3)
    v = np.clip(np.round(v[~np.isnan(v).any(axis=1)] * 255), 0, 255)
    planes = [*v.T, np.minimum(np.floor(v @ [0.2126, 0.7152, 0.0722]), 255)]
    return np.stack([np.bincount(p.astype(int), minlength=256) for p in planes])


def white_balance_of(sample: np.ndarray) -> tuple[float, float]:
    r, g, b = np.maximum(sample, 1e-4)
    return float(np.log2(b / r)), float(np.log2(g / np.sqrt(r * b)))


def dark_channel(a: np.ndarray, r: int = 7) -> tuple[np.ndarray, float]:
    """The local minimum over channels, smoothed, and the airlight: its 99.5 % rank."""
    d = gauss_blur(a.min(axis=-1), r / 2)
    flat = np.sort(d, axis=None)
    return d, float(flat[min(len(flat) - 1, int(len(flat) * 0.995))])
