"""Blurs, resampling and edge-preserving filters. Edges repeat unless a function says otherwise."""

from __future__ import annotations

import math

import numpy as np


def _box_axis(a: np.ndarray, r: int, axis: int) -> np.ndarray:
    pad = [(0, 0)] * a.ndim
    pad[axis] = (r + 1, r)
    c = np.cumsum(np.pad(a, pad, mode="edge"), axis=axis, dtype=np.float64)
    n = a.shape[axis]
    take = lambda s: np.take(c, np.arange(s, s + n), axis=axis)
    return (take(2 * r + 1) - take(0)) / (2 * r + 1)


def box_blur(a: np.ndarray, r: int) -> np.ndarray:
    return np.asarray(a, np.float64) if r <= 0 else _box_axis(_box_axis(np.asarray(a, np.float64), r, 0), r, 1)


def box_mean(a: np.ndarray, r: int) -> np.ndarray:
    """Means over windows cut at the edges, by a summed-area table."""
    h, w = a.shape[:2]
    s = np.zeros((h + 1, w + 1, *a.shape[2:]))
    s[1:, 1:] = a.cumsum(0).cumsum(1)
    y0, y1 = np.maximum(np.arange(h) - r, 0), np.minimum(np.arange(h) + r + 1, h)
    x0, x1 = np.maximum(np.arange(w) - r, 0), np.minimum(np.arange(w) + r + 1, w)
    total = s[y1][:, x1] - s[y0][:, x1] - s[y1][:, x0] + s[y0][:, x0]
    area = np.outer(y1 - y0, x1 - x0)
    return total / (area[..., None] if a.ndim == 3 else area)


def downsample(a: np.ndarray, f: int) -> np.ndarray:
    """Cell means; the last cells may be smaller."""
    if f <= 1:
        return np.asarray(a, np.float64)
    h, w = a.shape[:2]
    ys, xs = np.arange(0, h, f), np.arange(0, w, f)
    total = np.add.reduceat(np.add.reduceat(np.asarray(a, np.float64), ys, axis=0), xs, axis=1)
    area = np.outer(np.diff([*ys, h]), np.diff([*xs, w]))
    return total / (area[..., None] if a.ndim == 3 else area)


half = lambda a: downsample(a, 2)


def bilinear(a: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Samples at pixel-centre coordinates, clamped to the edges."""
    h, w = a.shape[:2]
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    tx, ty = x - x0, y - y0
    if a.ndim == 3:
        tx, ty = tx[..., None], ty[..., None]
    top = a[y0, x0] * (1 - tx) + a[y0, x1] * tx
    return top * (1 - ty) + (a[y1, x0] * (1 - tx) + a[y1, x1] * tx) * ty


def upsample(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """Cell-centred bilinear resampling."""
    y = (np.arange(h) + 0.5) * a.shape[0] / h - 0.5
    x = (np.arange(w) + 0.5) * a.shape[1] / w - 0.5
    return bilinear(a, *np.meshgrid(x, y))


def gauss_blur(a: np.ndarray, sigma: float) -> np.ndarray:
    """Three box passes of the variance of a Gaussian; wide ones at half the resolution."""
    if sigma < 0.3:
        return np.asarray(a, np.float64)
    if sigma > 4 and min(a.shape[:2]) > 64:
        return upsample(gauss_blur(half(a), sigma / 2), *a.shape[:2])
    r = max(1, round((math.sqrt(4 * sigma * sigma + 1) - 1) / 2))
    for _ in range(3):
        a = box_blur(a, r)
    return a


def guided(guide: np.ndarray, a: np.ndarray, r: int, eps: float, mean=box_mean) -> np.ndarray:
    """He and others' guided filter with a grey guide."""
    mg, ma = mean(guide, r), mean(a, r)
    slope = (mean(guide * a, r) - mg * ma) / (np.maximum(mean(guide * guide, r) - mg * mg, 0) + eps)
    return mean(slope, r) * guide + mean(ma - slope * mg, r)


def guided_self(a: np.ndarray, r: int, eps: float, sub: int = 1) -> np.ndarray:
    """The guided filter with itself as guide; coefficients at a `sub`-th of the resolution."""
    sub = max(1, min(sub, max(r, 1)))
    s, rs = downsample(a, sub), max(1, r // sub)
    m = box_blur(s, rs)
    var = np.maximum(box_blur(s * s, rs) - m * m, 0)
    slope = var / (var + eps)
    ma, mb = box_blur(slope, rs), box_blur(m - slope * m, rs)
    if sub > 1:
        ma, mb = upsample(ma, *a.shape), upsample(mb, *a.shape)
    return ma * a + mb


def lanczos(a: np.ndarray, h: int, w: int, lobes: int = 3, low: float = 0.0, high: float = 1.0) -> np.ndarray:
    """Separable Lanczos resampling, widened when shrinking, clamped to [low, high]."""

    def weights(n: int, m: int) -> np.ndarray:
        scale = max(1.0, n / m)
        at = (np.arange(m) + 0.5) * n / m - 0.5
        x = (np.arange(n)[None, :] - at[:, None]) / scale
        k = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0.0)
        return k / k.sum(axis=1, keepdims=True)

    out = np.tensordot(weights(a.shape[0], h), np.asarray(a, np.float64), axes=(1, 0))
    out = np.moveaxis(np.tensordot(weights(a.shape[1], w), out, axes=(1, 1)), 0, 1)
    return np.clip(out, low, high)


def luma(a: np.ndarray) -> np.ndarray:
    return a @ np.array([0.2126, 0.7152, 0.0722])


def unsharp(a: np.ndarray, sigma: float, amount: float) -> np.ndarray:
    """Sharpening of luma alone."""
    y = luma(a)
    return np.clip(a + (amount * (y - gauss_blur(y, sigma)))[..., None], 0, 1)


def oriented(a: np.ndarray, orientation: int) -> np.ndarray:
    """The eight EXIF orientations, upright."""
    a = np.swapaxes(a, 0, 1) if orientation in (5, 6, 7, 8) else a
    if orientation in (2, 3, 6, 7):
        a = a[:, ::-1]
    if orientation in (3, 4, 7, 8):
        a = a[::-1]
    return a


def level_for(full_w: int, full_h: int, w: int, h: int, levels: int) -> int:
    """The smallest pyramid level that needs no enlarging."""
    k = min(full_w / max(w, 1), full_h / max(h, 1))
    return max(0, min(levels - 1, math.floor(math.log2(k)) if k >= 1 else 0))


def border(a: np.ndarray, width: int, colour: tuple[float, float, float]) -> np.ndarray:
    out = np.empty((a.shape[0] + 2 * width, a.shape[1] + 2 * width, 3))
    out[:] = colour
    out[width : width + a.shape[0], width : width + a.shape[1]] = a
    return out


def composite(base: np.ndarray, layer: np.ndarray, x: int, y: int, opacity: float) -> np.ndarray:
    """A premultiplied RGBA layer over RGB, cut at the edges."""
    out = np.array(base, np.float64)
    x0, y0, x1, y1 = max(x, 0), max(y, 0), min(x + layer.shape[1], base.shape[1]), min(y + layer.shape[0], base.shape[0])
    if x0 < x1 and y0 < y1:
        part = layer[y0 - y : y1 - y, x0 - x : x1 - x] * opacity
        out[y0:y1, x0:x1] = part[..., :3] + out[y0:y1, x0:x1] * (1 - part[..., 3:])
    return out


def lut3d(a: np.ndarray, lut: np.ndarray) -> np.ndarray:
    """Trilinear look-up in a cube (n, n, n, 3) indexed by r, g, b in 0 to 1."""
    n = lut.shape[0]
    p = np.clip(a, 0, 1) * (n - 1)
    i = np.minimum(p.astype(int), n - 2)
    t = p - i
    out = np.zeros_like(p)
    for corner in np.ndindex(2, 2, 2):
        c = np.array(corner)
        w = np.prod(np.where(c, t, 1 - t), axis=-1, keepdims=True)
        at = i + c
        out += w * lut[at[..., 0], at[..., 1], at[..., 2]]
    return out


def noise(x: np.ndarray, y: np.ndarray, seed: int = 0) -> np.ndarray:
    """Value noise in 0 to 1: hashed lattice values, smoothly blended; the same everywhere for the same seed."""

    def lattice(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        h = (i.astype(np.uint32) * np.uint32(0x9E3779B1)) ^ (j.astype(np.uint32) * np.uint32(0x85EBCA77)) ^ np.uint32(seed * 0xC2B2AE3D & 0xFFFFFFFF)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        h = (h ^ (h >> np.uint32(12))) * np.uint32(0x297A2D39)
        return (h ^ (h >> np.uint32(15))) / 0xFFFFFFFF

    i, j = np.floor(x).astype(np.int64), np.floor(y).astype(np.int64)
    s = lambda t: t * t * (3 - 2 * t)
    tx, ty = s(x - i), s(y - j)
    top = lattice(i, j) * (1 - tx) + lattice(i + 1, j) * tx
    return top * (1 - ty) + (lattice(i, j + 1) * (1 - tx) + lattice(i + 1, j + 1) * tx) * ty


def monotone_spline(xs: np.ndarray, ys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Fritsch and Carlson's monotone cubic through the points, clamped outside."""
    xs, ys = np.asarray(xs, float), np.asarray(ys, float)
    if len(xs) < 2:
        return np.full(np.shape(at), ys[0] if len(ys) else 0.0)
    h, d = np.diff(xs), np.diff(ys) / np.diff(xs)
    m = np.concatenate([[d[0]], (d[1:] + d[:-1]) / 2, [d[-1]]])
    m[1:-1][d[1:] * d[:-1] <= 0] = 0
    for k, s in enumerate(d):
        if s == 0:
            m[k] = m[k + 1] = 0
        else:
            a, b = m[k] / s, m[k + 1] / s
            if (q := a * a + b * b) > 9:
                m[k], m[k + 1] = 3 * a * s / math.sqrt(q), 3 * b * s / math.sqrt(q)
    at = np.clip(at, xs[0], xs[-1])
    k = np.clip(np.searchsorted(xs, at, "right") - 1, 0, len(h) - 1)
    t = (at - xs[k]) / h[k]
    return (2 * t**3 - 3 * t**2 + 1) * ys[k] + (t**3 - 2 * t**2 + t) * h[k] * m[k] + (3 * t**2 - 2 * t**3) * ys[k + 1] + (t**3 - t**2) * h[k] * m[k + 1]


def membrane(a: np.ndarray, hole: np.ndarray, steps: int = 400, omega: float = 1.85) -> np.ndarray:
    """Laplace's equation inside `hole` with the rest as boundary, by over-relaxed red and black sweeps."""
    out = np.array(a, np.float64)
    out[hole] = a[~hole].mean(axis=0) if (~hole).any() else 0
    grid = np.add.outer(np.arange(a.shape[0]), np.arange(a.shape[1])) % 2
    for _ in range(steps):
        for colour in (0, 1):
            p = np.pad(out, [(1, 1), (1, 1)] + [(0, 0)] * (a.ndim - 2), mode="edge")
            mean = (p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:]) / 4
            now = hole & (grid == colour)
            out[now] += omega * (mean[now] - out[now])
    return out


def defringe(a: np.ndarray, amount: float, centre: float, reach: float = 30.0) -> np.ndarray:
    """Colours near a hue (degrees) lose chroma beside strong luma edges."""
    y = luma(a)
    gy, gx = np.gradient(y)
    edge = np.clip(box_blur(np.hypot(gx, gy), 2) * 8, 0, 1)
    r, g, b = np.moveaxis(a, -1, 0)
    hue = np.degrees(np.arctan2(np.sqrt(3) * (g - b), 2 * r - g - b)) % 360
    apart = np.abs((hue - centre + 180) % 360 - 180)
    k = np.clip(1 - apart / reach, 0, 1) * edge * amount
    return a * (1 - k[..., None]) + y[..., None] * k[..., None]


def red_eye(a: np.ndarray, x: float, y: float, radius: float, darken: float = 0.5) -> np.ndarray:
    """Within a soft circle, redness over green and blue is neutralised and darkened."""
    yy, xx = np.mgrid[: a.shape[0], : a.shape[1]]
    soft = np.clip(1.5 - 1.5 * np.hypot(xx - x, yy - y) / radius, 0, 1)
    rest = np.maximum(a[..., 1], a[..., 2])
    k = soft * np.clip((a[..., 0] - 1.3 * rest) / np.maximum(a[..., 0], 1e-6) * 3, 0, 1)
    grey = (rest * (1 - darken * k))[..., None]
    return a * (1 - k[..., None]) + grey * k[..., None]


def redact(a: np.ndarray, box: tuple[int, int, int, int], how: str = "mosaic", cell: int = 16, ellipse: bool = False) -> np.ndarray:
    """Mosaic, blur or fill inside a box (x0, y0, x1, y1) or the ellipse in it."""
    x0, y0, x1, y1 = box
    part = a[y0:y1, x0:x1]
    if how == "mosaic":
        d = downsample(part, cell)
        new = d[np.arange(y1 - y0) // cell][:, np.arange(x1 - x0) // cell]
    else:
        new = gauss_blur(part, cell) if how == "blur" else np.zeros_like(part)
    yy, xx = np.mgrid[: y1 - y0, : x1 - x0]
    inside = ((xx + 0.5) / (x1 - x0) * 2 - 1) ** 2 + ((yy + 0.5) / (y1 - y0) * 2 - 1) ** 2 <= 1 if ellipse else np.ones(part.shape[:2], bool)
    out = np.array(a, np.float64)
    out[y0:y1, x0:x1] = np.where(inside[..., None] if a.ndim == 3 else inside, new, part)
    return out
