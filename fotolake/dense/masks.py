"""Mask shapes, strokes, and their combination."""

from __future__ import annotations

import numpy as np


def smoothstep(a: float, b: float, x: np.ndarray) -> np.ndarray:
    t = np.clip((x - a) / (b - a), 0, 1)
    return t * t * (3 - 2 * t)


def linear(shape: tuple[int, int], x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
    """0 before the first point, 1 from the second on, in relative coordinates."""
    y, x = np.mgrid[: shape[0], : shape[1]] / np.array([max(shape[0] - 1, 1), max(shape[1] - 1, 1)])[:, None, None]
    d = np.array([x1 - x0, y1 - y0])
    return smoothstep(0, 1, ((x - x0) * d[0] + (y - y0) * d[1]) / max(d @ d, 1e-12))


def radial(shape: tuple[int, int], cx: float, cy: float, rx: float, ry: float, feather: float, angle: float = 0.0) -> np.ndarray:
    """1 inside the ellipse, falling to 0 at its edge over the feathered share."""
    y, x = np.mgrid[: shape[0], : shape[1]] / np.array([max(shape[0] - 1, 1), max(shape[1] - 1, 1)])[:, None, None]
    c, s = np.cos(np.radians(angle)), np.sin(np.radians(angle))
    u, v = (x - cx) * c + (y - cy) * s, (y - cy) * c - (x - cx) * s
    return 1 - smoothstep(1 - max(feather, 1e-6), 1, np.hypot(u / rx, v / ry))


def value_range(values: np.ndarray, low: float, high: float, soft: float) -> np.ndarray:
    soft = max(soft, 1e-6)
    return smoothstep(low - soft, low, values) * (1 - smoothstep(high, high + soft, values))


def strokes(shape: tuple[int, int], lines: list[dict]) -> np.ndarray:
    """Brush lines (points (n, 2) in pixels, radius, hardness, flow, erase) laid as dabs a quarter radius apart."""
    out = np.zeros(shape)
    yy, xx = np.mgrid[: shape[0], : shape[1]]
    for line in lines:
        points, r = resampled(np.asarray(line["points"], float), line["radius"] / 4), line["radius"]
        for px, py in points:
            d = np.hypot(xx - px, yy - py) / r
            dab = line.get("flow", 1.0) * (1 - smoothstep(min(line.get("hardness", 0.5), 0.999), 1, d))
            out = out * (1 - dab) if line.get("erase") else np.maximum(out, dab)
    return out


def resampled(points: np.ndarray, step: float) -> np.ndarray:
    """Evenly spaced points along a polyline, both ends included."""
    if len(points) < 2:
        return points
    at = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(points, axis=0).T))])
    n = max(2, int(np.ceil(at[-1] / max(step, 1e-9))) + 1)
    t = np.linspace(0, at[-1], n)
    return np.stack([np.interp(t, at, points[:, k]) for k in (0, 1)], axis=1)


def path_distance(x: np.ndarray, y: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distance to a polyline."""
    if len(points) == 1:
        return np.hypot(x - points[0, 0], y - points[0, 1])
    best = np.full(np.shape(x), np.inf)
    for (ax, ay), (bx, by) in zip(points, points[1:], strict=False):
        d = (bx - ax) ** 2 + (by - ay) ** 2
        t = np.clip(((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / max(d, 1e-12), 0, 1)
        best = np.minimum(best, np.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)))
    return best


def combined(parts: list[tuple[str, np.ndarray, bool]], invert: bool = False, amount: float = 1.0) -> np.ndarray:
    """(add, subtract or intersect; weights; inverted) in order; the first subtraction or intersection starts from all."""
    out = None
    for how, w, inverted in parts:
        w = 1 - w if inverted else w
        if out is None:
            out = np.zeros_like(w) if how == "add" else np.ones_like(w)
        out = np.maximum(out, w) if how == "add" else out * (1 - w) if how == "subtract" else out * w
    out = np.zeros(1) if out is None else out
    return (1 - out if invert else out) * amount
