"""Image geometry: frame to base, its inverse, crops, homographies, alignment, panoramas, exposure merges."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from fotolake.dense.filters import bilinear, box_blur, downsample, gauss_blur, luma


@dataclass(frozen=True)
class Frame:
    """Fine rotation (degrees), scale, keystone, quarter turns, flips and radial distortion of a w by h base image."""

    w: float
    h: float
    angle: float = 0.0
    scale: float = 1.0
    vertical: float = 0.0
    horizontal: float = 0.0
    turns: int = 0
    flip_h: bool = False
    flip_v: bool = False
    distortion: float = 0.0

    @property
    def size(self) -> tuple[float, float]:
        return (self.h, self.w) if self.turns % 2 else (self.w, self.h)

    def to_base(self, x, y):
        """Base coordinates of frame coordinates."""
        fw, fh = self.size
        a, unit = np.radians(self.angle), 0.5 * max(fw, fh)
        dx, dy = np.asarray(x, float) - fw / 2, np.asarray(y, float) - fh / 2
        qx, qy = (np.cos(a) * dx + np.sin(a) * dy) / unit / self.scale, (np.cos(a) * dy - np.sin(a) * dx) / unit / self.scale
        w = 1 + self.vertical * qy + self.horizontal * qx
        w = np.where(np.abs(w) < 0.05, np.copysign(0.05, w), w)
        x, y = qx / w * unit + fw / 2, qy / w * unit + fh / 2
        cw, ch = fw, fh
        for _ in range(self.turns % 4):
            x, y = y, cw - x
            cw, ch = ch, cw
        x, y = (self.w - x if self.flip_h else x), (self.h - y if self.flip_v else y)
        half = 0.5 * np.hypot(self.w, self.h)
        ux, uy = (x - self.w / 2) / half, (y - self.h / 2) / half
        f = 1 + self.distortion * (ux * ux + uy * uy)
        return self.w / 2 + ux * f * half, self.h / 2 + uy * f * half

    def to_frame(self, bx, by, steps: int = 24):
        """The inverse, by Newton's method with numeric derivatives."""
        fw, fh = self.size
        x, y = np.full(np.shape(bx), fw / 2), np.full(np.shape(by), fh / 2)
        for _ in range(steps):
            px, py = self.to_base(x, y)
            ax, ay = self.to_base(x + 0.5, y)
            cx, cy = self.to_base(x, y + 0.5)
            j = np.array([[(ax - px) / 0.5, (cx - px) / 0.5], [(ay - py) / 0.5, (cy - py) / 0.5]])
            det = j[0, 0] * j[1, 1] - j[0, 1] * j[1, 0]
            det = np.where(np.abs(det) < 1e-9, 1e-9, det)
            ex, ey = px - bx, py - by
            x, y = x - (j[1, 1] * ex - j[0, 1] * ey) / det, y - (j[0, 0] * ey - j[1, 0] * ex) / det
        return x, y

    def inside(self, crop: tuple[float, float, float, float], n: int = 24) -> bool:
        """Does the border of a relative crop lie inside the base image?"""
        t = np.linspace(0, 1, n)
        x0, y0, x1, y1 = crop
        x = np.concatenate([x0 + (x1 - x0) * t, x0 + (x1 - x0) * t, np.full(n, x0), np.full(n, x1)]) * self.size[0]
        y = np.concatenate([np.full(n, y0), np.full(n, y1), y0 + (y1 - y0) * t, y0 + (y1 - y0) * t]) * self.size[1]
        bx, by = self.to_base(x, y)
        return bool(((bx >= -0.5) & (bx <= self.w + 0.5) & (by >= -0.5) & (by <= self.h + 0.5)).all())

    def constrained(self, crop: tuple[float, float, float, float]) -> tuple[float, float, float, float]:
        """The largest crop about the same centre that lies inside, by bisection."""
        if self.inside(crop):
            return crop
        cx, cy = (crop[0] + crop[2]) / 2, (crop[1] + crop[3]) / 2
        at = lambda k: (cx + (crop[0] - cx) * k, cy + (crop[1] - cy) * k, cx + (crop[2] - cx) * k, cy + (crop[3] - cy) * k)
        low, high = 0.0, 1.0
        for _ in range(20):
            mid = (low + high) / 2
            low, high = (mid, high) if self.inside(at(mid)) else (low, mid)
        return at(low)

    def render(self, a: np.ndarray) -> np.ndarray:
        w, h = (round(v) for v in self.size)
        y, x = np.mgrid[:h, :w] + 0.5
        bx, by = self.to_base(x, y)
        return bilinear(a, bx - 0.5, by - 0.5)


def cropped_dims(w: int, h: int, crop: tuple[float, float, float, float], turns: int) -> tuple[int, int]:
    fw, fh = (h, w) if turns % 2 else (w, h)
    return round((crop[2] - crop[0]) * fw), round((crop[3] - crop[1]) * fh)


def homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The 3 by 3 map of normalised points by the direct linear transform."""

    def norm(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m, s = p.mean(axis=0), np.sqrt(2) / max(np.linalg.norm(p - p.mean(axis=0), axis=1).mean(), 1e-12)
        return (p - m) * s, np.array([[s, 0, -s * m[0]], [0, s, -s * m[1]], [0, 0, 1]])

    (a, ta), (b, tb) = norm(src), norm(dst)
    rows = []
    for (x, y), (u, v) in zip(a, b, strict=True):
        rows += [[-x, -y, -1, 0, 0, 0, u * x, u * y, u], [0, 0, 0, -x, -y, -1, v * x, v * y, v]]
    m = np.linalg.inv(tb) @ np.linalg.svd(np.array(rows))[2][-1].reshape(3, 3) @ ta
    return m / m[2, 2]


def project(m: np.ndarray, p: np.ndarray) -> np.ndarray:
    q = np.column_stack([p, np.ones(len(p))]) @ m.T
    return q[:, :2] / q[:, 2:]


def ransac(src: np.ndarray, dst: np.ndarray, reach: float = 3.0, rounds: int = 1500, seed: int = 1) -> tuple[np.ndarray | None, np.ndarray]:
    """The homography with the most inliers among seeded samples of four, refitted twice; and the inliers."""
    rng, best = np.random.default_rng(seed), np.zeros(len(src), bool)
    if len(src) < 4:
        return None, best
    off = lambda m: np.linalg.norm(project(m, src) - dst, axis=1)
    for _ in range(rounds):
        pick = rng.choice(len(src), 4, replace=False)
        try:
            with np.errstate(all="ignore"):
                good = off(homography(src[pick], dst[pick])) < reach
        except np.linalg.LinAlgError:
            continue
        if good.sum() > best.sum():
            best = good
    if best.sum() < 4:
        return None, best
    for _ in range(2):
        m = homography(src[best], dst[best])
        again = off(m) < reach
        best = again if again.sum() >= 4 else best
    return homography(src[best], dst[best]), best


def corners(grey: np.ndarray, cell: int = 20, least: float = 0.002) -> np.ndarray:
    """(x, y) of the strongest Harris corner of each cell, above a share of the strongest."""
    gy, gx = np.gradient(gauss_blur(grey, 1.0))
    xx, yy, xy = (box_blur(v, 2) for v in (gx * gx, gy * gy, gx * gy))
    r = xx * yy - xy * xy - 0.04 * (xx + yy) ** 2
    out = []
    for y in range(0, r.shape[0], cell):
        for x in range(0, r.shape[1], cell):
            part = r[y : y + cell, x : x + cell]
            j, i = np.unravel_index(part.argmax(), part.shape)
            if part[j, i] > least * r.max():
                out.append((x + i, y + j))
    return np.array(out, float).reshape(-1, 2)


def focal_of(m: np.ndarray) -> float | None:
    """Focal length from a rotation's homography, about the image centre (Szeliski)."""
    h = m.ravel()
    d1, d2 = h[6] * h[7], (h[7] - h[6]) * (h[7] + h[6])
    with np.errstate(all="ignore"):
        v1, v2 = -(h[0] * h[1] + h[3] * h[4]) / d1, (h[0] ** 2 + h[3] ** 2 - h[1] ** 2 - h[4] ** 2) / d2
    good = [v for v in (v1, v2) if np.isfinite(v) and v > 0]
    return float(np.sqrt(max(good))) if good else None


def stitch(images: list[np.ndarray], maps: list[np.ndarray]) -> np.ndarray:
    """Images under maps to a common plane, gains matched on overlaps, feather-blended; NaN where nothing is."""
    boxes = [project(m, np.array([[0, 0], [a.shape[1], 0], [a.shape[1], a.shape[0]], [0, a.shape[0]]], float)) for a, m in zip(images, maps, strict=True)]
    low, high = np.floor(np.min(np.concatenate(boxes), axis=0)), np.ceil(np.max(np.concatenate(boxes), axis=0))
    w, h = (high - low).astype(int)
    yy, xx = np.mgrid[:h, :w]
    total, weight = np.zeros((h, w, 3)), np.zeros((h, w, 1))
    for a, m in zip(images, maps, strict=True):
        p = project(np.linalg.inv(m), np.column_stack([xx.ravel() + low[0], yy.ravel() + low[1]])).reshape(h, w, 2)
        x, y = p[..., 0], p[..., 1]
        inside = (x >= 0) & (y >= 0) & (x <= a.shape[1] - 1) & (y <= a.shape[0] - 1)
        feather = np.minimum.reduce([x + 1, y + 1, a.shape[1] - x, a.shape[0] - y]) * inside
        value = bilinear(a, x, y)
        both = inside & (weight[..., 0] > 0)
        gain = (total[both] / weight[both]).mean() / max(value[both].mean(), 1e-6) if both.any() else 1.0
        total += value * gain * feather[..., None]
        weight += feather[..., None]
    return np.where(weight > 0, total / np.maximum(weight, 1e-12), np.nan)


def shift(reference: np.ndarray, image: np.ndarray, levels: int = 3, reach: int = 4) -> tuple[int, int]:
    """(dx, dy) that lays an image on the reference: least absolute differences, from coarse to fine."""
    dx = dy = 0
    for level in range(levels - 1, -1, -1):
        a, b = (downsample(x, 2**level) for x in (reference, image))
        dx, dy = dx * 2, dy * 2
        best = None
        for j in range(dy - reach, dy + reach + 1):
            for i in range(dx - reach, dx + reach + 1):
                y0, y1, x0, x1 = max(0, j), min(a.shape[0], a.shape[0] + j), max(0, i), min(a.shape[1], a.shape[1] + i)
                if y1 - y0 > 4 and x1 - x0 > 4:
                    cost = np.abs(a[y0:y1, x0:x1] - b[y0 - j : y1 - j, x0 - i : x1 - i]).mean()
                    if best is None or cost < best[0]:
                        best = (cost, i, j)
        if best:
            dx, dy = best[1:]
    return dx, dy


def merged(images: list[np.ndarray], exposures: list[float], ghost: float = 0.3) -> np.ndarray:
    """One linear image from exposures: weights fall towards clipping and where an image departs from the reference."""
    scaled = [a / e for a, e in zip(images, exposures, strict=True)]
    ref = luma(scaled[len(scaled) // 2])
    total, weight = np.zeros_like(scaled[0]), np.zeros((*ref.shape, 1))
    for raw, a in zip(images, scaled, strict=True):
        y = luma(raw)
        w = np.clip(1 - np.abs(2 * np.clip(y, 0, 1) - 1) ** 4, 0, 1) * np.exp(-(((luma(a) - ref) / (ghost * np.maximum(ref, 1e-3))) ** 2))
        total += a * w[..., None]
        weight += w[..., None]
    return np.where(weight > 1e-6, total / np.maximum(weight, 1e-6), scaled[int(np.argmin(exposures))])


def straighten(grey: np.ndarray, most: float = 15.0) -> float:
    """The tilt (degrees) of near-level and near-upright edges, by a smoothed histogram of strong gradients."""
    gy, gx = np.gradient(gauss_blur(grey, 2.0))
    m, angle = np.hypot(gx, gy), np.degrees(np.arctan2(gy, gx))
    tilt = (angle + 45) % 90 - 45
    keep = (m > np.quantile(m, 0.9)) & (np.abs(tilt) <= most)
    hist, edges = np.histogram(tilt[keep], bins=int(most * 20), range=(-most, most), weights=m[keep])
    smooth = np.convolve(hist, np.hanning(9), "same")
    return float(edges[smooth.argmax()] + (edges[1] - edges[0]) / 2) if smooth.max() > 0 else 0.0


def similarity_crop(a: np.ndarray, points: np.ndarray, target: np.ndarray, size: int) -> np.ndarray:
    """The crop under the least-squares similarity from landmarks to their places, as complex numbers."""
    p, q = points @ [1, 1j], target @ [1, 1j]
    k = ((p - p.mean()).conj() @ (q - q.mean())) / max(np.abs(p - p.mean()) @ np.abs(p - p.mean()), 1e-12)
    y, x = np.mgrid[:size, :size]
    z = (x + 1j * y - q.mean()) / k + p.mean()
    return bilinear(a, z.real, z.imag)


def best_offset(a: np.ndarray, box: tuple[int, int, int, int], offsets: list[tuple[int, int]]) -> tuple[int, int]:
    """The offset whose patch's rim differs least from the rim of the box, among those inside the image."""
    x0, y0, x1, y1 = box
    rim = np.ones((y1 - y0, x1 - x0), bool)
    rim[2:-2, 2:-2] = False
    here, cost = a[y0:y1, x0:x1][rim], {}
    for dx, dy in offsets:
        if 0 <= x0 + dx and 0 <= y0 + dy and x1 + dx <= a.shape[1] and y1 + dy <= a.shape[0]:
            cost[dx, dy] = float(((a[y0 + dy : y1 + dy, x0 + dx : x1 + dx][rim] - here) ** 2).mean())
    return min(cost, key=lambda k: (cost[k], k)) if cost else (0, 0)
