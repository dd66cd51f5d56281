"""Tables of tiles: images cut with a halo, kernels run tile by tile, tiles put together.

A tile row is (image, tx, ty, x, y, w, h, halo_l, halo_t, full_w, full_h, data): w by h pixels of three channels with their
halo, so a kernel of a reach up to the halo needs no neighbour and a task holds one tile at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "image long, tx int, ty int, x int, y int, w int, h int, halo_l int, halo_t int, full_w int, full_h int, data array<float>"


def cut(image: int, a: np.ndarray, tile: int = 512, halo: int = 32) -> list[tuple]:
    """Tile rows of one image."""
    h, w = a.shape[:2]
    rows = []
    for y in range(0, h, tile):
        for x in range(0, w, tile):
            x0, y0, x1, y1 = max(0, x - halo), max(0, y - halo), min(w, x + tile + halo), min(h, y + tile + halo)
            part = np.asarray(a[y0:y1, x0:x1], np.float32)
            rows.append((image, x // tile, y // tile, x, y, x1 - x0, y1 - y0, x - x0, y - y0, w, h, part.ravel().tolist()))
    return rows


def mapped(tiles: DataFrame, kernel: Callable[[np.ndarray, dict], np.ndarray]) -> DataFrame:
    """Each tile under `kernel(pixels, row)`, which returns pixels of the same size."""
    names = [p.split()[0] for p in SCHEMA.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            pdf = pdf[names].copy()
            pdf["data"] = [np.asarray(kernel(np.asarray(r.data, np.float64).reshape(r.h, r.w, 3), r._asdict()), np.float32).ravel() for r in pdf.itertuples(index=False)]
            yield pdf

    return tiles.mapInPandas(run, SCHEMA)


def joined(rows: list, tile: int = 512) -> np.ndarray:
    """One image from its tile rows, halos cut off."""
    out = np.empty((rows[0].full_h, rows[0].full_w, 3))
    for r in rows:
        a = np.asarray(r.data).reshape(r.h, r.w, 3)
        h, w = min(tile, r.full_h - r.y), min(tile, r.full_w - r.x)
        out[r.y : r.y + h, r.x : r.x + w] = a[r.halo_t : r.halo_t + h, r.halo_l : r.halo_l + w]
    return out
