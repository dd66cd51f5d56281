"""RGB spaces: matrices from primaries, conversions as columns, matrix profiles as bytes (ICC version 2)."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import Column

from fotolake.functions.color import apply_matrix

#: Published primaries and white (xy), and the transfer's power (None: sRGB's curve).
SPACES = {
    "srgb": (((0.64, 0.33), (0.30, 0.60), (0.15, 0.06)), (0.3127, 0.3290), None),
    "display_p3": (((0.680, 0.320), (0.265, 0.690), (0.150, 0.060)), (0.3127, 0.3290), None),
    "adobe_rgb": (((0.64, 0.33), (0.21, 0.71), (0.15, 0.06)), (0.3127, 0.3290), 563 / 256),
    "rec2020": (((0.708, 0.292), (0.170, 0.797), (0.131, 0.046)), (0.3127, 0.3290), 2.4),
}
#: Bradford's cone responses, and the profile connection space's white.
BRADFORD = np.array([[0.8951, 0.2664, -0.1614], [-0.7502, 1.7135, 0.0367], [0.0389, -0.0685, 1.0296]])
D50 = np.array([0.9642, 1.0, 0.8249])


def xyz(x: float, y: float) -> np.ndarray:
    return np.array([x / y, 1.0, (1 - x - y) / y])


def to_xyz(space: str) -> np.ndarray:
    """The matrix from a space's linear values to XYZ under its white."""
    primaries, white, _ = SPACES[space]
    m = np.column_stack([xyz(*p) for p in primaries])
    return m * np.linalg.solve(m, xyz(*white))


def between(source: str, target: str) -> np.ndarray:
    return np.linalg.inv(to_xyz(target)) @ to_xyz(source)


def convert(source: str, target: str, r: Column, g: Column, b: Column) -> tuple[Column, ...]:
    """Linear values in another space; values outside it stay outside."""
    return apply_matrix([[float(v) for v in row] for row in between(source, target)], r, g, b)


def adapted(space: str) -> np.ndarray:
    """Columns of red, green and blue under D50, by Bradford's adaptation."""
    white = xyz(*SPACES[space][1])
    gain = np.diag((BRADFORD @ D50) / (BRADFORD @ white))
    return np.linalg.inv(BRADFORD) @ gain @ BRADFORD @ to_xyz(space)


def _fixed(v: float) -> bytes:
    return struct.pack(">i", round(v * 65536))


def profile(space: str, name: str) -> bytes:
    """A display profile: description, copyright, white, three colorants, one transfer curve."""
    power = SPACES[space][2]
    if power is None:
        x = np.linspace(0, 1, 1024)
        values = np.where(x <= 0.04045, x / 12.92, ((x + 0.055) / 1.055) ** 2.4)
        curve = b"curv\0\0\0\0" + struct.pack(">I", 1024) + b"".join(struct.pack(">H", round(v * 65535)) for v in values)
    else:
        curve = b"curv\0\0\0\0" + struct.pack(">IH", 1, round(power * 256))
    text = name.encode("ascii", "replace")
    desc = b"desc\0\0\0\0" + struct.pack(">I", len(text) + 1) + text + b"\0" + b"\0" * 78
    point = lambda v: b"XYZ \0\0\0\0" + b"".join(map(_fixed, v))
    m = adapted(space)
    blocks = [(b"desc", desc), (b"cprt", b"text\0\0\0\0No copyright\0"), (b"wtpt", point(D50)), (b"rXYZ", point(m[:, 0])), (b"gXYZ", point(m[:, 1])), (b"bXYZ", point(m[:, 2])), (b"rTRC", curve)]
    at, table, data = 128 + 4 + 12 * (len(blocks) + 2), b"", b""
    for tag, block in blocks:
        block += b"\0" * (-len(block) % 4)
        for t in (tag, *((b"gTRC", b"bTRC") if tag == b"rTRC" else ())):
            table += t + struct.pack(">II", at + len(data), len(block))
        data += block
    body = struct.pack(">I", len(blocks) + 2) + table + data
    head = struct.pack(">I", 128 + len(body)) + b"\0\0\0\0" + struct.pack(">I", 0x02400000) + b"mntrRGB XYZ " + struct.pack(">6H", 2024, 1, 1, 0, 0, 0) + b"acsp" + b"\0" * 28 + b"".join(map(_fixed, D50))
    return head.ljust(128, b"\0") + body
