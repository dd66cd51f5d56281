"""Kernels: invariants, inverses, and the direction each control moves an image."""

import numpy as np
import pytest

from fotolake.dense import develop, masks, tiles
from fotolake.dense.filters import bilinear, border, box_blur, box_mean, composite, defringe, downsample, gauss_blur, guided, guided_self, lanczos, level_for, luma, lut3d, membrane, monotone_spline, noise, oriented, red_eye, redact, upsample
from fotolake.dense.geometry import Frame, corners, cropped_dims, homography, merged, project, ransac, shift, similarity_crop, stitch, straighten

RNG = np.random.default_rng(0)
CHART = np.clip(np.add.outer(np.linspace(0.05, 0.6, 96), np.linspace(0, 0.3, 128))[..., None] * [1, 0.8, 0.6] + RNG.random((96, 128, 3)) * 0.02, 0, 1)


def test_blurs_keep_constants_and_steps():
    flat = np.full((40, 70), 0.3)
    for f in (lambda a: box_blur(a, 5), lambda a: gauss_blur(a, 2), lambda a: gauss_blur(a, 9), lambda a: box_mean(a, 3), lambda a: guided_self(a, 4, 0.01, 2)):
        assert np.allclose(f(flat), 0.3)
    a = RNG.random((9, 11))
    p = np.pad(a, 2, mode="edge")
    assert np.allclose(box_blur(a, 2), [[p[y : y + 5, x : x + 5].mean() for x in range(11)] for y in range(9)])
    step = np.repeat([[0.0] * 20 + [1.0] * 20], 30, 0)
    assert np.abs(guided_self(step, 4, 1e-4) - step).max() < 0.02 < np.abs(box_blur(step, 4) - step).max()
    assert np.abs(guided(step, step, 4, 1e-4) - step).max() < 0.02


def test_resampling():
    a = RNG.random((7, 10, 3))
    d = downsample(a, 3)
    assert d.shape == (3, 4, 3) and np.allclose(d[2, 3], a[6:, 9:].mean((0, 1)))
    assert np.allclose(upsample(np.full((3, 3), 2.0), 8, 9), 2) and np.allclose(bilinear(a, np.array([3.0]), np.array([2.0])), a[2, 3])
    assert np.allclose(lanczos(np.full((9, 9, 3), 0.4), 5, 4), 0.4) and lanczos(CHART, 40, 50).shape == (40, 50, 3)
    assert (level_for(4000, 3000, 1000, 700, 6), level_for(400, 300, 1000, 700, 6)) == (2, 0)
    for k in range(1, 9):
        assert oriented(a, k).size == a.size
    assert np.array_equal(oriented(oriented(a, 6), 8), a) and np.array_equal(oriented(oriented(a, 5), 5), a)


def test_spline_lut_noise():
    xs, ys = np.array([0, 0.2, 0.5, 1]), np.array([0, 0.5, 0.5, 1])
    at = monotone_spline(xs, ys, np.linspace(0, 1, 200))
    assert (np.diff(at) >= -1e-12).all() and np.allclose(monotone_spline(xs, ys, xs), ys)
    g = np.linspace(0, 1, 5)
    cube = np.stack(np.meshgrid(g, g, g, indexing="ij"), -1)
    assert np.allclose(lut3d(CHART, cube), CHART)
    n = noise(*np.meshgrid(np.linspace(0, 9, 50), np.linspace(0, 9, 50)), 3)
    assert 0 <= n.min() and n.max() <= 1 and n.std() > 0.1


def test_local_repairs():
    a = np.linspace(0, 1, 20)[None, :].repeat(20, 0)
    hole = np.zeros((20, 20), bool)
    hole[6:14, 6:14] = True
    assert np.abs(membrane(np.where(hole, 9.0, a), hole) - a).max() < 1e-3
    eye = np.zeros((30, 30, 3)) + [0.7, 0.1, 0.1]
    fixed = red_eye(eye, 15, 15, 8)
    assert fixed[15, 15, 0] < 0.2 and np.allclose(fixed[0, 0], eye[0, 0])
    r = redact(CHART, (10, 10, 42, 42), "mosaic", 16)
    assert np.allclose(r[10:26, 10:26], r[10, 10]) and np.allclose(r[50:], CHART[50:])
    assert (redact(CHART, (0, 0, 20, 20), "fill", ellipse=True)[10, 10] == 0).all()
    assert border(CHART, 4, (1, 0, 0)).shape == (104, 136, 3)
    layer = np.concatenate([np.full((4, 4, 3), 0.5), np.full((4, 4, 1), 0.5)], axis=-1)
    assert np.allclose(composite(np.zeros((8, 8, 3)), layer, 6, 6, 1.0)[7, 7], 0.5)
    fringe = np.full((40, 80, 3), 0.9)
    fringe[:, 40:] = [0.4, 0.1, 0.6]
    out = defringe(fringe, 1.0, develop.hue_of(fringe[:1, -1:])[0, 0])
    chroma = lambda v: v.max(-1) - v.min(-1)
    assert chroma(out)[20, 40] < chroma(fringe)[20, 40] and np.allclose(out[20, 75], fringe[20, 75], atol=1e-3)


def test_masks():
    lin = masks.linear((10, 10), 0, 0, 0, 1)
    assert lin[0, 0] == 0 and lin[-1, 0] == 1
    rad = masks.radial((21, 21), 0.5, 0.5, 0.3, 0.3, 0.5)
    assert rad[10, 10] == 1 and rad[0, 0] == 0
    assert masks.combined([("intersect", rad, True)], invert=True)[10, 10] == 1
    s = masks.strokes((30, 30), [{"points": [(5, 15), (25, 15)], "radius": 4}])
    assert s[15, 15] > 0.9 and s[2, 2] == 0 and masks.path_distance(np.array([0.0]), np.array([3.0]), np.array([[0, 0], [5, 0]]))[0] == 3


def test_masks_of_one_shape():
    lin, rad = masks.linear((21, 21), 0, 0, 0, 1), masks.radial((21, 21), 0.5, 0.5, 0.3, 0.3, 0.5)
    assert masks.combined([("add", lin, False), ("subtract", rad, False)])[10, 10] == 0
    assert np.allclose(masks.combined([("add", lin, False), ("intersect", rad, False)]), lin * rad)


@pytest.mark.parametrize("frame", [Frame(300, 200), Frame(300, 200, angle=4, scale=1.2, vertical=0.1, horizontal=-0.05), Frame(300, 200, turns=1, flip_h=True, distortion=0.05), Frame(300, 200, turns=3, angle=-7, flip_v=True)])
def test_frames_invert(frame):
    x, y = np.meshgrid(np.linspace(60, 140, 5), np.linspace(60, 140, 5))
    fx, fy = frame.to_frame(*frame.to_base(x, y))
    assert np.allclose(fx, x, atol=1e-4) and np.allclose(fy, y, atol=1e-4)
    crop = frame.constrained((0, 0, 1, 1))
    assert frame.inside(crop) and crop[2] > crop[0]
    assert cropped_dims(300, 200, (0, 0, 0.5, 0.5), 1) == (100, 150)


def test_homography_and_panorama():
    src = RNG.random((60, 2)) * 200
    m = np.array([[1.02, 0.03, 14], [-0.02, 0.98, 3], [1e-5, 2e-5, 1]])
    dst = project(m, src)
    assert np.allclose(homography(src, dst), m, atol=1e-6)
    dst[:20] += RNG.random((20, 2)) * 80 + 10
    found, good = ransac(src, dst, rounds=300)
    assert good.sum() == 40 and np.allclose(found, m, atol=1e-5)
    whole = np.clip(RNG.random((60, 120, 3)), 0, 1)
    move = np.array([[1.0, 0, 50], [0, 1, 0], [0, 0, 1]])
    pano = stitch([whole[:, :70], whole[:, 50:] * 0.5], [np.eye(3), move])
    assert np.abs(pano[5:55, 5:115] - whole[5:55, 5:115]).max() < 0.05
    assert len(corners(luma(whole))) > 5


def test_alignment_merge_and_tilt():
    grey = gauss_blur(RNG.random((96, 96)), 2)
    assert shift(grey, np.roll(grey, (-5, 3), (0, 1))) == (-3, 5)
    scene = CHART * 1.5
    shots = [np.clip(scene * e, 0, 1) for e in (0.25, 0.5, 1.0)]
    assert np.abs(merged(shots, [0.25, 0.5, 1.0]) - scene).max() < 0.05
    y, x = np.mgrid[:120, :120]
    lines = np.sin((y + x * np.tan(np.radians(5))) / 3)
    assert abs(abs(straighten(lines)) - 5) < 1
    face = similarity_crop(CHART, np.array([[20.0, 20], [60, 20], [40, 60]]), np.array([[5.0, 5], [25, 5], [15, 25]]), 32)
    assert np.allclose(face[5, 5], CHART[20, 20], atol=0.05)


DIRECTIONS = {
    "exposure": (0.5, lambda a: luma(a).mean()),
    "temp": (0.5, lambda a: (a[..., 0] - a[..., 2]).mean()),
    "tint": (0.3, lambda a: -(a[..., 1] - (a[..., 0] + a[..., 2]) / 2).mean()),
    "contrast": (0.8, lambda a: luma(a).std()),
    "shadows": (0.8, lambda a: np.quantile(luma(a), 0.1)),
    "highlights": (0.8, lambda a: np.quantile(luma(a), 0.9)),
    "whites": (0.8, lambda a: np.quantile(luma(a), 0.95)),
    "blacks": (0.8, lambda a: np.quantile(luma(a), 0.05)),
    "saturation": (0.5, lambda a: (a.max(-1) - a.min(-1)).mean()),
    "vibrance": (0.5, lambda a: (a.max(-1) - a.min(-1)).mean()),
    "clarity": (0.8, lambda a: np.abs(luma(a) - box_blur(luma(a), 8)).mean()),
    "sharpen": (1.0, lambda a: np.abs(np.diff(luma(a), axis=1)).mean()),
    "grain": (0.2, lambda a: np.abs(np.diff(luma(a), axis=1)).mean()),
    "vignette": (0.5, lambda a: luma(a)[:10, :10].mean()),
}


@pytest.mark.parametrize("name", DIRECTIONS)
def test_directions(name):
    amount, measure = DIRECTIONS[name]
    low, mid, high = (measure(develop.render(CHART, {name: v})) for v in ((0 if name in ("sharpen", "grain") else -amount), 0, amount))
    assert high > mid and (low < mid or name in ("sharpen", "grain"))


def test_neutral_and_nan():
    assert np.abs(develop.render(CHART, {}) - develop.encode(CHART)).max() < 2 / 255
    holed = CHART.copy()
    holed[3, 4] = np.nan
    out = develop.render(holed, {"exposure": 1})
    assert np.isnan(out[3, 4]).all() and np.isnan(out).sum() == 3
    h = develop.histogram(out)
    assert h.shape == (4, 256) and (h.sum(axis=1) == 96 * 128 - 1).all()
    hsl = np.zeros((8, 3))
    hsl[:, 0] = 120
    assert not np.allclose(develop.render(CHART, {"hsl": hsl}), develop.render(CHART, {}))
    local = develop.render(CHART, {"mask": lambda shape, row: masks.linear(shape, 0, 0, 1, 0), "local": {"exposure": 1.0}})
    assert luma(local)[:, -5:].mean() > luma(develop.render(CHART, {}))[:, -5:].mean() and np.allclose(local[:, 0], develop.render(CHART, {})[:, 0])


def test_tiles_agree_with_the_whole(spark):
    rows = tiles.cut(1, CHART, tile=40, halo=12)
    df = spark.createDataFrame(rows, tiles.SCHEMA).repartition(3)
    s = {"exposure": 0.3, "sharpen": 0.5, "vignette": -0.3, "grain": 0.1}
    got = tiles.joined(tiles.mapped(df, lambda a, row: develop.render(a, s, row)).collect(), 40)
    assert np.abs(got - develop.render(CHART, s)).max() < 0.01
