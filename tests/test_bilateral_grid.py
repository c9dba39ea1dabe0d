"""The bilateral grid against the direct filter, and Durand's mapper by way of both."""

import math

import numpy as np
import pytest

from framelake.operators import stencils


def direct(im, sigma_s, sigma_r):
    half, out = (int(sigma_s * 4 + 0.5) + 1) // 2, np.zeros_like(im)
    ys, xs = np.mgrid[0 : im.shape[0], 0 : im.shape[1]]
    for y in range(im.shape[0]):
        for x in range(im.shape[1]):
            at = np.s_[max(0, y - half) : y + half, max(0, x - half) : x + half]
            far = im[at] - im[y, x]
            k = np.exp(-((ys[at] - y) ** 2 + (xs[at] - x) ** 2) / (2 * sigma_s**2) - far**2 / (2 * sigma_r**2)) * (np.abs(far) <= math.sqrt(-2 * math.log(0.01)) * sigma_r)
            out[y, x] = (k * im[at]).sum() / k.sum()
    return out


def frame(spark, im):
    h, w = im.shape
    return spark.createDataFrame([(1, x, y, float(im[y, x])) for y in range(h) for x in range(w)], "frame_id bigint, x int, y int, v double")


def plane(rows, shape):
    out = np.full(shape, np.nan)
    for r in rows:
        out[r["y"], r["x"]] = r["value"]
    return out


@pytest.mark.parametrize("sigma_s", [4.0, 9.0])
def test_grid_is_near_the_direct_filter(spark, sigma_s):
    """Edges, slopes and noise: within 1 % of the range everywhere, a tenth of that on average."""
    rng = np.random.default_rng(0)
    ys, xs = np.mgrid[0:70, 0:90]
    im = np.sin(xs / 17) + np.cos(ys / 11) + 2.0 * (xs + ys > 80) + 1.5 * (xs > 60) + rng.normal(0, 0.15, xs.shape)
    want = direct(im, sigma_s, 0.4)
    got = plane(stencils.bilateral_grid(frame(spark, im), "v", sigma_s, 0.4).collect(), im.shape)
    assert np.abs(got - want).max() < 0.01 * np.ptp(want) and np.abs(got - want).mean() < 0.001 * np.ptp(want)


def test_flat_frames_and_single_pixels(spark):
    df = frame(spark, np.full((5, 7), -2.5)).unionByName(spark.createDataFrame([(2, 0, 0, 4.0)], "frame_id bigint, x int, y int, v double"))
    got = stencils.bilateral_grid(df, "v", 40.0, 0.4).collect()
    assert len(got) == 36 and all(abs(r["value"] - (4.0 if r["frame_id"] == 2 else -2.5)) < 1e-9 for r in got)
    assert stencils.bilateral_grid(df.limit(0), "v", 40.0, 0.4).count() == 0


def test_durand_by_grid_and_directly(spark, monkeypatch):
    """The mapper's colours by the grid differ little from those by the direct filter."""
    rng = np.random.default_rng(2)
    rows = [(1, x, y, *(np.exp(np.sin(x / 9) + 2.0 * (x + y > 40)) * rng.uniform(0.9, 1.1, 3)).tolist()) for y in range(36) for x in range(40)]
    df = spark.createDataFrame(rows, "frame_id bigint, x int, y int, r double, g double, b double")
    grid = stencils.tm_durand(df, 6.0).toPandas().sort_values(["y", "x"])[list("rgb")].to_numpy()
    monkeypatch.setattr(stencils, "GRID_FROM", 1e9)
    plain = stencils.tm_durand(df, 6.0).toPandas().sort_values(["y", "x"])[list("rgb")].to_numpy()
    assert np.abs(grid - plain).max() < 0.05 * np.ptp(plain) and np.abs(grid - plain).mean() < 0.01 * np.ptp(plain)
