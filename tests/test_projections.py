"""All pairs of projections against numpy, rotated, with several samples a pixel; hot tiles and seams of tiles."""

import itertools
import math

import numpy as np
import pytest

from framelake.operators import compose

NAMES = ("mirrorball", "angular", "cylindrical", "polar")
RGB = ["r", "g", "b"]


def frame(spark, im, frame_id=1):
    h, w = im.shape[:2]
    return [(frame_id, x, y, *map(float, im[y, x])) for y in range(h) for x in range(w)]


def table(spark, rows):
    return spark.createDataFrame(rows, "frame_id bigint, x int, y int, r double, g double, b double")


def seen_from(name, u, v, angle):
    """Unit vectors (right, up, behind the axis) of places of a panorama."""
    if name in ("mirrorball", "angular"):
        a, b = 2 * u - 1, 2 * v - 1
        if name == "angular":
            a, b = a * angle / 360, b * angle / 360
        far, phi = np.hypot(a, b), np.arctan2(b, a)
        theta = 2 * np.arcsin(np.minimum(far, 1)) if name == "mirrorball" else np.pi * far
        return np.stack([np.cos(phi) * np.sin(theta), -np.sin(phi) * np.sin(theta), np.cos(theta)], -1)
    phi = 2 * np.pi * (0.75 - u)
    height = 1 - 2 * v if name == "cylindrical" else np.cos(np.pi * v)
    ring = np.sqrt(np.maximum(0, 1 - height**2)) if name == "cylindrical" else np.sin(np.pi * v)
    return np.stack([np.cos(phi) * ring, height, np.sin(phi) * ring], -1)


def place_of(name, d):
    x, y, z = d[..., 0], d[..., 1], d[..., 2]
    if name in ("mirrorball", "angular"):
        theta = np.arccos(np.clip(z, -1, 1))
        reach = 0.5 * np.sin(theta / 2) if name == "mirrorball" else theta / (2 * np.pi)
        far = np.hypot(x, y)
        with np.errstate(all="ignore"):
            return np.where(far > 0, x * reach / far + 0.5, 0.5), np.where(far > 0, -y * reach / far + 0.5, 0.5)
    lat = np.arccos(np.clip(y, -1, 1))
    v = (1 - y) / 2 if name == "cylindrical" else lat / np.pi
    with np.errstate(all="ignore"):
        lon = np.arccos(np.clip(-z / np.sin(lat), -1, 1)) / (2 * np.pi)
    u = np.where(x < 0, lon, 1 - lon)
    pole = (v < 1e-7) | (np.abs(1 - v) < 1e-7)
    return np.where(pole | (u == 1), 0.0, u), np.where(~pole & (v == 1), 0.0, v)


def turn(degrees):
    """The matrix of three turns about x, y and z, each backwards."""
    out = np.eye(3)
    for axis, angle in enumerate(degrees):
        c, s = math.cos(math.radians(-angle)), math.sin(math.radians(-angle))
        out = np.array([[[1, 0, 0], [0, c, -s], [0, s, c]], [[c, 0, s], [0, 1, 0], [-s, 0, c]], [[c, -s, 0], [s, c, 0], [0, 0, 1]]][axis]) @ out
    return out


def projected(im, src, dst, xsize, rotation, oversample, interpolate, angle=360.0):
    h, w = im.shape[:2]
    ysize = xsize // compose.PROJECTIONS[dst]
    out = np.zeros((ysize, xsize, 3))
    py, px = np.mgrid[0:ysize, 0:xsize]
    for j, i in itertools.product(range(oversample), repeat=2):
        u, v = (px + (i + 0.5) / oversample) / xsize, (py + (j + 0.5) / oversample) / ysize if compose.PROJECTIONS[dst] == 1 else (py + (j + 0.5) / oversample) / ysize
        su, sv = place_of(src, seen_from(dst, u, v, angle) @ turn(rotation).T)
        sx, sy = su * w, sv * h
        if interpolate:
            x, y = np.floor(sx).astype(int), np.floor(sy).astype(int)
            fx, fy = (sx - x)[..., None], (sy - y)[..., None]
            at = lambda a, b: im[np.minimum(b, h - 1), np.minimum(a, w - 1)]
            out += (at(x, y) * (1 - fx) + at(x + 1, y) * fx) * (1 - fy) + (at(x, y + 1) * (1 - fx) + at(x + 1, y + 1) * fx) * fy
        else:
            out += im[np.minimum(np.floor(sy + 0.5).astype(int), h - 1), np.minimum(np.floor(sx + 0.5).astype(int), w - 1)]
    if compose.PROJECTIONS[dst] == 1:
        out[((px + 0.5) / xsize - 0.5) ** 2 + ((py + 0.5) / xsize - 0.5) ** 2 > 0.25] = 0
    return out / oversample**2


def got_of(df, shape):
    out = np.full(shape, np.nan)
    rows = df.toPandas()
    out[rows.y.to_numpy(int), rows.x.to_numpy(int)] = rows[RGB].to_numpy()
    return out


@pytest.mark.parametrize("src,dst", list(itertools.product(NAMES, NAMES)))
def test_every_pair(spark, src, dst):
    rng = np.random.default_rng(len(src) * 100 + len(dst))
    w = 90
    im = rng.uniform(0, 5, (w // compose.PROJECTIONS[src], w, 3))
    got = got_of(compose.project(table(spark, frame(spark, im)), src, dst, 30, (11.0, 23.0, 37.0), 2), (30 // compose.PROJECTIONS[dst], 30, 3))
    np.testing.assert_allclose(got, projected(im, src, dst, 30, (11.0, 23.0, 37.0), 2, True), atol=1e-6)


def test_nearest_and_names(spark):
    rng = np.random.default_rng(1)
    im = rng.uniform(0, 5, (40, 80, 3))
    got = got_of(compose.project(table(spark, frame(spark, im)), "Polar", "ANGULAR", 24, (3.0, 5.0, 7.0), 1, False, 180.0), (24, 24, 3))
    np.testing.assert_allclose(got, projected(im, "polar", "angular", 24, (3.0, 5.0, 7.0), 1, False, 180.0), atol=1e-6)


@pytest.mark.parametrize("tile,block", [(7, 5), (64, 256), (13, 1000)])
def test_tiles_do_not_show(spark, monkeypatch, tile, block):
    """Frames larger than a tile, a target larger than a block; two frames of different sizes."""
    monkeypatch.setattr(compose, "SOURCE_TILE", tile)
    monkeypatch.setattr(compose, "TARGET_BLOCK", block)
    rng = np.random.default_rng(tile)
    images = {1: rng.uniform(0, 5, (33, 66, 3)), 2: rng.uniform(0, 5, (10, 20, 3))}
    out = compose.project(table(spark, [r for k, im in images.items() for r in frame(spark, im, k)]), "polar", "mirrorball", 40, (0.0, 20.0, 10.0), 2)
    for k, im in images.items():
        np.testing.assert_allclose(got_of(out.where(f"frame_id = {k}"), (40, 40, 3)), projected(im, "polar", "mirrorball", 40, (0.0, 20.0, 10.0), 2, True), atol=1e-6)
