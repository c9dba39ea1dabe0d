"""Operators of a whole neighbourhood: frames are cut into tiles with a margin, so a task holds a tile and never a frame.

Only pixels within the margin of a tile's edge are copied to the tiles next to it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import color
from . import levels
from .groups import in_groups, lines_of
from .pixels import RGB
from .stats import luminance, with_stats
from .tonemap import TONE_MAPPERS

TILE = 64


def dealt_tiles(df: DataFrame, col: str, margin: int, side: int, also: tuple[str, ...] = ()) -> DataFrame:
    """(frame_id, tx, ty, x, y, value, also): every pixel in the tile of `side` that it lies in, and in those that have it in their margin."""
    reach = lambda c: F.sequence(F.floor((F.col(c) - margin) / side), F.floor((F.col(c) + margin) / side))
    return df.select("frame_id", "x", "y", F.col(col).cast("double").alias("value"), *also, F.explode(reach("x")).alias("tx")).select("*", F.explode(reach("y")).alias("ty"))


def window_of(part, margin: int, side: int) -> tuple[np.ndarray, int, int]:
    """A tile with its margin as an array, NaN outside the frame, and the place of its first line and column."""
    x0, y0, n = int(part["tx"].iat[0]) * side - margin, int(part["ty"].iat[0]) * side - margin, side + 2 * margin
    grid = np.full((n, n), np.nan)
    grid[part["y"].to_numpy() - y0, part["x"].to_numpy() - x0] = part["value"].to_numpy()
    return grid, y0, x0


def tiled(df: DataFrame, col: str, margin: int, kernel: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], tile: int = TILE, also: tuple[str, ...] = ()) -> DataFrame:
    """(frame_id, x, y, also, value): kernel(values, ys, xs) of each tile with its margin, kept where the tile itself lies, beside the pixel's own columns `also` (doubles).
    The window ends where the frame does; what a frame lacks is NaN."""
    side = max(tile, margin)

    def values_of(x, y, values):
        x0, y0 = x.min(), y.min()
        grid = np.full((y.max() - y0 + 1, x.max() - x0 + 1), np.nan)
        grid[y - y0, x - x0] = values
        ys, xs = np.ogrid[y0 : y0 + grid.shape[0], x0 : x0 + grid.shape[1]]
        return kernel(grid, ys, xs)[y - y0, x - x0]

    return by_tiles(df, col, margin, side, values_of, also)


TILE_KEYS = ["frame_id", "tx", "ty"]


def by_tiles(df: DataFrame, col: str, margin: int, side: int, values_of: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], also: tuple[str, ...]) -> DataFrame:
    """(frame_id, x, y, also, value): values_of(x, y, value) of all pixels of a tile with its margin, sorted by y and x, for those in the tile itself that have a value."""

    def run(frame):
        x, y, tx, ty = (frame[c].to_numpy(np.int64) for c in ("x", "y", "tx", "ty"))
        values, first = frame["value"].to_numpy(float), lines_of(frame, TILE_KEYS)[0]
        out = np.empty(len(frame))
        for start, end in zip(first, [*first[1:], len(frame)], strict=True):
            out[start:end] = values_of(x[start:end], y[start:end], values[start:end])
        home = (x // side == tx) & (y // side == ty) & ~np.isnan(values)
        return frame.loc[home, ["frame_id", "x", "y", *also]].assign(value=out[home])

    kinds = "".join(f"{c} double, " for c in also)
    return in_groups(dealt_tiles(df, col, margin, side, also), TILE_KEYS, ["y", "x"], run, f"frame_id bigint, x int, y int, {kinds}value double")


def moved(grid: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """grid[y + dy, x + dx], NaN outside."""
    out = np.full_like(grid, np.nan)
    h, w = grid.shape
    out[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = grid[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)]
    return out


def local_adaptation(df: DataFrame, radius: int = 4) -> DataFrame:
    """(frame_id, x, y, value): mean of the luminance within a disc, weighted by exp(-(log5 of the ratio to the centre)^6). The first row and column of a frame have no
    part in it."""
    return disc_mean(luminance(df), radius)


def disc_mean(df: DataFrame, radius: int, also: tuple[str, ...] = ()) -> DataFrame:
    """local_adaptation of the column lum, beside the columns `also`."""

    def kernel(grid, ys, xs):
        with np.errstate(all="ignore"):
            usable = np.where((ys > 0) & (xs > 0), grid, np.nan)
            centre = np.log(grid) / math.log(5)
            padded, logs = (np.pad(a, radius, constant_values=np.nan) for a in (usable, np.log(usable) / math.log(5)))
            total, weight = np.zeros_like(grid), np.zeros_like(grid)
            h, w = grid.shape
            for dy in range(2 * radius + 1):
                for dx in range(2 * radius + 1):
                    if (dx - radius) ** 2 + (dy - radius) ** 2 <= radius * radius:
                        square = logs[dy : dy + h, dx : dx + w] - centre
                        square *= square
                        share = np.exp(-square * square * square)
                        there = ~np.isnan(share)
                        np.add(total, share * padded[dy : dy + h, dx : dx + w], out=total, where=there)
                        np.add(weight, share, out=weight, where=there)
            return np.where(weight > 0, total / weight, grid)

    return tiled(df, "lum", radius, kernel, also=also)


def tm_pattanaik_local(df: DataFrame, multiplier: float = 1.0) -> DataFrame:
    """Visual adaptation with cone and rod levels of each pixel's neighbourhood; the display model is the whole frame's."""
    lit = df.withColumn("lum", color.rgb_to_y(*[F.col(c) * multiplier for c in RGB])).withColumns({c: F.col(c).cast("double") for c in RGB})
    own = disc_mean(lit, 4, RGB).withColumnRenamed("value", "local")
    return levels.tm_pattanaik(own, multiplier, local="local", whole=df)


def bilateral(df: DataFrame, col: str, sigma_s: float, sigma_r: float, also: tuple[str, ...] = ()) -> DataFrame:
    """(frame_id, x, y, also, value): direct bilateral filter. The window reaches half a kernel of 4 sigma_s back and one less forward; ranges beyond a weight of 1 % do not count,
    the others have 256 steps."""
    half, two_s, two_r = (int(sigma_s * 4 + 0.5) + 1) // 2, 2 * sigma_s * sigma_s, 2 * sigma_r * sigma_r
    most = math.sqrt(-math.log(0.01) * two_r)
    table = np.exp(-((np.arange(256) / 255 * most) ** 2) / two_r)

    def kernel(grid, ys, xs):
        total, weight = np.zeros_like(grid), np.zeros_like(grid)
        for dy in range(-half, half):
            for dx in range(-half, half):
                near = moved(grid, dy, dx)
                far = np.abs(near - grid)
                there = far <= most
                w = math.exp(-(dx * dx + dy * dy) / two_s) * table[(far[there] * (255 / most)).astype(int)]
                total[there] += w * near[there]
                weight[there] += w
        with np.errstate(all="ignore"):
            return total / weight

    return tiled(df, col, half, kernel, also=also)


GRID_FROM = 4.0  # from this spatial sigma on, a base layer comes from the grid
PER_SIGMA = 3  # cells of the grid along a sigma


WIDEST_MARGIN = 256  # pixels around a tile; a grid that reaches further is blurred by aggregates over its cells
MOST_CELLS = 2_000_000  # of a tile's grid that are held at once


def bilateral_grid(df: DataFrame, col: str, sigma_s: float, sigma_r: float, per: int = PER_SIGMA, also: tuple[str, ...] = ()) -> DataFrame:
    """(frame_id, x, y, also, value): bilateral filter by way of a grid of cells in x, y and value, `per` of them along a sigma.

    Pixels are summed into their cells, cells are blurred along each axis by taps (as far as the direct filter's window and least weight reach), and a pixel
    takes its value between the eight cells around it. Tiles with a margin as wide as a cell reaches have all of this done in one place, after one shuffle; where that
    margin is over WIDEST_MARGIN, cells are far fewer than pixels and are aggregated and joined instead. On photographs the result is within 1 % of the range of
    values that the direct filter gives.
    """
    margin = math.ceil((2 * per + 1.5) * sigma_s / per) + 1
    if margin > WIDEST_MARGIN:
        return grid_by_joins(df, col, sigma_s, sigma_r, per, also)
    side = max(TILE, 4 * margin)

    def values_of(x, y, value):
        out, fine = np.full(len(value), np.nan), ~np.isnan(value)
        if fine.any():
            out[fine] = grid_values(x[fine], y[fine], value[fine], sigma_s / per, sigma_r / per, per)
        return out

    return by_tiles(df, col, margin, side, values_of, also)


def blur_weights(per: int) -> tuple[float, int, int]:
    """Twice the variance of the taps along an axis, less what the cells' width and the way between them add, and how far they reach in value and in x and y."""
    return 2 * (per * per - 0.25), math.ceil(per * math.sqrt(-2 * math.log(0.01))), 2 * per


def grid_values(x: np.ndarray, y: np.ndarray, value: np.ndarray, wide: float, high: float, per: int) -> np.ndarray:
    """The filtered values of pixels by a grid that holds them all. Cells of value lie side by side without those that nothing reaches, and are taken by slabs."""
    narrow, deep, reach = blur_weights(per)
    at = [x / wide, y / wide, value / high]
    cell, low = [np.floor(a + 0.5).astype(np.int64) for a in at], [np.floor(a).astype(np.int64) for a in at]
    part = [a - f for a, f in zip(at, low, strict=True)]
    known = np.unique(np.unique(cell[2])[:, None] + np.arange(-deep - 1, deep + 2))  # so taps never pass from one run of cells to the next
    cz, fz = np.searchsorted(known, cell[2]), np.searchsorted(known, low[2])
    spans, shape = [], []
    for c, f in zip(cell[:2], low[:2], strict=True):
        start, n = f.min(), max(f.max() + 1, c.max()) - f.min() + 1
        spans.append((c - start, f - start))
        d = np.subtract.outer(np.arange(n), np.arange(n))
        shape.append((n, np.where(abs(d) <= reach, np.exp(-d * d / narrow), 0.0)))
    (cx, fx), (cy, fy), (nx, blur_x), (ny, blur_y) = *spans, *shape
    out, step = np.empty(len(x)), max(2 * deep, MOST_CELLS // (nx * ny))
    taps = np.exp(-np.arange(-deep, deep + 1) ** 2 / narrow)
    for first in range(0, len(known), step):
        mine = slice(None) if step >= len(known) else np.flatnonzero((fz >= first) & (fz < first + step))
        near = slice(None) if step >= len(known) else np.flatnonzero((cz >= first - deep) & (cz <= first + step + deep))
        nz = min(step, len(known) - first) + 1
        place = ((cz[near] - first + deep) * ny + cy[near]) * nx + cx[near]
        whole = (nz + 2 * deep) * ny * nx
        cells = np.stack([np.bincount(place, weights, whole) for weights in (None, value[near])]).reshape(2, nz + 2 * deep, ny, nx)
        blurred = np.zeros((2, nz, ny, nx))
        for i, w in enumerate(taps):
            blurred += w * cells[:, i : i + nz]
        blurred = np.matmul(blur_y, blurred @ blur_x)
        total = np.zeros((2, len(fz[mine])))
        for m in range(8):
            i, j, k = m & 1, m >> 1 & 1, m >> 2
            share = (part[0][mine] if i else 1 - part[0][mine]) * (part[1][mine] if j else 1 - part[1][mine]) * (part[2][mine] if k else 1 - part[2][mine])
            total += share * blurred[:, fz[mine] - first + k, fy[mine] + j, fx[mine] + i]
        out[mine] = total[1] / total[0]
    return out


def grid_by_joins(df: DataFrame, col: str, sigma_s: float, sigma_r: float, per: int, also: tuple[str, ...]) -> DataFrame:
    """bilateral_grid with cells as rows: pixels are aggregated once and joined once with cells, whatever the sigmas."""
    wide, high = sigma_s / per, sigma_r / per
    axes = {"cx": F.col("x") / wide, "cy": F.col("y") / wide, "cz": F.col("value") / high}
    px = df.select("frame_id", "x", "y", *also, F.col(col).cast("double").alias("value"))
    cells = px.groupBy("frame_id", *[F.floor(c + 0.5).cast("int").alias(a) for a, c in axes.items()]).agg(F.count("*").cast("double").alias("n"), F.sum("value").alias("v"))
    narrow, deep, far = blur_weights(per)
    for axis, reach in (("cz", deep), ("cx", far), ("cy", far)):
        taps = F.explode(F.array(*[F.struct(F.lit(i).alias("d"), F.lit(math.exp(-i * i / narrow)).alias("w")) for i in range(-reach, reach + 1)]))
        moved = cells.select("*", taps.alias("t")).select("frame_id", *[(F.col(a) + F.col("t.d")).alias(a) if a == axis else F.col(a) for a in axes], *[(F.col(c) * F.col("t.w")).alias(c) for c in "nv"])
        cells = moved.where("cx >= 0 and cy >= 0").groupBy("frame_id", *axes).agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    corner = F.explode(F.array(*[F.struct(*[F.lit(m >> i & 1).alias(a) for i, a in enumerate(axes)], F.lit(m).alias("m")) for m in range(8)]))
    around = cells.select("*", corner.alias("k")).select("frame_id", *[(F.col(a) - F.col(f"k.{a}")).alias(a) for a in axes], "k.m", "n", "v")
    around = around.groupBy("frame_id", *axes).agg(*[F.coalesce(F.sum(F.when(F.col("m") == m, F.col(c))), F.lit(0.0)).alias(f"{c}{m}") for m in range(8) for c in "nv"])
    at = px.withColumns({a: F.floor(c).cast("int") for a, c in axes.items()} | {f"t{a}": c - F.floor(c) for a, c in axes.items()}).join(around, ["frame_id", *axes])

    def between(c: str):
        share = lambda m: math.prod((F.col(f"t{a}") if m >> i & 1 else 1 - F.col(f"t{a}") for i, a in enumerate(axes)), start=F.lit(1.0))
        return sum((share(m) * F.col(f"{c}{m}") for m in range(1, 8)), start=share(0) * F.col(f"{c}0"))

    return at.select("frame_id", "x", "y", *also, (between("v") / between("n")).alias("value"))


def base_layer(df: DataFrame, col: str, sigma_s: float, sigma_r: float, per: int = PER_SIGMA, also: tuple[str, ...] = ()) -> DataFrame:
    """(frame_id, x, y, also, value): the bilateral filter, directly for a small window, else by the grid."""
    return bilateral(df, col, sigma_s, sigma_r, also) if sigma_s < GRID_FROM else bilateral_grid(df, col, sigma_s, sigma_r, per, also)


def tm_durand(df: DataFrame, sigma_s: float = 40.0, sigma_r: float = 0.4, base: float = 5.0, per: int = PER_SIGMA) -> DataFrame:
    """Base and detail: the bilateral base of log intensity (base_layer) is compressed to `base`, colours are corrected by the compression, the result is sRGB."""
    light = df.withColumn("i", (20.0 * F.col("r") + 40.0 * F.col("g") + F.col("b")) / 61.0)
    least = light.groupBy("frame_id").agg(F.min(F.when(F.col("i") > 0, F.col("i"))).alias("least"))
    light = with_stats(light, least).withColumn("i", F.greatest("i", "least")).drop("least")
    light = light.withColumns({c: F.col(c) / F.col("i") for c in RGB}).withColumn("i", F.ln("i"))
    smooth = base_layer(light, "i", sigma_s, sigma_r, per).select("frame_id", F.col("value").alias("base")).repartition("frame_id")  # once, for all that percentiles read
    span = levels.percentiles(smooth, "base", 0.01, 0.99)
    k = base / (F.col("q_hi") - F.col("q_lo"))
    s = (1 + 1.48) * F.pow(k, F.lit(0.82)) / (1 + 1.48 * F.pow(k, F.lit(0.82)))
    # the base is made again beside the pixels' own columns: that costs less than to join it to them by pixel
    at = with_stats(light, span.select("frame_id", "q_lo", k.alias("k"), s.alias("s")))
    at = base_layer(at, "i", sigma_s, sigma_r, per, (*RGB, "i", "q_lo", "k", "s")).withColumnRenamed("value", "base")
    level = F.col("base") * (F.col("k") - 1) + F.col("i") - (4.3 + F.col("q_lo") * F.col("k"))
    return at.select("frame_id", "x", "y", *[color.linear_to_srgb(F.when(F.col(c) > 0, F.exp(F.col("s") * F.ln(c) + level)).otherwise(0.0)).alias(c) for c in RGB])


# Fixed values of the photoreceptor model.
K_BETA, A_C, C_BETA = 1.6e-4, 9e-2, 2.8e-3


def steady_state(drive):
    """The positive root of A_C x^5 + x^4 = drive by Newton's steps from above."""
    step = lambda x, _: x - (A_C * x * x * x * x * x + x * x * x * x - drive) / (5 * A_C * x * x * x * x + 4 * x * x * x)
    return F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.sqrt(F.sqrt(drive)), step)


def tm_vanhateren(df: DataFrame, pupil_area: float = 10.0) -> DataFrame:
    """Steady state of a photoreceptor after a gamma of 1.8. Luminance is that of the channels in the order g, r, b."""
    out = df.withColumns({c: color.gamma_curve(F.col(c), 1.8) for c in RGB}).withColumn("lum", color.rgb_to_y(F.col("g"), F.col("r"), F.col("b")))
    most = steady_state(F.lit(1 / C_BETA))
    out = out.withColumn("drive", 1 / (C_BETA + K_BETA * F.col("lum") * max(pupil_area, 0.0)))
    seen = 1 - steady_state(F.col("drive")) / most
    return out.withColumn("seen", F.when(F.col("lum") != 0, seen / F.col("lum")).otherwise(0.0)).select("frame_id", "x", "y", *[(F.col(c) * F.col("seen")).alias(c) for c in RGB])


TONE_MAPPERS.update(durand=tm_durand, pattanaik_local=tm_pattanaik_local, vanhateren=tm_vanhateren)
