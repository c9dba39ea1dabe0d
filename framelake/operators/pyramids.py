"""Pyramids of a frame, statistics of contrast by level, and the perceptual response of gradients."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .groups import in_groups, lines_of
from .luts import interpolate
from .pixels import CENTRE, frame_sizes
from .stats import with_stats
from .stencils import TILE, TILE_KEYS, dealt_tiles, window_of


def level_tiles(df: DataFrame, col: str, deepest: int) -> DataFrame:
    """(frame_id, level, x, y, value, gx, gy): all levels of all frames down to `deepest`, with their clamped gradients, from one shuffle.

    A tile's margin holds what its coarsest level needs: blurring spoils one cell at the window's edge on each level, a gradient looks one further.
    """
    margin = 2 << deepest
    side = max(TILE, 2 * margin)

    def run(part):
        import pandas as pd

        grid, y0, x0 = window_of(part, margin, side)
        frame, found = part["frame_id"].iat[0], []
        for level in range(deepest + 1):
            if level:
                for axis in (1, 0):
                    before, after = neighbours(grid, axis)
                    grid = (2 * grid + before + after) / 4
                grid = (grid[::2, ::2] + grid[1::2, ::2] + grid[::2, 1::2] + grid[1::2, 1::2]) / 4
                y0, x0 = y0 // 2, x0 // 2
            (west, east), (north, south) = neighbours(grid, 1), neighbours(grid, 0)
            first, size = margin >> level, side >> level
            home = np.s_[first : first + size, first : first + size]
            ys, xs = np.nonzero(~np.isnan(grid[home]))
            pick = lambda a: a[home][ys, xs]
            scale = 2.0 ** (level + 1)
            found.append({"level": np.full(len(ys), level, "int32"), "x": (xs + x0 + first).astype("int32"), "y": (ys + y0 + first).astype("int32"), "value": pick(grid), "gx": pick(west - east) / scale, "gy": pick(south - north) / scale})
        return pd.DataFrame({"frame_id": frame} | {c: np.concatenate([f[c] for f in found]) for c in found[0]})

    return dealt_tiles(df, col, margin, side).groupBy("frame_id", "tx", "ty").applyInPandas(run, "frame_id bigint, level int, x int, y int, value double, gx double, gy double")


def neighbours(grid: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """The values before and after each one along an axis; outside the frame its own."""
    before, after = grid.copy(), grid.copy()
    if axis:
        before[:, 1:], after[:, :-1] = grid[:, :-1], grid[:, 1:]
    else:
        before[1:], after[:-1] = grid[:-1], grid[1:]
    return np.where(np.isnan(before), grid, before), np.where(np.isnan(after), grid, after)


def frame_levels(df: DataFrame, col: str, min_side: int) -> DataFrame:
    """level_tiles of each frame while its lesser side is at least min_side; level 0 is always there."""
    side = F.least("width", "height")
    sizes = frame_sizes(df).select("frame_id", F.greatest(F.lit(0), F.floor(F.log2(side / float(min_side)) + 1e-12)).cast("int").alias("most"))
    deepest = sizes.agg(F.max("most")).first()[0] or 0
    return with_stats(level_tiles(df, col, deepest), sizes).where("level <= most").drop("most")


def pyramid(df: DataFrame, col: str, min_side: int = 32) -> DataFrame:
    """(frame_id, level, x, y, col): the frame, then blurred and halved, while its lesser side is at least min_side; level 0 is always there."""
    return frame_levels(df, col, min_side).select("frame_id", "level", "x", "y", F.col("value").alias(col))


def gradient_attenuation(df: DataFrame, col: str, alpha: float = 1.0, beta: float = 0.9, noise: float = 0.02, min_side: int = 32) -> DataFrame:
    """(frame_id, level, x, y, grad, mean, factor): gradient of each pixel of a pyramid, its mean over the level, and ((grad + noise) / (alpha mean))^(beta - 1),
    gradients below 1e-4 taken as that."""
    steep = frame_levels(df, col, min_side).select("frame_id", "level", "x", "y", F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2).alias("grad"))
    means = steep.groupBy("frame_id", "level").agg(F.avg("grad").alias("mean"))
    factor = F.pow((F.greatest("grad", F.lit(1e-4)) + noise) / (alpha * F.col("mean")), F.lit(beta - 1))
    return with_stats(steep, means, ("frame_id", "level")).withColumn("factor", factor)


# The threshold of discrimination in log10, the widths of the bins, and the least light.
THRESHOLD, STEP, WIDEST, LEAST = 0.0043, 0.1, 0.7, 1e-8
LIGHT_BINS, CONTRAST_BINS, MIDDLE = 161, 15, 7


def reflected(at: np.ndarray, size: int) -> np.ndarray:
    at = np.abs(at)
    return np.where(at >= size, 2 * size - 2 - at, at)


def contrast_counts(high: DataFrame, levels: int) -> DataFrame:
    """(frame_id, level, light, contrast, n) of each tile of (frame_id, x, y, high, width, height): all levels from one shuffle, pixels counted where they lie."""
    margin = 2 * ((1 << levels) - 1)  # two steps of each level
    side = max(TILE, margin)
    weights = (0.25 - CENTRE / 2, 0.25, CENTRE, 0.25, 0.25 - CENTRE / 2)

    def cells_of(x, y, value, width, height, tx, ty):
        """Cells (level, light and contrast as one number) and how often each is there."""
        # the tile with its margin, as far as the frame goes
        y0, x0 = max(0, ty * side - margin), max(0, tx * side - margin)
        ys, xs = np.arange(y0, min(height, (ty + 1) * side + margin)), np.arange(x0, min(width, (tx + 1) * side + margin))
        grid, found = np.full((len(ys), len(xs)), np.nan), []
        grid[y - y0, x - x0] = value
        home = np.s_[ty * side - y0 : (ty + 1) * side - y0, tx * side - x0 : (tx + 1) * side - x0]
        for level in range(levels):
            low = grid
            for axis, at, size, start in ((1, xs, width, x0), (0, ys, height, y0)):
                # a place outside the window is needed by no pixel of the tile
                taps = [np.clip(reflected(at + (j - 2) * (1 << level), size) - start, 0, len(at) - 1) for j in range(5)]
                low = sum(w * (low[:, t] if axis else low[t]) for w, t in zip(weights, taps, strict=True))
            dim = low[home].ravel()
            g = grid[home].ravel() - dim
            with np.errstate(invalid="ignore"):
                light, place = np.floor((dim + 8) / STEP + 0.5), np.floor((g + WIDEST) / STEP + 0.5)
            contrast = np.where((g > THRESHOLD) & (g < STEP / 2), MIDDLE + 1, np.where((g < -THRESHOLD) & (g > -STEP / 2), MIDDLE - 1, place))
            counted = (light >= 0) & (light < LIGHT_BINS) & (place >= 0) & (place < CONTRAST_BINS)
            found.append(np.unique((level * LIGHT_BINS + light[counted].astype(int)) * CONTRAST_BINS + contrast[counted].astype(int), return_counts=True))
            grid = low
        return (np.concatenate(f) for f in zip(*found, strict=True))

    def run(frame):
        import pandas as pd

        names = ("x", "y", "value", "width", "height", "tx", "ty")
        columns, (first, _, _), found = [frame[c].to_numpy() for c in names], lines_of(frame, TILE_KEYS), []
        for start, end in zip(first, [*first[1:], len(frame)], strict=True):
            cells, times = cells_of(*[c[start:end] for c in columns[:3]], *[int(c[start]) for c in columns[3:]])
            found.append((np.full(len(cells), frame["frame_id"].iat[start]), cells, times))
        frames, cells, times = (np.concatenate(f) for f in zip(*found, strict=True))
        return pd.DataFrame({"frame_id": frames, "level": cells // (LIGHT_BINS * CONTRAST_BINS), "light": cells // CONTRAST_BINS % LIGHT_BINS, "contrast": cells % CONTRAST_BINS, "n": times})

    dealt = dealt_tiles(high, "high", margin, side, ("width", "height"))
    return in_groups(dealt, TILE_KEYS, ["y", "x"], run, "frame_id bigint, level int, light int, contrast int, n bigint")


def contrast_density(df: DataFrame, col: str, levels: int = 4) -> DataFrame:
    """(frame_id, level, light, contrast, n): pixels by log10 light and by contrast to the next coarser level. Small contrasts above the threshold count beside the middle
    bin; light without any contrast gets one on either side."""
    width, height = ((F.max(c) + 1).alias(n) for c, n in (("x", "width"), ("y", "height")))
    of_frame = df.groupBy("frame_id").agg(F.greatest(F.min(F.when(F.col(col) > 0, F.col(col))), F.lit(LEAST)).alias("least"), width, height)
    high = with_stats(df.select("frame_id", "x", "y", col), of_frame).select("frame_id", "x", "y", "width", "height", F.log10(F.greatest(col, "least")).alias("high"))
    counts = contrast_counts(high, levels).groupBy("frame_id", "level", "light", "contrast").agg(F.sum("n").alias("n"))
    others = F.count_if(F.col("contrast") != MIDDLE).over(Window.partitionBy("frame_id", "level", "light"))  # as many rows as there are bins of contrast
    cell = lambda contrast, n: F.struct(contrast.cast("int").alias("contrast"), n.cast("bigint").alias("n"))
    own = cell(F.col("contrast"), F.col("n"))
    cells = F.when(others == 0, F.array(own, *[cell(F.lit(c), F.lit(1)) for c in (MIDDLE - 1, MIDDLE + 1)])).otherwise(F.array(own))
    return counts.select("frame_id", "level", "light", cells.alias("cells")).select("frame_id", "level", "light", F.explode("cells").alias("c")).select("frame_id", "level", "light", "c.*")


# Contrast over the thresholds of discrimination that it spans, in 106 equal steps of the response from 0 to 1.
CONTRASTS = (
    0.000000, 0.010000, 0.021180, 0.031830, 0.042628, 0.053819, 0.065556, 0.077960, 0.091140, 0.105203,
    0.120255, 0.136410, 0.153788, 0.172518, 0.192739, 0.214605, 0.238282, 0.263952, 0.291817, 0.322099,
    0.355040, 0.390911, 0.430009, 0.472663, 0.519238, 0.570138, 0.625811, 0.686754, 0.753519, 0.826720,
    0.907041, 0.995242, 1.092169, 1.198767, 1.316090, 1.445315, 1.587756, 1.744884, 1.918345, 2.109983,
    2.321863, 2.556306, 2.815914, 3.103613, 3.422694, 3.776862, 4.170291, 4.607686, 5.094361, 5.636316,
    6.240338, 6.914106, 7.666321, 8.506849, 9.446889, 10.499164, 11.678143, 13.000302, 14.484414, 16.151900,
    18.027221, 20.138345, 22.517282, 25.200713, 28.230715, 31.655611, 35.530967, 39.920749, 44.898685, 50.549857,
    56.972578, 64.280589, 72.605654, 82.100619, 92.943020, 105.339358, 119.530154, 135.795960, 154.464484, 175.919088,
    200.608905, 229.060934, 261.894494, 299.838552, 343.752526, 394.651294, 453.735325, 522.427053, 602.414859, 695.706358,
    804.693100, 932.229271, 1081.727632, 1257.276717, 1463.784297, 1707.153398, 1994.498731, 2334.413424, 2737.298517, 3215.770944,
    3785.169959, 4464.187290, 5275.653272, 6247.520102, 7414.094945, 8817.590551, 10510.080619,
)


def response_table(df: DataFrame) -> DataFrame:
    """(w, r): contrasts and their responses."""
    rows = F.explode(F.array(*[F.struct(F.lit(w).alias("w"), F.lit(i / (len(CONTRASTS) - 1)).alias("r")) for i, w in enumerate(CONTRASTS)]))
    return df.sparkSession.range(1).select(rows.alias("t")).select("t.*")


def to_response(df: DataFrame, col: str, detail: float = 1.0) -> DataFrame:
    """A column of gradients of natural logarithms as perceptual responses, with their sign."""
    table = response_table(df).select(F.col("w").alias("x"), F.col("r").alias("y"))
    at = df.withColumn("_w", F.exp(F.abs(col) * detail) - 1)
    return interpolate(at, "_w", table, "_r", spread=F.log1p).withColumn(col, F.when(F.col(col) < 0, -F.col("_r")).otherwise(F.col("_r"))).drop("_w", "_r")


def from_response(df: DataFrame, col: str, detail: float = 1.0) -> DataFrame:
    """The way back: a response as a gradient times the detail factor."""
    table = response_table(df).select(F.col("r").alias("x"), F.col("w").alias("y"))
    at = df.withColumn("_r", F.abs(col))
    return interpolate(at, "_r", table, "_w").withColumn(col, F.when(F.col(col) < 0, -1.0).otherwise(1.0) * F.log1p("_w") * detail).drop("_r", "_w")


def gradient_weight(g: Column) -> Column:
    """Weight of a gradient's residual: large where it is small."""
    return 1 / (0.038737 * F.pow(F.greatest(F.lit(0.001), F.abs(g)), F.lit(0.537756)))
