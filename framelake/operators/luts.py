"""Look-up tables as joins: by bin, and with interpolation on uniform and on arbitrary grids.

Tables are small against pixels, but nothing here assumes it: joins are equi-joins, and the engine picks broadcast or shuffle by size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color
from .pixels import RGB
from .stats import binned_percentiles, luminance, with_stats


def bin_lookup(df: DataFrame, col: str, lut: DataFrame, out: str = "value", keys=()) -> DataFrame:
    """`df` with `out`, the value of lut (keys, bin, value) at the bin of a sample in [0, 1]; null without one."""
    at = lut.select(*keys, F.col("bin").alias("_bin"), F.col("value").alias(out))
    return df.withColumn("_bin", F.floor(F.col(col) * float(color.BINS - 1)).cast("int")).join(at, [*keys, "_bin"], "left").drop("_bin")


def interpolate_uniform(df: DataFrame, col: str, lut: DataFrame, start: float, step: float, size: int, out: str = "value", keys=()) -> DataFrame:
    """`df` with `out`, interpolated in lut (keys, i, y) at the points start + i * step, i < size; clamped at both ends."""
    after = F.lead("y").over(Window.partitionBy(*keys, F.floor(F.col("i") / size)).orderBy("i"))  # a table's rows
    at = lut.select(*keys, F.col("i").alias("_i"), F.col("y").alias("_y"), after.alias("_y1"))
    place = (F.col(col) - start) / step
    low = F.greatest(F.lit(0), F.least(F.lit(size - 1), F.floor(place))).cast("int")
    met = df.withColumns({"_place": F.greatest(F.lit(0.0), F.least(place, F.lit(size - 1.0))), "_i": low}).join(at, [*keys, "_i"])
    return met.withColumn(out, F.col("_y") + F.coalesce((F.col("_y1") - F.col("_y")) * (F.col("_place") - F.col("_i")), F.lit(0.0))).drop("_place", "_i", "_y", "_y1")


def interpolate(df: DataFrame, col: str, lut: DataFrame, out: str = "value", keys=(), cells: int = 256, spread: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """`df` with `out`, interpolated in lut (keys, x, y) of any rising x; clamped at both ends.

    A range join by cells: each segment of the table is listed in the cells that it touches, a value looks only into its own. `spread`, a rising
    function, makes the cells even where x is not.
    """
    names = keys or ["_all"]
    lut, df = (lut, df) if keys else (lut.withColumn("_all", F.lit(0)), df.withColumn("_all", F.lit(0)))
    ends = lut.groupBy(*names).agg(F.min("x").alias("_x0"), F.max("x").alias("_xn"))
    cell = lambda c: F.floor((spread(c) - spread(F.col("_x0"))) / (spread(F.col("_xn")) - spread(F.col("_x0"))) * cells).cast("int")
    line = Window.partitionBy(*names).orderBy("x")
    parts = lut.withColumns({"_x1": F.lead("x").over(line), "_y1": F.lead("y").over(line)}).join(ends, names)
    listed = parts.select(*names, F.col("x").alias("_x"), F.col("y").alias("_y"), "_x1", "_y1", F.explode(F.sequence(cell(F.col("x")), F.coalesce(cell(F.col("_x1")), cell(F.col("x"))))).alias("_cell"))
    met = with_stats(df, ends, names).withColumn("_v", F.greatest(F.col("_x0"), F.least(F.col(col), F.col("_xn")))).withColumn("_cell", cell(F.col("_v")))
    met = met.join(listed, [*names, "_cell"]).where("_v >= _x and (_v < _x1 or _x1 is null)")
    value = F.col("_y") + F.coalesce((F.col("_y1") - F.col("_y")) * (F.col("_v") - F.col("_x")) / (F.col("_x1") - F.col("_x")), F.lit(0.0))
    return met.withColumn(out, value).drop("_x0", "_xn", "_v", "_cell", "_x", "_y", "_x1", "_y1", "_all")


# The colour correction of a tone curve by its slope, and the least luminance.
K1, K2, LEAST = 1.48, 0.82, 1e-8


def apply_tone_curve(df: DataFrame, curve: DataFrame, start: float, step: float, size: int, saturation: float = 1.0, keys=()) -> DataFrame:
    """Pixels through a given curve (keys, i, y): log10 of the output over log10 luminance at start + i * step. Colours are raised to a power that follows the
    curve's slope."""
    line = Window.partitionBy(*keys, F.floor(F.col("i") / size)).orderBy("i")
    rise = F.lead("y").over(line) - F.col("y")
    power = F.pow(F.greatest(F.lit(0.0), rise / step), F.lit(K2))
    curve = curve.select(*keys, "i", F.pow(F.lit(10.0), "y").alias("light"), F.when(rise.isNotNull(), (1 + K1) * power / (1 + K1 * power) * saturation).otherwise(1.0).alias("power"))
    at = luminance(df).withColumn("lum", F.greatest(F.col("lum"), F.lit(LEAST))).withColumn("_log", F.log10("lum"))
    at = interpolate_uniform(at, "_log", curve.select(*keys, "i", F.col("light").alias("y")), start, step, size, "_light", keys)
    at = interpolate_uniform(at, "_log", curve.select(*keys, "i", F.col("power").alias("y")), start, step, size, "_power", keys)
    return at.select("frame_id", "x", "y", *[(F.pow(F.greatest(F.col(c) / F.col("lum"), F.lit(LEAST)), F.col("_power")) * F.col("_light")).alias(c) for c in RGB])


# Exposure segments for the web: eight stops each, with room for four more stops of brightening.
STOPS, ROOM = 8.0, 4.0


def log2_floored(df: DataFrame, columns, keys=("frame_id",)) -> DataFrame:
    """log2 of columns, what is not positive taken as the least positive value of the frame's column."""
    least = df.groupBy(*keys).agg(*[F.min(F.when(F.col(c) > 0, F.col(c))).alias(f"_least_{c}") for c in columns])
    return with_stats(df, least, keys).withColumns({c: F.log2(F.greatest(F.col(c), F.col(f"_least_{c}"))) for c in columns}).drop(*[f"_least_{c}" for c in columns])


def segment_plan(df: DataFrame) -> DataFrame:
    """(frame_id, segments, start, best): segments of eight stops that cover a frame's luminance, where they start, and the best exposure."""
    p = binned_percentiles(log2_floored(luminance(df), ("lum",)), "lum", {"lo": 0.1, "mid": 50.0, "hi": 99.9})
    p = p.withColumn("lo", F.col("lo") - ROOM).withColumn("segments", F.ceil((F.col("hi") - F.col("lo")) / STOPS).cast("int"))
    p = p.withColumn("start", F.col("lo") + (F.col("hi") - F.col("lo") - F.col("segments") * STOPS) / 2)
    return p.select("frame_id", "segments", "start", F.round(F.col("mid") - F.col("start") - ROOM).alias("best"))


def segment_values(df: DataFrame, plan: DataFrame, basis: DataFrame, start: float, step: float, size: int, count: int) -> DataFrame:
    """(frame_id, segment, base, x, y, r, g, b): 16-bit values of each segment's basis images. basis (base, i, y) has `count` functions of log2 light;
    the segment beyond the last has the first only."""
    shots = plan.select("frame_id", "start", F.col("segments").alias("last"), F.explode(F.sequence(F.lit(1), F.col("segments") + 1)).alias("segment"))
    shots = shots.select("frame_id", "start", "segment", F.explode(F.sequence(F.lit(1), F.when(F.col("segment") <= F.col("last"), count).otherwise(1))).alias("base"))
    at = log2_floored(df, RGB).join(shots, "frame_id")
    for c in RGB:
        at = at.withColumn("_v", F.col(c) - F.col("start") - STOPS * F.col("segment"))
        at = interpolate_uniform(at, "_v", basis, start, step, size, f"_out_{c}", ("base",))
    return at.select("frame_id", "segment", "base", "x", "y", *[(F.col(f"_out_{c}") * 65535.0).alias(c) for c in RGB])
