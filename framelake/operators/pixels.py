"""Pixel-wise operators and geometry over pixels(frame_id, x, y, r, g, b)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color
from .lineage import kept

RGB = ("r", "g", "b")
KEYS = ["frame_id"]


def each(df: DataFrame, f, columns=RGB) -> DataFrame:
    return df.withColumns({c: f(F.col(c)) for c in columns})


def apply_gamma(df: DataFrame, gamma: float) -> DataFrame:
    return each(df, lambda c: color.gamma_curve(c, gamma))


def apply_saturation(df: DataFrame, k: float) -> DataFrame:
    """HSL saturation times k, unclamped."""
    if k == 1:
        return df
    h, s, light = color.rgb_to_hsl(*map(F.col, RGB))
    hsl = df.withColumns({"_h": h, "_s": s * k, "_l": light})
    return hsl.withColumns(dict(zip(RGB, color.hsl_to_rgb(F.col("_h"), F.col("_s"), F.col("_l")), strict=True))).drop("_h", "_s", "_l")


def gamma_and_levels(df: DataFrame, black_in: float, white_in: float, black_out: float, white_out: float, gamma: float) -> DataFrame:
    light = 0.2126 * F.col("r") + 0.7152 * F.col("g") + 0.0722 * F.col("b")
    c = F.pow(light, F.lit(gamma - 1.0))
    out = df.withColumn("_c", c)
    return each(out, lambda v: color.clamp(black_out + (v - black_in) / (white_in - black_in) * F.col("_c") * (white_out - black_out), 0, 1)).drop("_c")


def calibrate(df: DataFrame, bscale: float = 1.0, bzero: float = 0.0, columns=RGB) -> DataFrame:
    return each(df, lambda c: c * bscale + bzero, columns)


MAPPINGS = {"linear": 1.0, "gamma1.4": 1.4, "gamma1.8": 1.8, "gamma2.2": 2.2, "gamma2.6": 2.6}


def mapped(c: Column, mapping: str) -> Column:
    """`log` is the power 2.2, as the file sinks of old have it."""
    return F.pow(c, F.lit(2.2)) if mapping == "log" else color.gamma_curve(c, MAPPINGS[mapping])


def quantize(df: DataFrame, lo: float, hi: float, mapping: str = "linear", bits: int = 8) -> DataFrame:
    """Normalise, clamp, map, then 8 bits through a truncated 256-entry table, 16 bits rounded, or 32 for floats."""
    unit = lambda c: color.clamp((c - lo) / (hi - lo), 0, 1)
    if bits == 8:
        return each(df, lambda c: F.floor(mapped(F.floor(unit(c) * 255.0 + 0.5).cast("double") / 255.0, mapping) * 255.0 + 1e-9).cast("int"))
    if bits == 16:
        return each(df, lambda c: F.floor(mapped(unit(c), mapping) * 65535.0 + 0.5).cast("int"))
    return each(df, lambda c: mapped(unit(c), mapping))


def frame_arith(a: DataFrame, b: DataFrame, op: str, s: float = 1.0) -> DataFrame:
    """a op b at equal pixels: mul, div, add, sub, adds (a + s b), subs (a - s b)."""
    f = {"mul": lambda x, y: x * y, "div": lambda x, y: x / y, "add": lambda x, y: x + y, "sub": lambda x, y: x - y, "adds": lambda x, y: x + s * y, "subs": lambda x, y: x - s * y}[op]
    keys = ["frame_id", "x", "y"]
    other = b.select(*keys, *[F.col(c).alias(f"_{c}") for c in RGB])
    return a.join(other, keys).select(*keys, *[f(F.col(c), F.col(f"_{c}")).alias(c) for c in RGB])


def frame_sizes(df: DataFrame) -> DataFrame:
    """(frame_id, width, height): a row for each frame."""
    return df.groupBy(*KEYS).agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def crop(df: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    return df.where((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1)).withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0})


def shift(df: DataFrame, dx: int, dy: int) -> DataFrame:
    """out(x, y) = in(x + dx, y + dy), zero where the source lies outside; one shuffle on the pixel key."""
    keys = ["frame_id", "x", "y"]
    moved = df.select("frame_id", (F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), *[F.col(c).alias(f"_{c}") for c in RGB])
    return df.select(*keys).join(moved, keys, "left").select(*keys, *[F.coalesce(f"_{c}", F.lit(0.0)).alias(c) for c in RGB])


def rotate(df: DataFrame, clockwise: bool = True) -> DataFrame:
    sized = df.join(frame_sizes(df), KEYS)
    to = {"x": F.col("height") - 1 - F.col("y"), "y": F.col("x")} if clockwise else {"x": F.col("y"), "y": F.col("width") - 1 - F.col("x")}
    return sized.withColumns(to).drop("width", "height")


def resize_bilinear(df: DataFrame, xsize: int) -> DataFrame:
    """Four weighted taps a target pixel, summed. A source pixel goes to the few targets that it is a tap of, worked out from the frame's size: a table of all taps would look
    as small as the table of sizes to the engine, which would broadcast it. Taps beyond a frame are 0; a frame too flat for one target line has none."""
    sizes = frame_sizes(df).withColumn("h2", F.floor(F.col("height") * xsize / F.col("width")).cast("int")).where("h2 > 0")
    met = df.select("frame_id", "x", "y", *RGB).join(sizes, KEYS).withColumn("w", F.lit(1.0))
    for c, size, count in (("x", "width", F.lit(xsize)), ("y", "height", F.col("h2"))):
        step = (F.col(size) - 1) / count  # targets lie at multiples of it, between two samples; on a line of one sample all at 0
        low = F.when(step > 0, F.greatest(F.lit(0), F.floor((F.col(c) - 1) / step))).otherwise(0).cast("int")
        high = F.when(step > 0, F.least(count - 1, F.floor((F.col(c) + 1) / step) + 1)).otherwise(count - 1).cast("int")
        met = met.withColumn("to", F.explode(F.sequence(F.least(low, high), high))).withColumn("at", F.col("to") * (F.col(size) - 1) / count).withColumn("off", F.col(c) - F.floor("at"))
        share = F.when(F.col("off") == 0, 1 - (F.col("at") - F.floor("at"))).otherwise(F.col("at") - F.floor("at"))
        met = met.where("off in (0, 1)").withColumns({"w": F.col("w") * share, f"{c}2": F.col("to")})
    return met.groupBy("frame_id", F.col("x2").alias("x"), F.col("y2").alias("y")).agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in RGB])


def row_window(column: str = "x"):
    """Neighbours along a row (or a column): groups stay as small as one line of a frame."""
    other = "y" if column == "x" else "x"
    return Window.partitionBy("frame_id", other).orderBy(column)


def gradients(df: DataFrame, col: str, style: str = "forward", level: int = 0) -> DataFrame:
    """gx, gy of a column. `forward`: 0 at the end. `central`: zeros outside. `border`: central, zero on the border across it.
    `clamped`: the border repeats, gx is west less east, both over 2^(level + 1), as a pyramid level has it."""
    c, w, h = F.col(col), row_window("x"), row_window("y")
    if style == "forward":
        return df.withColumn("gx", F.coalesce(F.lead(c).over(w) - c, F.lit(0.0))).withColumn("gy", F.coalesce(F.lead(c).over(h) - c, F.lit(0.0)))
    if style == "border":
        return df.withColumn("gx", F.coalesce((F.lead(c).over(w) - F.lag(c).over(w)) / 2, F.lit(0.0))).withColumn("gy", F.coalesce((F.lead(c).over(h) - F.lag(c).over(h)) / 2, F.lit(0.0)))
    if style == "clamped":
        across = (F.coalesce(F.lag(c).over(w), c) - F.coalesce(F.lead(c).over(w), c)) / 2.0 ** (level + 1)
        return df.withColumn("gx", across).withColumn("gy", (F.coalesce(F.lead(c).over(h), c) - F.coalesce(F.lag(c).over(h), c)) / 2.0 ** (level + 1))
    if style != "central":
        raise ValueError(f"unknown style {style} of gradients; known: forward, central, border, clamped")
    out = df.withColumn("gx", (F.lead(c, 1, 0.0).over(w) - F.lag(c, 1, 0.0).over(w)) / 2)
    return out.withColumn("gy", (F.lead(c, 1, 0.0).over(h) - F.lag(c, 1, 0.0).over(h)) / 2)


def divergence(df: DataFrame, style: str = "backward") -> DataFrame:
    """`backward`: differences of gx and gy to the line before; the first line keeps its own value. `central`: half the difference of both neighbours,
    one-sided at the end of a line, and for gy's first line its own value."""
    w, h = row_window("x"), row_window("y")
    if style == "backward":
        return df.withColumn("div", F.col("gx") - F.lag("gx", 1, 0.0).over(w)).withColumn("div", F.col("div") + F.col("gy") - F.lag("gy", 1, 0.0).over(h))
    if style != "central":
        raise ValueError(f"unknown style {style} of divergence; known: backward, central")
    before, after, up, down = F.lag("gx").over(w), F.lead("gx").over(w), F.lag("gy").over(h), F.lead("gy").over(h)
    dx = F.when(before.isNull(), after - F.col("gx")).when(after.isNull(), F.col("gx") - before).otherwise((after - before) / 2)
    dy = F.when(up.isNull(), F.col("gy")).when(down.isNull(), F.col("gy") - up).otherwise((down - up) / 2)
    return df.withColumn("div", dx).withColumn("div", F.coalesce("div", "gx") + dy)


def blur(df: DataFrame, col: str) -> DataFrame:
    """1-2-1 binomial in both directions; the edge weighs 3-1."""
    for w in (row_window("x"), row_window("y")):
        c = F.col(col)
        df = df.withColumn(col, (2 * c + F.coalesce(F.lag(col).over(w), c) + F.coalesce(F.lead(col).over(w), c)) / 4)
    return df


# Fixed value: the centre weight of the five-tap kernel.
CENTRE = 0.4


def blur_level(df: DataFrame, col: str, level: int) -> DataFrame:
    """(frame_id, x, y, col): five taps at distances of 2^level in both directions, reflected at the border. A line of a frame is gathered at a time."""
    step, weights = 1 << level, (0.25 - CENTRE / 2, 0.25, CENTRE, 0.25, 0.25 - CENTRE / 2)

    def taps(line: Column, at: Column) -> Column:
        n = F.size(line)
        total = F.lit(0.0)
        for j, weight in enumerate(weights):
            i = F.abs(at + (j - 2) * step)
            total += weight * F.element_at(line, (F.when(i >= n, 2 * n - 2 - i).otherwise(i) + 1).cast("int"))
        return total

    out = df.select("frame_id", "x", "y", col)
    for along, across in (("x", "y"), ("y", "x")):
        lines = out.groupBy("frame_id", across).agg(F.transform(F.sort_array(F.collect_list(F.struct(along, col))), lambda s: s[col]).alias("line"))
        lines = lines.select("frame_id", across, F.posexplode(F.transform("line", lambda v, i: taps(F.col("line"), i))).alias(along, col))
        out = lines.select("frame_id", "x", "y", col)
    return out


def downsample2(df: DataFrame, col: str) -> DataFrame:
    """Mean of 2 x 2 cells; an odd last row or column is left out."""
    size = frame_sizes(df)
    met = df.join(size, KEYS).where((F.col("x") < F.floor(F.col("width") / 2) * 2) & (F.col("y") < F.floor(F.col("height") / 2) * 2))
    return met.groupBy("frame_id", F.floor(F.col("x") / 2).cast("int").alias("x"), F.floor(F.col("y") / 2).cast("int").alias("y")).agg(F.avg(col).alias(col))


BINS_PER_OCTAVE = 1024


def contrast_equalize(grad: DataFrame, factor: float) -> DataFrame:
    """Gradients scaled by factor * cdf / magnitude, the cdf being the rank among all magnitudes of the frame.

    Ranks are exact: counts of logarithmic bins give the rank at which a bin starts, and only the pixels of one bin are sorted together.
    Flat pixels (often most of a frame) need no rank of their own. The gradients are written once, to the shared folder: counts and both kinds of pixels read them.
    """
    g = grad.withColumn("mag", F.round(F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2), 9)).withColumn("bin", F.when(F.col("mag") > 0, F.floor(F.log2("mag") * BINS_PER_OCTAVE).cast("int")))
    g = kept(g)
    hist = g.groupBy("frame_id", "bin").agg(F.count("*").alias("n"))
    by_bin = Window.partitionBy("frame_id").orderBy(F.asc_nulls_first("bin"))
    hist = hist.withColumns({"before": F.sum("n").over(by_bin.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"), "total": F.sum("n").over(Window.partitionBy("frame_id"))}).drop("n")
    inside = F.count("*").over(Window.partitionBy("frame_id", "bin").orderBy("mag"))  # equal magnitudes rank together
    moved = g.where("mag > 0").join(hist, ["frame_id", "bin"]).withColumn("scale", factor * (F.col("before") + inside) / F.col("total") / F.col("mag"))
    flat = g.where("not mag > 0 or mag is null").withColumns({"gx": F.lit(0.0), "gy": F.lit(0.0)})
    moved = moved.withColumns({"gx": F.col("gx") * F.col("scale"), "gy": F.col("gy") * F.col("scale")})
    return moved.select(*grad.columns).unionByName(flat.select(*grad.columns))
