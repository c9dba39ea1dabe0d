"""Levels, zones and curves that come from histograms: every statistic is a partial aggregate of at most 65536 bins a group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color
from .pixels import RGB, frame_sizes
from .stats import luminance, with_stats
from .tonemap import TONE_MAPPERS, scaled

BINS = 65536
EPS = 1e-6
EDGE = 1e-9  # keeps values on the edge of a bin inside it


def percentiles(df: DataFrame, col: str, lo_share: float, hi_share: float, keys=("frame_id",)) -> DataFrame:
    """(keys, q_lo, q_hi) by a histogram of min(65536, rows) bins with interpolation inside a bin; a constant column is its value."""
    span = df.groupBy(*keys).agg(F.min(col).alias("lo"), F.max(col).alias("hi"), F.count("*").alias("total"))
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / (F.least(F.lit(BINS), F.col("total")) - 1))
    at = with_stats(df.select(*keys, col), span.withColumn("width", width), keys)
    group = [*keys, "lo", "hi", "total", "width"]
    hist = at.groupBy(*group, F.coalesce(F.floor((F.col(col) - F.col("lo")) / F.col("width") + EDGE), F.lit(0)).alias("bin")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")

    def reached(share: float):
        wanted = share * F.col("total")
        inside = (F.col("before") < wanted) & (F.col("before") + F.col("n") >= wanted)
        value = F.max(F.when(inside, F.col("lo") + (F.col("bin") + (wanted - F.col("before")) / F.col("n")) * F.col("width")))
        return F.greatest(F.col("lo"), F.least(F.col("hi"), value))

    return hist.withColumn("before", before).groupBy(*group).agg(reached(lo_share).alias("q_lo"), reached(hi_share).alias("q_hi")).select(*keys, "q_lo", "q_hi")


def tm_kimkautz(df: DataFrame, c1: float = 3.0, c2: float = 0.5) -> DataFrame:
    """Logarithmic compression, strongest away from the log-average; then 1 % to 99 % of the result to 0 to 1."""
    lum = luminance(df)
    log = F.ln(F.col("lum") + EPS)
    s = lum.groupBy("frame_id").agg(F.avg(log).alias("mu"), (F.max(log) - F.min(log)).alias("range"))
    k = (math.log(300.0) - math.log(0.3)) / F.col("range")
    bell = F.exp(-((F.col("lum") - F.col("mu")) ** 2) / (2 * (F.col("range") / c1) ** 2))
    curve = F.exp(c2 * ((1 - k) * bell + k) * (log - F.col("mu")) + F.col("mu"))
    at = with_stats(lum, s).withColumn("curve", F.when(F.col("range") > 0, curve).otherwise(F.col("lum")))
    at = with_stats(at, percentiles(at, "curve", 0.01, 0.99))
    unit = F.when(F.col("q_hi") > F.col("q_lo"), color.normalize(color.clamp(F.col("curve"), F.col("q_lo"), F.col("q_hi")), F.col("q_lo"), F.col("q_hi"))).otherwise(0.0)
    return scaled(at, F.col("lum"), unit)


CURVE_START, CURVE_STEP, CURVE_POINTS = -6.0, 0.1, 150  # log10 of luminance


def tm_mai(df: DataFrame) -> DataFrame:
    """Histogram curve on every channel: slopes go with the cube root of the share of pixels in a bin of log luminance (the second channel)."""
    place = lambda c: (F.log10(F.greatest(F.col(c), F.lit(1e-5))) - CURVE_START) / CURVE_STEP + EDGE
    hist = df.groupBy("frame_id", F.floor(place("g")).cast("int").alias("bin")).agg(F.count("*").alias("n")).where(F.col("bin") < CURVE_POINTS)
    roots = hist.groupBy("frame_id").agg(F.sum(F.cbrt("n")).alias("whole"), F.collect_list(F.struct("bin", F.cbrt("n").alias("rise"))).alias("steps"))  # at most 150 steps
    upto = lambda i: F.aggregate("steps", F.lit(0.0), lambda total, s: total + F.when((s["bin"] >= 1) & (s["bin"] <= i), s["rise"]).otherwise(0.0))
    curves = roots.select("frame_id", F.transform(F.sequence(F.lit(0), F.lit(CURVE_POINTS - 1)), lambda i: upto(i) / F.col("whole")).alias("curve"))

    def value(c: str):
        low = F.least(F.floor(place(c)), F.lit(CURVE_POINTS - 1)).cast("int")
        high = F.least(low + 1, F.lit(CURVE_POINTS - 1))
        y0, y1 = F.get("curve", low), F.get("curve", high)
        return y0 + (y1 - y0) * (place(c) - low)

    return with_stats(df, curves).select("frame_id", "x", "y", *[value(c).alias(c) for c in RGB])


def zone_exposure(df: DataFrame, alpha: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(pixels with lum and zone, stops): zones are octaves above the 1 % percentile; stops(frame_id, zone, stop) has a row a zone.

    A zone's stop takes its median luminance through the photographic curve. Frames whose percentiles do not differ have one zone and stop 0.
    """
    lum = luminance(df)
    s = percentiles(lum, "lum", 0.01, 0.99).join(lum.groupBy("frame_id").agg(F.exp(F.avg(F.ln(F.col("lum") + EPS))).alias("avg")), "frame_id")
    s = s.withColumns({"least": F.log2(F.col("q_lo") + EPS), "range": F.log2(F.col("q_hi") + EPS) - F.log2(F.col("q_lo") + EPS)})
    key = alpha * 0.18 * F.pow(F.lit(4.0), (2 * (F.log2(F.col("avg") + EPS) - F.col("least")) - F.col("range")) / F.col("range"))
    s = s.select("frame_id", "avg", "least", "range", F.when(F.col("range") > 0, key).alias("key"), (1.5 * F.pow(F.lit(2.0), F.col("range") - 5)).alias("white"))
    zone = F.greatest(F.lit(0), F.least(F.ceil("range") - 1, F.ceil(F.log2(F.col("lum") + EPS) - F.col("least") - EDGE))).cast("int")
    zoned = with_stats(lum, s.select("frame_id", "least", "range")).withColumn("zone", zone).drop("least", "range")
    medians = with_stats(percentiles(zoned, "lum", 0.5, 0.5, ("frame_id", "zone")), s)
    bright = F.col("q_lo") * F.col("key") / F.col("avg")
    mapped = bright * (1 + bright / (F.col("white") * F.col("white"))) / (1 + bright)
    stop = F.when(F.col("q_lo") > 0, F.log2(mapped / F.col("q_lo") + EPS))
    return zoned, medians.select("frame_id", "zone", F.coalesce(stop, F.lit(0.0)).alias("stop"))


def tm_zone(df: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Every pixel exposed by the stop of its zone, without smoothing between zones."""
    zoned, stops = zone_exposure(df, alpha)
    return with_stats(zoned, stops, ("frame_id", "zone")).select("frame_id", "x", "y", *[(F.col(c) * F.pow(F.lit(2.0), F.col("stop"))).alias(c) for c in RGB])


def auto_levels(df: DataFrame, threshold: float = 0.985) -> DataFrame:
    """(frame_id, lo, hi, gamma) of 8-bit channels: from the peak of each histogram (r, g, b, lightness) outwards until `threshold` of the
    mass on that side; the widest of the four. Windows span the 256 levels of a channel, never its pixels."""
    light = F.floor((F.greatest(*RGB) + F.least(*RGB)) / 2)
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("channel"), c.cast("int").alias("bin")) for k, c in (*((c, F.col(c)) for c in RGB), ("light", light))]))
    hist = df.select("frame_id", kinds.alias("k")).groupBy("frame_id", "k.channel", "k.bin").agg(F.count("*").alias("n"))
    group = Window.partitionBy("frame_id", "channel")
    peak = hist.groupBy("frame_id", "channel").agg(F.max(F.struct("n", (-F.col("bin")).alias("bin"))).alias("top"))
    peak = peak.select("frame_id", "channel", F.greatest(F.lit(1), F.least(F.lit(254), -F.col("top.bin"))).alias("peak"))
    dense = peak.select("*", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("bin")).join(hist, ["frame_id", "channel", "bin"], "left").fillna(0, ["n"])
    left, right = F.when(F.col("bin") < F.col("peak"), F.col("n")).otherwise(0), F.when(F.col("bin") >= F.col("peak"), F.col("n")).otherwise(0)
    summed = dense.withColumns({"below": F.sum(left).over(group.orderBy(F.desc("bin"))), "left": F.sum(left).over(group), "above": F.sum(right).over(group.orderBy("bin")), "right": F.sum(right).over(group)})
    low = F.max(F.when((F.col("bin") >= 1) & (F.col("bin") < F.col("peak")) & (F.col("below") >= threshold * F.col("left")), F.col("bin")))
    high = F.min(F.when((F.col("bin") >= F.col("peak")) & (F.col("bin") < 254) & (F.col("above") >= threshold * F.col("right")), F.col("bin") + 1))
    ends = summed.groupBy("frame_id", "channel").agg(F.coalesce(low, F.lit(0)).alias("low"), F.coalesce(high, F.lit(255)).alias("high"))
    return ends.groupBy("frame_id").agg((F.min("low") / 255.0).alias("lo"), (F.max("high") / 255.0).alias("hi"), F.lit(1.0).alias("gamma"))


def upsample2(df: DataFrame, col: str) -> DataFrame:
    """Every pixel four times: the nearest-neighbour inverse of halving a frame."""
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for j in (0, 1) for i in (0, 1)]))
    return df.select("frame_id", "x", "y", col, corner.alias("c")).select("frame_id", (F.col("x") * 2 + F.col("c.i")).alias("x"), (F.col("y") * 2 + F.col("c.j")).alias("y"), col)


# Fixed values of the visual model: exponent of the receptors' response, display luminance, white and dark shares of the adaptation.
RESPONSE, DISPLAY, WHITE, DARK = 0.73, 25.0, 5.0, 6.4


def cone_sigma(c: Column) -> Column:
    k = F.pow(1 / (5.0 * c + 1), F.lit(4.0))
    return 12.9223 * c / (k * c + 0.171 * F.pow(1 - k, F.lit(2.0)) * F.cbrt(c))


def rod_sigma(c: Column) -> Column:
    j = F.pow(1 / (5e4 * c + 1), F.lit(2.0))
    return 2.5874 * c / (19000.0 * j * c + 0.2615 * F.pow(1 - j, F.lit(4.0)) * F.sqrt(F.cbrt(c)))


def receptor(c: Column, sigma: Column) -> Column:
    return F.pow(c, F.lit(RESPONSE)) / (F.pow(c, F.lit(RESPONSE)) + F.pow(sigma, F.lit(RESPONSE)))


def tm_pattanaik(df: DataFrame, multiplier: float = 1.0, cone: float | None = None, rod: float | None = None, local: str | None = None, whole: DataFrame | None = None) -> DataFrame:
    """Visual adaptation of a whole frame: to five times its log-average, or to the given cone and rod luminances; black pixels stay black.
    `local` names a column of adaptation luminances: receptors then adapt by it, the display by the whole frame. The log-average is that of `whole`, the same pixels
    where they are cheaper to make, or of `df`."""
    lum, all_lum = (luminance(pixels.withColumns({c: F.col(c) * multiplier for c in RGB})) for pixels in (df, df if whole is None else whole))
    s = all_lum.groupBy("frame_id").agg((5.0 * F.exp(F.avg(F.ln(F.col("lum") + 2.3e-5)))).alias("auto"))
    s = s.select("frame_id", *[(F.lit(float(v)) if v is not None else F.col("auto")).alias(n) for n, v in (("ac", cone), ("ar", rod))])
    s = s.withColumns({"bc": 2e6 / (2e6 + F.col("ac")), "br": 0.04 / (0.04 + F.col("ar")), "sc": cone_sigma(F.col("ac")), "sr": rod_sigma(F.col("ar"))})
    scene = lambda k: F.col("bc") * receptor(F.col("ac") * k, F.col("sc")) + F.col("br") * receptor(F.col("ar") * k, F.col("sr"))
    shown = cone_sigma(F.lit(DISPLAY))
    s = s.withColumns({"white": scene(WHITE), "dark": scene(1 / DARK), "shown_white": receptor(F.lit(DISPLAY * WHITE), shown), "shown_dark": receptor(F.lit(DISPLAY / DARK), shown), "shown": shown})
    ratio = (F.col("shown_white") - F.col("shown_dark")) / (F.col("white") - F.col("dark"))
    above, below = F.col("white") > F.col("shown_white"), F.col("dark") < F.col("shown_dark")
    s = s.withColumns({
        "move": F.when(above, F.col("white")).when(below, F.col("dark")).otherwise(0.0), "to": F.when(above, F.col("shown_white")).when(below, F.col("shown_dark")).otherwise(0.0),
        "stretch": F.when(above | below, F.least(ratio, F.lit(1.0))).otherwise(1.0), "colour": (F.col("shown_white") - F.col("shown_dark")) / math.log10(WHITE * DARK),
    })
    at = with_stats(lum, s)
    if local:
        at = at.withColumns({"bc": 2e6 / (2e6 + F.col(local)), "br": 0.04 / (0.04 + F.col(local)), "sc": cone_sigma(F.col(local)), "sr": rod_sigma(F.col(local))})
    n, y = F.lit(RESPONSE), F.col("lum")
    rods, cones = F.col("br") * receptor(y, F.col("sr")), F.col("bc") * receptor(y, F.col("sc"))
    at = at.withColumns({"all": rods + cones, "rods": rods / (rods + cones), "cones": cones / (rods + cones)})
    chroma = F.col("bc") * F.pow("sc", n) * n * F.pow(y, n) / F.pow(F.pow(y, n) + F.pow("sc", n), F.lit(2.0)) / F.col("colour")
    seen = F.greatest(F.lit(0.0), F.least(F.lit(0.9999999), (F.col("all") - F.col("move")) * F.col("stretch") + F.col("to")))
    light = F.col("shown") / (DISPLAY * WHITE) * F.pow(seen / (1 - seen), F.lit(1 / RESPONSE))
    unit = lambda c: F.when(y > 0, color.clamp(light * (F.pow(F.col(c) / y, chroma) * F.col("cones") + F.col("rods")), 0, 1)).otherwise(0.0)
    return at.select("frame_id", "x", "y", *[unit(c).alias(c) for c in RGB])


LOBES = 3.0


def lanczos_line(df: DataFrame, c: str, size: str, count: Column, keep: list[str]) -> DataFrame:
    """(keep, c, r, g, b): the lines along c at their targets. A sample goes to the targets that it is a tap of, worked out from the frame's size (a table of all
    taps would look small to the engine, which would broadcast it), and a target divides by the sum of its weights."""
    stretch, at = F.least(F.col("scale"), F.lit(1.0)), F.col(c)
    low = F.greatest(F.lit(0), F.floor((at + 0.5 - LOBES / stretch) * F.col("scale") - 0.5)).cast("int")
    high = F.least(count - 1, F.ceil((at + 0.5 + LOBES / stretch) * F.col("scale") - 0.5)).cast("int")
    met = df.withColumn("to", F.explode(F.sequence(F.least(low, high), high))).withColumn("centre", (F.col("to") + 0.5) / F.col("scale") - 0.5)
    first = F.greatest(F.lit(0), F.floor(F.col("centre") - LOBES / stretch) + 1)
    last = F.least(F.col(size), F.floor(F.col("centre") + LOBES / stretch) + 1) - 1
    met = met.where((at >= first) & (at <= last)).withColumn("z", stretch * (F.col("centre") - at))
    phase = math.pi * F.col("z")
    w = F.when(F.col("z") * F.col("z") < 1e-6, 1.0).when(F.abs("z") > LOBES, 0.0).otherwise(LOBES * F.sin(phase) * F.sin(phase / LOBES) / (phase * phase))
    met = met.withColumn("w", w).groupBy(*keep, F.col("to").alias(c))
    return met.agg(*[(F.sum(F.col("w") * F.col(v)) / F.sum("w")).alias(v) for v in RGB])


def resize_lanczos(df: DataFrame, xsize: int) -> DataFrame:
    """Separable three-lobed resize, wider when it shrinks, negatives to 0: columns first, then rows, each a weighted sum with map-side parts."""
    sizes = frame_sizes(df).withColumns({"h2": F.floor(F.col("height") * xsize / F.col("width")).cast("int"), "scale": F.lit(float(xsize)) / F.col("width")}).where("h2 > 0")
    at = df.select("frame_id", "x", "y", *RGB).join(sizes, "frame_id")
    down = lanczos_line(at, "y", "height", F.col("h2"), ["frame_id", "x", "width", "scale"])
    across = lanczos_line(down, "x", "width", F.lit(xsize), ["frame_id", "y"])
    return across.select("frame_id", "x", "y", *[F.greatest(F.lit(0.0), c).alias(c) for c in RGB])


TONE_MAPPERS.update(kimkautz=tm_kimkautz, mai=tm_mai, pattanaik=tm_pattanaik, zone=tm_zone)
