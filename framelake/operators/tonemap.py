"""Global tone mapping: statistics of a frame, then a curve on its pixels. Two scans, no pixel shuffle while statistics broadcast."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color
from .pixels import RGB
from .stats import frame_minmax, luminance, luminance_properties, with_stats


def scaled(df: DataFrame, old: Column, new: Column, keep=("frame_id", "x", "y")) -> DataFrame:
    """Channels times new / old luminance."""
    ratio = F.when(old != 0, new / old).otherwise(0.0)
    return df.select(*keep, *[(F.col(c) * ratio).alias(c) for c in RGB])


def tm_drago(df: DataFrame, bias: float = 0.85) -> DataFrame:
    """Logarithmic mapping with bias; luminance is the second channel."""
    s = df.groupBy("frame_id").agg(F.max("g").alias("top"), F.exp(F.avg(F.ln(F.col("g") + 1e-4))).alias("avg"))
    s = s.select("frame_id", "avg", (F.col("top") / F.col("avg")).alias("top"))
    w = F.col("g") / F.col("avg")
    power = math.log(bias) / math.log(0.5)
    new = F.ln(w + 1) / (F.ln(2 + 8 * F.exp(power * (F.ln(w) - F.ln("top")))) * F.log10(F.col("top") + 1))
    return scaled(with_stats(df, s), F.col("g"), new)


def tm_reinhard02(df: DataFrame, key: float = 0.18) -> DataFrame:
    """Photographic curve on Y: key / log-average scaling, burn-out at the frame's maximum."""
    lum = luminance(df)
    s = lum.groupBy("frame_id").agg(F.exp(F.avg(F.ln(F.col("lum") + 1e-5))).alias("avg"), F.max("lum").alias("top"))
    v, top = F.col("lum") * (key / F.col("avg")), F.col("top") * (key / F.col("avg"))
    return scaled(with_stats(lum, s), F.col("lum"), v * (1 + v / (top * top)) / (1 + v))


def tm_reinhard05(df: DataFrame, brightness: float = 0.0, chroma: float = 0.0, light: float = 1.0) -> DataFrame:
    """Photoreceptor model for each channel, then the frame's minimum and maximum of the processed samples to 0 and 1."""
    lum = luminance(df)
    at = with_stats(lum, luminance_properties(lum, brightness, tuple(F.avg(c).alias(f"mean_{c}") for c in RGB)))
    y = F.col("lum")

    def channel(c: str) -> Column:
        v = F.col(c)
        local = chroma * v + (1 - chroma) * y
        whole = chroma * F.col(f"mean_{c}") + (1 - chroma) * F.col("mean")
        adapted = light * local + (1 - light) * whole
        return F.when((y != 0) & (v != 0), v / (v + F.pow(F.col("bright") * adapted, F.col("contrast")))).otherwise(v)

    out = at.select("frame_id", "x", "y", *[channel(c).alias(c) for c in RGB])
    return with_stats(out, frame_minmax(out)).select("frame_id", "x", "y", *[color.normalize(F.col(c), F.col("lo"), F.col("hi")).alias(c) for c in RGB])


# The thresholds of vision over luminance in the functions that follow.
def cone_threshold(c: Column) -> Column:
    t = F.log10(c)
    return F.pow(F.lit(10.0), F.when(t <= -2.6, -0.72).when(t >= 1.9, t - 1.255).otherwise(F.pow(0.249 * t + 0.65, F.lit(2.7)) - 0.72))


def rod_threshold(c: Column) -> Column:
    t = F.log10(c)
    return F.pow(F.lit(10.0), F.when(t <= -3.94, -2.86).when(t >= -1.44, t - 0.395).otherwise(F.pow(F.lit(2.18), 0.405 * t + 1.6) - 2.86))


def tm_ferwerda(df: DataFrame, mul: float = 0.01, adapt: float = 0.1) -> DataFrame:
    """Visibility matching. The channels are taken in the order g, r, b, as the curve's colour vector expects."""
    display = 100.0 * mul * 100.0
    lum = df.withColumn("lum", color.rgb_to_y(F.col("g"), F.col("r"), F.col("b")))
    s = lum.groupBy("frame_id").agg((F.max("lum") * 0.5 * (mul * 100.0)).alias("world"), (1 / F.max(F.greatest(*RGB))).alias("unit"))
    seen = F.lit(adapt / 1000.0 * display)
    world = F.col("world")
    k = F.greatest((seen - world / 4) / (seen + world), F.lit(0.0))
    s = s.select("frame_id", "unit", (cone_threshold(seen) / cone_threshold(world)).alias("cone"), (rod_threshold(seen) / rod_threshold(world) * k).alias("rod"))
    at = with_stats(lum, s)
    part = {"g": 1.05, "r": 0.97, "b": 1.27}
    return at.select("frame_id", "x", "y", *[((F.col("cone") * F.col(c) + part[c] * F.col("rod") * F.col("lum")) * F.col("unit")).alias(c) for c in RGB])


def tvi_capacity(v: Column) -> Column:
    return (
        F.when(v <= 1e-20, 0.0).when(v < 0.0034, v / 0.0014).when(v < 1, 2.4483 + F.ln(v / 0.0034) / 0.4027).when(v < 7.2444, 16.5630 + (v - 1) / 0.4027).otherwise(32.0693 + F.ln(v / 7.2444) / 0.0556)
    )


def tm_ashikhmin_simple(df: DataFrame) -> DataFrame:
    """Capacity of the visual system, mapped to 500 and normalised; the least luminance counts as 0."""
    lum = luminance(df)
    s = lum.groupBy("frame_id").agg(F.max("lum").alias("top"))
    cap = with_stats(lum, s).withColumn("cap", 500.0 * tvi_capacity(F.col("lum")) / tvi_capacity(F.col("top")))
    span = cap.groupBy("frame_id").agg(F.min("cap").alias("lo"), F.max("cap").alias("hi"))
    return scaled(with_stats(cap, span), F.col("lum"), color.normalize(F.col("cap"), F.col("lo"), F.col("hi")))


TONE_MAPPERS = {"drago": tm_drago, "reinhard02": tm_reinhard02, "reinhard05": tm_reinhard05, "ferwerda": tm_ferwerda, "ashikhmin": tm_ashikhmin_simple}


def get_tone_mapper(name: str):
    try:
        return TONE_MAPPERS[name.lower()]
    except KeyError:
        raise ValueError(f"unknown tone mapper {name}; known: {', '.join(sorted(TONE_MAPPERS))}") from None
