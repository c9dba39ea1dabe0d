"""Rendering: every frame through every preset."""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color
from ..operators import levels, pixels, stats, stencils, tonemap  # noqa: F401  levels and stencils add their tone mappers
from ..operators.lineage import kept


LAST = ("postsaturation", "postgamma", "auto", "bits")  # what a preset does to its tone mapper's result


def mapped(px: DataFrame, tmo: str, pregamma: float = 1.0, crop: tuple | None = None, xsize: int | None = None, **params) -> DataFrame:
    """(crop or resize) -> pre-gamma -> tone mapper."""
    out = pixels.crop(px, *crop) if crop else pixels.resize_bilinear(px, xsize) if xsize else px
    return tonemap.get_tone_mapper(tmo)(pixels.apply_gamma(out, pregamma), **params)


def finished(out: DataFrame, postsaturation: float = 1.0, postgamma: float = 1.0, auto: float | None = None) -> DataFrame:
    """Saturation -> post-gamma -> automatic levels with threshold `auto`."""
    out = pixels.apply_gamma(pixels.apply_saturation(out, postsaturation), postgamma)
    if auto is not None:
        found = levels.auto_levels(pixels.quantize(out, 0.0, 1.0, "linear", 8), auto)
        at = stats.with_stats(out, found)
        out = pixels.each(at, lambda c: color.normalize(c, F.col("lo"), F.col("hi"))).drop("lo", "hi", "gamma")
    return out


def render(px: DataFrame, tmo: str, postsaturation: float = 1.0, postgamma: float = 1.0, auto: float | None = None, bits: int = 8, **first) -> DataFrame:
    """(crop or resize) -> pre-gamma -> tone mapper -> saturation -> post-gamma -> automatic levels with threshold `auto` -> quantise."""
    return pixels.quantize(finished(mapped(px, tmo, **first), postsaturation, postgamma, auto), 0.0, 1.0, "linear", bits)


@contextmanager
def lenient(spark: SparkSession):
    """Arithmetic of plans made meanwhile gives null where it has no result, instead of ending the job."""
    name = "spark.sql.ansi.enabled"
    usual = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, usual)


def render_batch(px: DataFrame, presets: dict[str, dict]) -> tuple[DataFrame, DataFrame]:
    """(frame_id, x, y, r, g, b, preset) of all frames by all presets, and (preset, frame_id, error) of what failed.

    A preset that cannot be planned is an error without a frame. A frame with a pixel that has no number under a preset is an error of both and is left out,
    and stops no other frame. Presets that begin alike (crop or size, pre-gamma, tone mapper and its parameters) share one plan of that part, so a
    frame's statistics are taken once for each such beginning. The pixels are written once, to the shared folder.
    """
    spark, alike, told = px.sparkSession, {}, []
    for name, preset in presets.items():
        last = {k: v for k, v in preset.items() if k in LAST}
        first = {k: v for k, v in preset.items() if k not in LAST}
        alike.setdefault(repr(sorted(first.items())), []).append((name, first, last))
    found = []
    with lenient(spark):
        for group in alike.values():
            try:
                base = mapped(px, **group[0][1]).select("frame_id", "x", "y", *pixels.RGB)
            except (ValueError, TypeError) as e:
                told += [(name, None, str(e)) for name, _, _ in group]
                continue
            for name, _, last in group:
                try:
                    out = finished(base, **{k: v for k, v in last.items() if k != "bits"})
                    odd = reduce(lambda a, b: a | b, [F.coalesce(F.isnan(c), F.lit(True)) | F.col(c).isNull() for c in pixels.RGB])
                    out = pixels.quantize(out.withColumn("odd", odd), 0.0, 1.0, "linear", last.get("bits", 8))
                    found.append(out.select("frame_id", "x", "y", *[F.col(c).cast("double").alias(c) for c in pixels.RGB], F.lit(name).alias("preset"), "odd"))
                except (ValueError, TypeError) as e:
                    told.append((name, None, str(e)))
    failed = spark.createDataFrame(told, "preset string, frame_id bigint, error string")
    if not found:
        raise ValueError(f"no preset could be planned: {told}")
    made = kept(reduce(DataFrame.unionByName, found))
    broken = made.where("odd").groupBy("preset", "frame_id").agg(F.format_string("%d pixels without a number", F.count("*")).alias("error"))
    good = made.join(broken.select("preset", "frame_id"), ["preset", "frame_id"], "left_anti")
    return good.select("frame_id", "x", "y", *pixels.RGB, "preset"), failed.unionByName(broken)


def batch_plan(frames: DataFrame, presets: DataFrame) -> DataFrame:
    """Every frame with every preset; the engine broadcasts the presets if they are few."""
    return frames.crossJoin(presets)
