"""Alignment of hand-held brackets by median-threshold bitmaps, coarse to fine.

Every level is written once, as bitmaps of 64 pixels to a number; a level's nine shifts are tried on these numbers by shifting and comparing bits. So
the plan of a level does not hold those of the others, and a try moves some bytes for 64 pixels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color
from .brackets import cumulative_shifts
from .lineage import discard, kept
from .pixels import RGB

EXPOSURE = ["scene_id", "exposure_idx"]
NOISE = 4
WORD = 64  # pixels of a number


def grey_levels(stack: DataFrame) -> DataFrame:
    """(scene_id, exposure_idx, x, y, lum): 8-bit luminance."""
    lum = color.clamp(color.rgb_to_y(*map(F.col, RGB)), 0, 1)
    return stack.select(*EXPOSURE, "x", "y", color.to_uint(lum, 8).alias("lum"))


def thresholds(grey: DataFrame, quantile: float = 0.5) -> DataFrame:
    """(scene_id, exposure_idx, threshold): the first level at which the cumulated histogram reaches the quantile."""
    hist = grey.groupBy(*EXPOSURE, "lum").agg(F.count("*").alias("n"))
    cum = F.sum("n").over(Window.partitionBy(*EXPOSURE).orderBy("lum").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy(*EXPOSURE))
    return hist.withColumns({"cum": cum, "total": total}).where(F.col("cum") >= F.floor(F.col("total") * quantile)).groupBy(*EXPOSURE).agg(F.min("lum").alias("threshold"))


def halved(grey: DataFrame, sizes: DataFrame) -> DataFrame:
    """Half the size by bilinear samples, truncated to whole levels; `sizes` has (scene_id, w, h). A pixel goes to the samples that it takes part in, so
    that one aggregation by sample makes a level."""
    at = grey.join(sizes, "scene_id")
    for c, size in (("x", "w"), ("y", "h")):
        step = f"(({size} - 1) / cast(floor({size} / 2) as double))"
        near = f"filter(sequence(cast(floor(({c} - 1) / {step}) as int), cast(floor(({c} + 1) / {step}) as int) + 1), t -> t >= 0 and t < floor({size} / 2) and abs(t * {step} - {c}) < 1)"
        taps = F.explode(F.expr(f"transform({near}, t -> struct(t as {c}2, 1 - abs(t * {step} - {c}) as k{c}))"))
        at = at.select("*", taps.alias("_n")).select(*[d for d in at.columns], f"_n.{c}2", f"_n.k{c}")
    out = at.groupBy(*EXPOSURE, F.col("x2").alias("x"), F.col("y2").alias("y")).agg(F.sum(F.col("kx") * F.col("ky") * F.col("lum")).alias("v"))
    return out.select(*EXPOSURE, "x", "y", F.floor(F.col("v") + 1e-9).cast("int").alias("lum"))


def bitmaps(grey: DataFrame, medians: DataFrame, noise: int = NOISE) -> DataFrame:
    """(scene_id, exposure_idx, y, word, bits, mask): WORD pixels of a line in two numbers; the mask has those outside the band around the threshold."""
    at = grey.join(medians, EXPOSURE).where(F.abs(F.col("lum") - F.col("threshold")) >= noise)
    one = F.expr(f"shiftleft(1L, x % {WORD})")
    packed = {"bits": F.when(F.col("lum") >= F.col("threshold"), one).otherwise(F.lit(0).cast("bigint")), "mask": one}
    return at.groupBy(*EXPOSURE, "y", F.floor(F.col("x") / WORD).cast("int").alias("word")).agg(*[F.bit_or(c).alias(name) for name, c in packed.items()])


def best_shifts(words: DataFrame, guess: DataFrame) -> DataFrame:
    """(scene_id, exposure_idx, dx, dy): of the nine shifts around the guess, out(x, y) = in(x + dx, y + dy), the first with the fewest different bits
    against the exposure before. Moved words meet those before them by place; differences are counted in words and summed map-side."""
    nine = F.explode(F.array(*[F.struct(F.lit(3 * i + j + 4).alias("place"), (F.col("dx") + i).alias("dx"), (F.col("dy") + j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    tries = guess.select(*EXPOSURE, nine.alias("_n")).select(*EXPOSURE, "_n.*")
    at = words.join(tries, EXPOSURE).withColumns({"_d": F.floor(F.col("dx") / WORD).cast("int"), "_o": F.pmod("dx", F.lit(WORD)).cast("int")})
    none = "cast(0 as bigint)"
    low = f"struct(word - _d as word, shiftrightunsigned(bits, _o) as bits, shiftrightunsigned(mask, _o) as mask, {none} as other, {none} as others)"
    high = f"struct(word - _d - 1 as word, shiftleft(bits, {WORD} - _o) as bits, shiftleft(mask, {WORD} - _o) as mask, {none} as other, {none} as others)"
    moved = at.select(*EXPOSURE, "place", (F.col("y") - F.col("dy")).cast("int").alias("y"), F.explode(F.expr(f"if(_o = 0, array({low}), array({low}, {high}))")).alias("_w"))
    places = F.explode(F.array(*map(F.lit, range(9))))
    before = words.select("scene_id", (F.col("exposure_idx") + 1).cast("int").alias("exposure_idx"), "y", "word", F.col("bits").alias("other"), F.col("mask").alias("others"))
    before = before.join(guess.select(*EXPOSURE), EXPOSURE, "left_semi").select(*EXPOSURE, places.alias("place"), "y", F.expr(f"struct(word, {none} as bits, {none} as mask, other, others)").alias("_w"))
    met = moved.unionByName(before).select(*EXPOSURE, "place", "y", "_w.*").groupBy(*EXPOSURE, "place", "y", "word").agg(*[F.bit_or(c).alias(c) for c in ("bits", "mask", "other", "others")])
    errors = met.groupBy(*EXPOSURE, "place").agg(F.sum(F.expr("bit_count((bits ^ other) & mask & others)")).alias("errors"))
    scored = tries.join(errors, [*EXPOSURE, "place"], "left").groupBy(*EXPOSURE).agg(F.min(F.struct(F.coalesce("errors", F.lit(0)).alias("errors"), "place", "dx", "dy")).alias("best"))
    return scored.select(*EXPOSURE, F.col("best.dx").cast("int").alias("dx"), F.col("best.dy").cast("int").alias("dy"))


def mtb_align(stack: DataFrame, quantile: float = 0.5, noise: int = NOISE, levels: int | None = None) -> DataFrame:
    """(scene_id, exposure_idx, dx, dy): the shift of each exposure to the first one of its bracket, the exposures being numbered without a gap.

    `levels`, the number of halvings, follows from the size of a scene's frames: none below 128 lines, or as given, but no further than to 4 pixels. A
    shift of up to 2^(levels + 1) - 1 pixels is found. Thresholds are those of the full size. Levels and guesses are kept in the shared folder
    while they are needed.
    """
    spark, written = stack.sparkSession, []
    grey = kept(grey_levels(stack).withColumns({"exposure_idx": F.col("exposure_idx").cast("int"), "x": F.col("x").cast("int"), "y": F.col("y").cast("int")}), written)
    medians = kept(thresholds(grey, quantile), written)
    sizes = grey.groupBy("scene_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    wanted = F.floor(F.log2(F.least("w", "h"))) - 6 if levels is None else F.least(F.lit(levels), F.floor(F.log2(F.least("w", "h"))) - 2)
    sizes = kept(sizes.withColumn("levels", F.greatest(F.lit(0), wanted).cast("int")), written)
    most = sizes.agg(F.max("levels")).first()[0] or 0
    words = [kept(bitmaps(grey, medians, noise), written)]
    for level in range(1, most + 1):
        above = sizes.where(F.col("levels") >= level).select("scene_id", *[F.floor(F.col(c) / 2.0 ** (level - 1)).cast("int").alias(c) for c in "wh"])
        grey = kept(halved(grey, above), written)
        words.append(kept(bitmaps(grey, medians, noise), written))
    exposures = medians.select(*EXPOSURE)
    guess = exposures.where("exposure_idx > 0").withColumns({"dx": F.lit(0), "dy": F.lit(0)})
    for level in range(most, -1, -1):
        own = guess.join(sizes.select("scene_id", "levels"), "scene_id")
        busy = best_shifts(words[level], own.where(F.col("levels") >= level).select(*EXPOSURE, "dx", "dy"))
        scale = 2 if level else 1
        guess = busy.withColumns({"dx": F.col("dx") * scale, "dy": F.col("dy") * scale}).unionByName(own.where(F.col("levels") < level).select(*EXPOSURE, "dx", "dy"))
        guess = kept(guess, written)
    first = exposures.where("exposure_idx = 0").withColumns({"dx": F.lit(0), "dy": F.lit(0)})
    found = kept(cumulative_shifts(first.unionByName(guess)).select(*EXPOSURE, F.col("dx").cast("int").alias("dx"), F.col("dy").cast("int").alias("dy")))
    discard(spark, written)
    return found
