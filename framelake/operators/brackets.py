"""Work on whole brackets: the reference exposure, deviations from it, masks, shifts, names and presets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color
from .merge import PIXEL
from .pixels import RGB


def reference_exposure(stack: DataFrame) -> DataFrame:
    """(scene_id, exposure_idx, spread): the exposure whose hue is on average farthest from the mean hue of its pixels; the first of equals.

    The mean is taken over the few exposures of a pixel; all else is a partial aggregate a scene and exposure.
    """
    hue = stack.select(*PIXEL, "exposure_idx", color.rgb_to_hsl(*map(F.col, RGB))[0].alias("hue"))
    off = F.col("hue") - F.avg("hue").over(Window.partitionBy(*PIXEL))
    spread = hue.withColumn("off", off).groupBy("scene_id", "exposure_idx").agg(F.round(F.avg(F.col("off") * F.col("off")), 9).alias("spread"))
    best = spread.groupBy("scene_id").agg(F.max(F.struct("spread", (-F.col("exposure_idx")).alias("i"))).alias("best"))
    return best.select("scene_id", (-F.col("best.i")).alias("exposure_idx"), F.col("best.spread").alias("spread"))


def pair_deviation(stack: DataFrame, ref: int) -> DataFrame:
    """(scene_id, exposure_idx, dev_r, dev_g, dev_b): mean plus deviation of |ln a - ln b -+ ln |difference of EV|| against the reference.

    Pixels with a sample outside (0, 1) count as 0. Exposures with the EV of the reference have no such logarithm and are left out.
    """
    base = stack.where(F.col("exposure_idx") == ref).select(*PIXEL, F.col("ev").alias("ev0"), *[F.col(c).alias(f"ref_{c}") for c in RGB])
    met = stack.where(F.col("exposure_idx") != ref).join(base, PIXEL).where("ev <> ev0")
    samples = [*RGB, *[f"ref_{c}" for c in RGB]]
    usable = (F.greatest(*samples) < 1) & (F.least(*samples) > 0)
    step = F.signum(F.col("ev") - F.col("ev0")) * F.ln(F.abs(F.col("ev") - F.col("ev0")))
    off = {c: F.when(usable, F.abs(F.ln(F.col(c)) - F.ln(F.col(f"ref_{c}")) - step)).otherwise(0.0) for c in RGB}
    return met.select("scene_id", "exposure_idx", *[v.alias(c) for c, v in off.items()]).groupBy("scene_id", "exposure_idx").agg(*[(F.avg(c) + F.stddev_pop(c)).alias(f"dev_{c}") for c in RGB])


def combine_masks(a: DataFrame, b: DataFrame, how: str = "union") -> DataFrame:
    """Patches (scene_id, px, py) of two masks: union, intersect or subtract."""
    keys = ["scene_id", "px", "py"]
    a, b = a.select(*keys), b.select(*keys)
    combine = {"union": lambda: a.union(b).distinct(), "intersect": lambda: a.intersect(b), "subtract": lambda: a.subtract(b)}
    if how not in combine:
        raise ValueError(f"unknown way {how} of combining masks; known: {', '.join(combine)}")
    return combine[how]()


def cumulative_shifts(pairs: DataFrame) -> DataFrame:
    """Offsets to the first exposure from offsets (scene_id, exposure_idx, dx, dy) between neighbours; a window over a bracket's exposures."""
    along = Window.partitionBy("scene_id").orderBy("exposure_idx").rowsBetween(Window.unboundedPreceding, 0)
    return pairs.withColumns({"dx": F.sum("dx").over(along), "dy": F.sum("dy").over(along)})


def apply_shifts(stack: DataFrame, shifts: DataFrame) -> DataFrame:
    """Every exposure moved by its own offset, out(x, y) = in(x + dx, y + dy), zero where the source lies outside."""
    keys = [*PIXEL, "exposure_idx"]
    at = stack.join(shifts, ["scene_id", "exposure_idx"])
    moved = at.select("scene_id", (F.col("x") - F.col("dx")).cast("int").alias("x"), (F.col("y") - F.col("dy")).cast("int").alias("y"), "exposure_idx", *[F.col(c).alias(f"_{c}") for c in RGB])
    return stack.select(*keys).join(moved, keys, "left").select(*keys, *[F.coalesce(f"_{c}", F.lit(0.0)).alias(c) for c in RGB])


def output_names(bracketed: DataFrame, parameters: str, ext: str) -> DataFrame:
    """(folder_id, bracket, name, counter): first and last file of a bracket with the parameters; equal names get -2, -3 by folder and
    bracket. The counter is padded to the digits of the folder's number of brackets."""
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    named = bracketed.groupBy("folder_id", "bracket").agg(F.concat(F.min(stem), F.lit("-"), F.max(stem), F.lit(f"_{parameters}")).alias("base"))
    sizes = named.groupBy("folder_id").agg(F.count("*").alias("total"))
    again = F.row_number().over(Window.partitionBy("base").orderBy("folder_id", "bracket"))
    name = F.concat("base", F.when(F.col("again") > 1, F.concat(F.lit("-"), F.col("again").cast("string"))).otherwise(""), F.lit(f".{ext}"))
    digits = F.ceil(F.log10(F.col("total") + 1)).cast("int")
    return named.withColumn("again", again).join(sizes, "folder_id").select("folder_id", "bracket", name.alias("name"), F.lpad((F.col("bracket") + 1).cast("string"), digits, F.lit("0")).alias("counter"))


def preset_catalogue(presets: dict[str, DataFrame]) -> DataFrame:
    """(comment, tmo) of all saved presets, once each."""
    return reduce(DataFrame.union, [p.select("comment", F.lit(tmo).alias("tmo")) for tmo, p in presets.items()]).distinct()


def presets_by_comment(presets: dict[str, DataFrame], comment: str) -> DataFrame:
    """The presets of a comment over all tables; parameters that a table lacks are null."""
    found = [p.where(F.col("comment") == comment).withColumn("tmo", F.lit(tmo)) for tmo, p in presets.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
