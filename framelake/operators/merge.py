"""Exposure brackets: metadata, ranking, merging.

All exposures of a pixel meet once, on (scene, x, y); the darker exposure is found among the pixel's own rows, so no second join is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color
from .lineage import kept
from .luts import bin_lookup
from .pixels import RGB

PIXEL = ["scene_id", "x", "y"]


def exposure_metadata(tags: DataFrame) -> DataFrame:
    time, number, iso = color.exposure_time(F.col("exposure_time"), F.col("shutter_speed_value")), color.f_number(F.col("f_number"), F.col("aperture_value")), F.coalesce("iso", F.lit(100.0))
    out = tags.withColumns({"time": time, "number": number, "speed": iso})
    return out.withColumn("ev", F.log2(F.col("number") ** 2 / F.col("time"))).withColumn("avg_lum", F.col("time") * F.col("speed") / (F.col("number") ** 2 * 12.07488))


def missing_exposure(tags: DataFrame) -> DataFrame:
    return exposure_metadata(tags).where("ev is null").select("file_id", "file")


def new_files(incoming: DataFrame, loaded: DataFrame, key: str = "file") -> DataFrame:
    return incoming.join(loaded, key, "left_anti")


def ev_offset(exposures: DataFrame) -> DataFrame:
    """Lower median of a folder's EVs and every file's exposure relative to it."""
    known = exposures.where("ev is not null")
    offset = known.groupBy("folder_id").agg(F.expr("percentile_disc(0.5) within group (order by ev)").alias("ev_offset"))
    return known.join(offset, "folder_id").withColumn("relative", F.pow(F.lit(2.0), F.col("ev") - F.col("ev_offset")))


def assign_brackets(files: DataFrame, n: int) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("folder_id").orderBy("file"))
    return files.withColumn("bracket", F.floor((rn - 1) / n).cast("int")).withColumn("place", ((rn - 1) % n).cast("int"))


def validate_brackets(bracketed: DataFrame, n: int) -> DataFrame:
    """Files of each bracket, the number of different frame sizes among them (quarter turns swap width and height), and whether it is whole and of one size."""
    turned = F.col("orientation").isin(6, 8)
    size = F.struct(F.when(turned, F.col("height")).otherwise(F.col("width")).alias("w"), F.when(turned, F.col("width")).otherwise(F.col("height")).alias("h"))
    sizes = F.countDistinct(size)
    return bracketed.groupBy("folder_id", "bracket").agg(F.count("*").alias("files"), sizes.alias("sizes"), ((F.count("*") == n) & (sizes == 1)).alias("valid"))


def rank_exposures(stack: DataFrame) -> DataFrame:
    """(scene_id, exposure_idx, time, darker_idx): the next strictly darker exposure over ties, null for the darkest."""
    e = stack.select("scene_id", "exposure_idx", F.pow(F.lit(2.0), F.col("ev")).alias("time")).distinct()
    w = Window.partitionBy("scene_id").orderBy(F.col("time").desc())
    ranked = e.withColumn("rank", F.dense_rank().over(w))
    darker = F.max("exposure_idx").over(Window.partitionBy("scene_id").orderBy("rank").rangeBetween(1, 1))
    return ranked.withColumn("darker_idx", darker).drop("rank")


def darker_samples(stack: DataFrame) -> DataFrame:
    """Every sample with its time and the time and samples of the next strictly darker exposure of the same pixel; of equal ones the last in number."""
    s = stack.withColumns({"time": F.pow(F.lit(2.0), F.col("ev")), "_step": F.round(F.col("ev") * 1e6).cast("bigint")})
    before = Window.partitionBy(*PIXEL).orderBy("_step").rangeBetween(Window.unboundedPreceding, -1)
    dark = F.max(F.struct("_step", "exposure_idx", "time", *RGB)).over(before)
    return s.withColumn("_dark", dark).select(*stack.columns, "time", F.col("_dark.time").alias("dark_time"), *[F.col(f"_dark.{c}").alias(f"dark_{c}") for c in RGB])


def with_response(samples: DataFrame, response: str | DataFrame) -> DataFrame:
    """`samples` of darker_samples with res_<c>, dark_res_<c> and top_<c>, the response at full scale. A table (channel, bin, value), by scene_id too if it
    has one, is a custom response: a look-up by bin."""
    if isinstance(response, str):
        made = {f"{p}res_{c}": color.response(F.col(f"{p}{c}"), response) for c in RGB for p in ("", "dark_")}
        return samples.withColumns(made | {f"top_{c}": color.response(F.lit(1.0), response) for c in RGB})
    keys = ["scene_id"] if "scene_id" in response.columns else []
    for c in RGB:
        own = response.where(F.col("channel") == c).drop("channel")
        for p in ("", "dark_"):
            samples = bin_lookup(samples, f"{p}{c}", own, f"{p}res_{c}", keys)
        top = own.where(F.col("bin") == color.BINS - 1).select(*keys, F.col("value").alias(f"top_{c}"))
        samples = samples.join(top, keys) if keys else samples.withColumn(f"top_{c}", F.lit(top.first()[f"top_{c}"]))
    return samples


def merge_debevec(stack: DataFrame, weight: str = "triangular", response: str | DataFrame = "linear") -> DataFrame:
    """Weighted mean of ln(response) - ln(time), weights suppressed where the darker exposure shows saturation."""
    d = with_response(darker_samples(stack), response)
    w = sum(color.weight(F.col(c), weight) for c in RGB) / 3.0
    shares = F.least(F.lit(1.0), *[1 - F.pow(F.col("time") / F.col("dark_time") * F.col(f"dark_res_{c}") / F.col(f"top_{c}"), F.lit(4.0)) for c in RGB])
    d = d.withColumn("w", F.when(F.col("dark_time").isNull(), F.greatest(w, F.lit(1e-6))).otherwise(w * F.greatest(F.lit(0.0), shares)))
    logs = lambda c: F.sum(F.col("w") * (F.ln(f"res_{c}") - F.ln("time")))
    return d.groupBy(*PIXEL).agg(*[F.exp(logs(c) / F.sum("w")).alias(c) for c in RGB])


def robertson_weight(c: str, weight: str) -> Column:
    """Weight of a sample of channel c, suppressed where the darker exposure shows saturation; never 0 in the darkest exposure."""
    w = color.weight(F.col(c), weight)
    left = F.greatest(F.lit(0.0), 1 - F.pow(F.col("time") / F.col("dark_time") * F.col(f"dark_res_{c}") / F.col(f"top_{c}"), F.lit(4.0)))
    return F.when(F.col("dark_time").isNull(), F.greatest(w, F.lit(1e-6))).otherwise(w * left)


def merge_robertson(stack: DataFrame, weight: str = "triangular", response: str | DataFrame = "linear", trusted: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """sum(w r) / sum(w t) for each channel, with the same suppression. Where no weight is left, the longest time with a sample below what is trusted, or else
    the shortest with one above it, stands for the pixel; without either it is 0."""
    d = with_response(darker_samples(stack), response)
    low, high = trusted

    def ratio(c: str):
        w = robertson_weight(c, weight)
        div = F.sum(w * F.col("time"))
        dark, bright = F.max(F.when(F.col(c) < low, F.col("time"))), F.min(F.when(F.col(c) > high, F.col("time")))
        floor = F.max(F.when(F.col(c) < low, F.col(f"res_{c}")))
        return F.when(div != 0, F.sum(w * F.col(f"res_{c}")) / div).when(dark.isNotNull(), floor / dark).when(bright.isNotNull(), F.max(f"top_{c}") / bright).otherwise(0.0)

    return d.groupBy(*PIXEL).agg(*[ratio(c).alias(c) for c in RGB])


def repair_normalize(merged: DataFrame) -> DataFrame:
    """NaN channels take the first finite one (or the scene's maximum), then all go to [0, 1]; a negative makes a pixel black. The merged pixels are written once, to the
    shared folder, as they are read for the range and again for the result."""
    clean = {c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)) for c in RGB}
    first = F.coalesce(*clean.values())
    fixed = kept(merged.withColumns({c: F.coalesce(clean[c], first) for c in RGB}))
    s = fixed.groupBy("scene_id").agg(F.min(F.least(*RGB)).alias("lo"), F.max(F.greatest(*RGB)).alias("hi"))
    unit = {c: (F.coalesce(F.col(c), F.col("hi")) - F.col("lo")) / (F.col("hi") - F.col("lo")) for c in RGB}
    black = F.least(*unit.values()) < 0
    return fixed.join(s, "scene_id").select(*PIXEL, *[F.when(black, 0.0).otherwise(unit[c]).alias(c) for c in RGB])


# The weight, response and merge of the named profiles.
PROFILES = {
    "profile1": ("debevec", "triangular", "linear"), "profile2": ("debevec", "triangular", "gamma"), "profile3": ("debevec", "plateau", "linear"),
    "profile4": ("debevec", "plateau", "gamma"), "profile5": ("debevec", "gaussian", "linear"), "profile6": ("debevec", "gaussian", "gamma"),
}
MERGES = {"debevec": merge_debevec, "robertson": merge_robertson}


def get_merge(name: str):
    """The merge of a name; an unknown one is the first."""
    return MERGES.get(name.lower(), merge_debevec)


def merge(stack: DataFrame, profile: str = "profile1") -> DataFrame:
    """Merge by a profile's name; an unknown name is the first profile."""
    kind, weight, response = PROFILES.get(profile.lower(), PROFILES["profile1"])
    return get_merge(kind)(stack, weight, response)
