"""Response calibration from a bracket's own samples: merge, average time times merged value by bin, normalise, again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color
from .groups import in_groups, lines_of
from .lineage import discard, kept
from .merge import PIXEL, bin_lookup, darker_samples
from .pixels import RGB

MOST_TURNS, ENOUGH = 35, 1e-3
CURVE = ["scene_id", "channel"]


def samples_of(stack: DataFrame, weight: str) -> DataFrame:
    """A row for each sample and channel, with its weight's factors and the darker sample's value."""
    d = darker_samples(stack)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("v"), F.col(f"dark_{c}").alias("dark"), color.weight(F.col(c), weight).alias("w")) for c in RGB]))
    return d.select(*PIXEL, "time", "dark_time", each.alias("s")).select(*PIXEL, "time", "dark_time", "s.*")


def with_unit(curve: DataFrame, first: str, last: str) -> DataFrame:
    """Runs of bins `first` to `last` of equal value with `unit`, the value in the middle of the bins of their curve that are not 0 (or the next that is not 0), or 1."""
    own, lit = Window.partitionBy(*CURVE), F.col("value") != 0  # a curve's bins
    out = curve.withColumns({"a": F.min(F.when(lit, F.col(first))).over(own), "b": F.max(F.when(lit, F.col(last))).over(own)})
    out = out.withColumn("unit", F.min(F.when(lit & (F.col(last) >= F.col("a") + F.floor((F.col("b") - F.col("a")) / 2)), F.struct(first, "value"))).over(own))
    return out.withColumn("unit", F.coalesce("unit.value", F.lit(1.0))).drop("a", "b")


def normalised(curve: DataFrame) -> DataFrame:
    """A curve (scene_id, channel, bin, value) over its value in the middle of the bins that are not 0 (or the next that is not 0)."""
    return with_unit(curve, "bin", "bin").select(*CURVE, "bin", (F.col("value") / F.col("unit")).alias("value"))


def first_curves(samples: DataFrame, response: str = "linear") -> DataFrame:
    """The named response of every bin, for each scene and channel."""
    bins = samples.select(*CURVE).distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(color.BINS - 1))).alias("bin"))
    return normalised(bins.withColumn("value", named_response(F.col("bin"), response)))


def named_response(bin: Column, response: str) -> Column:
    return color.response(bin / float(color.BINS - 1) + 1e-9, response)


def looked_up(samples: DataFrame, curve: DataFrame | str) -> DataFrame:
    """Samples with res, dark_res and top: the curve at the sample's bin, at the darker one's and at the last."""
    if not isinstance(curve, str):
        top = curve.where(F.col("bin") == color.BINS - 1).select(*CURVE, F.col("value").alias("top"))
        return bin_lookup(bin_lookup(samples, "v", curve, "res", CURVE), "dark", curve, "dark_res", CURVE).join(top, CURVE)
    bins = samples.sparkSession.range(color.BINS).select(F.lit(0).alias("scene_id"), F.lit("").alias("channel"), F.col("id").cast("int").alias("bin"))
    unit = with_unit(bins.withColumn("value", named_response(F.col("bin"), curve)), "bin", "bin").first()["unit"]
    at = lambda c: named_response(F.floor(F.col(c) * float(color.BINS - 1)).cast("int"), curve) / unit
    return samples.withColumns({"res": at("v"), "dark_res": at("dark"), "top": named_response(F.lit(color.BINS - 1), curve) / unit})


def merged_samples(samples: DataFrame, curve: DataFrame | str) -> DataFrame:
    """(scene_id, channel, time, v, merged): every sample with the merged value of its pixel and channel under the curve."""
    at = looked_up(samples, curve)
    left = F.greatest(F.lit(0.0), 1 - F.pow(F.col("time") / F.col("dark_time") * F.col("dark_res") / F.col("top"), F.lit(4.0)))
    w = F.when(F.col("dark_time").isNull(), F.greatest(F.col("w"), F.lit(1e-6))).otherwise(F.col("w") * left)
    pixel = Window.partitionBy(*PIXEL, "channel")
    div = F.sum(w * F.col("time")).over(pixel)
    return at.select(*CURVE, "time", "v", F.when(div != 0, F.sum(w * F.col("res")).over(pixel) / div).otherwise(0.0).alias("merged"))


def calibrate_turn(samples: DataFrame, curve: DataFrame | str) -> DataFrame:
    """The next curve: time times merged value on average by bin, an empty bin as the one before it, normalised. The curve before is a table (scene_id, channel, bin,
    value), or the name of a response: that of first_curves, which then needs no table. Bins are filled in at last, from the runs of equal ones."""
    at = merged_samples(samples, curve).withColumn("bin", F.floor(F.col("v") * float(color.BINS - 1)).cast("int"))
    means = at.groupBy(*CURVE, "bin").agg(F.avg(F.col("time") * F.col("merged")).alias("value"))
    if not isinstance(curve, str):
        means = curve.where(F.col("bin") == color.BINS - 1).select(*CURVE).join(means, CURVE, "left")
    along = Window.partitionBy(*CURVE).orderBy("bin")
    runs = means.withColumns({"first": F.coalesce("bin", F.lit(0)), "last": F.lead("bin", 1, color.BINS).over(along) - 1, "begins": F.row_number().over(along) == 1})
    runs = with_unit(runs.withColumn("value", F.coalesce("value", F.lit(0.0))), "first", "last")
    bins = F.explode(F.sequence(F.when(F.col("begins"), 0).otherwise(F.col("first")), F.col("last")))
    filled = runs.select(*CURVE, "first", (F.col("value") / F.col("unit")).alias("value"), bins.alias("bin"))
    return filled.select(*CURVE, "bin", F.when(F.col("bin") < F.col("first"), 0.0).otherwise(F.col("value")).alias("value"))


FOLDED = 1_000_000  # distinct sample tuples of a scene and channel that one task folds; with more of them, a curve takes some jobs a turn


def sample_tuples(stack: DataFrame, weight: str) -> DataFrame:
    """(scene_id, channel, times, values, weights, n): how many pixels have these samples in a channel, darkest first."""
    step = F.round(F.col("ev") * 1e6).cast("bigint")
    one = F.struct(step.alias("step"), F.col("exposure_idx").alias("i"), F.pow(F.lit(2.0), F.col("ev")).alias("time"), *RGB)
    pixel = stack.groupBy(*PIXEL).agg(F.sort_array(F.collect_list(one)).alias("s"))  # as many as a bracket has exposures
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"s.{c}").alias("values")) for c in RGB])).alias("c")
    flat = pixel.select("scene_id", F.col("s.step").alias("steps"), F.col("s.time").alias("times"), each).select("scene_id", "c.channel", "steps", "times", "c.values")
    counts = flat.groupBy("scene_id", "channel", "steps", "times", "values").agg(F.count("*").alias("n"))
    return counts.withColumn("weights", F.transform("values", lambda v: color.weight(v, weight)))


def calibrate_response(stack: DataFrame, weight: str = "triangular", response: str = "linear", turns: int = MOST_TURNS, enough: float = ENOUGH) -> DataFrame:
    """(scene_id, channel, bin, value): the response of each scene and channel, turned until its mean square change is below `enough`.

    Pixels are first counted by their tuples of samples, which is all that a turn needs. All turns of up to FOLDED tuples are folded in one task;
    the others run turn by turn over the samples themselves.
    """
    spark, written = stack.sparkSession, []
    tuples = kept(sample_tuples(stack, weight), written)
    many = kept(tuples.groupBy(*CURVE).agg(F.count("*").alias("m")).where(F.col("m") > FOLDED).select(*CURVE), written)
    runs = turned_runs(tuples.join(many, CURVE, "left_anti"), response, turns, enough)
    if not many.isEmpty():
        others = turned_by_jobs(samples_of(stack, weight).join(many, CURVE, "left_semi"), response, turns, enough)
        runs = runs.unionByName(others.select(*CURVE, F.col("bin").alias("first"), F.col("bin").alias("last"), "value"))
    found = kept(runs)
    discard(spark, written)
    return every_bin(found)


def every_bin(runs: DataFrame) -> DataFrame:
    return runs.select(*CURVE, F.explode(F.sequence("first", "last")).alias("bin"), "value")


def turned_at_once(tuples: DataFrame, response: str, turns: int, enough: float) -> DataFrame:
    """All turns of each curve over its tuples of samples."""
    return every_bin(turned_runs(tuples, response, turns, enough))


def turned_runs(tuples: DataFrame, response: str, turns: int, enough: float) -> DataFrame:
    """(scene_id, channel, first, last, value): runs of equal bins after all turns of each curve over its tuples of samples."""
    bins, last = color.BINS, color.BINS - 1
    start = [r[0] for r in tuples.sparkSession.range(bins).select("id", named_response(F.col("id"), response).alias("v")).orderBy("id").select("v").collect()]  # one number a bin

    def fold(part):
        """First bins of the runs of a curve's equal bins, and their values."""
        import numpy as np

        size = part["values"].map(len).to_numpy()
        own, flat = np.repeat(np.arange(len(part)), size), lambda c, kind: np.concatenate([np.asarray(x, kind) for x in part[c]])
        steps, times, values, w, n = flat("steps", np.int64), flat("times", float), flat("values", float), flat("weights", float), part["n"].to_numpy(float)[own]
        begins = np.r_[True, (own[1:] != own[:-1]) | (steps[1:] != steps[:-1])]  # of samples as dark as each other
        first = np.maximum.accumulate(np.where(begins, np.arange(len(own)), 0))
        dark = np.where((first > 0) & (own[first - 1] == own), first - 1, -1)  # the last one of those before them
        place, n_time = np.floor(values * last).astype(int), n * times

        def unit(curve):
            lit = np.flatnonzero(curve)
            return curve / curve[lit[lit >= lit[0] + (lit[-1] - lit[0]) // 2][0]] if len(lit) else curve

        curve = known = unit(np.array(start))
        for _ in range(turns):
            with np.errstate(all="ignore"):
                res = curve[place]
                left = np.maximum(0.0, 1 - (times / times[dark] * res[dark] / curve[last]) ** 4)
            weight = np.where(dark < 0, np.maximum(w, 1e-6), w * left)
            above, below = np.bincount(own, weight * res), np.bincount(own, weight * times)
            merged = np.divide(above, below, out=np.zeros_like(above), where=below != 0)
            total, count = np.bincount(place, n_time * merged[own], bins), np.bincount(place, n, bins)
            there = np.maximum.accumulate(np.where(count > 0, np.arange(bins), -1))  # an empty bin is as the one before it
            means = np.divide(total, count, out=np.zeros(bins), where=count > 0)
            new = unit(np.where(there >= 0, means[there], 0.0))
            lit, curve = new != 0, new
            if lit.any() and not ((new[lit] - known[lit]) ** 2).mean() >= enough:
                break
            known = np.where(lit, new, known)
        first = np.flatnonzero(np.r_[True, curve[1:] != curve[:-1]])
        return first, curve[first]

    def run(frame):
        import numpy as np
        import pandas as pd

        begin = lines_of(frame, CURVE)[0]
        found = [fold(frame.iloc[a:b]) for a, b in zip(begin, [*begin[1:], len(frame)], strict=True)]
        own = frame[CURVE].iloc[np.repeat(begin, [len(f) for f, _ in found])].reset_index(drop=True)
        return own.assign(first=np.concatenate([f for f, _ in found]), last=np.concatenate([np.r_[f[1:], bins] - 1 for f, _ in found]), value=np.concatenate([v for _, v in found]))

    return in_groups(tuples, CURVE, ["times", "values"], run, "scene_id bigint, channel string, first int, last int, value double")


def turned_by_jobs(samples: DataFrame, response: str, turns: int, enough: float) -> DataFrame:
    """The same over samples, turn by turn: two look-ups, one window by pixel and one aggregation by bin. Curves that are done drop out. What a turn reads is
    kept in the shared folder, and deleted when the next one is done."""
    spark, written, older, made, done = samples.sparkSession, [], [], [], []
    samples = kept(samples.repartition(*PIXEL, "channel"), written)
    curve = known = kept(first_curves(samples, response), written)
    for _ in range(turns):
        made = []
        new = kept(calibrate_turn(samples, curve), made)  # scenes and channels without a curve have dropped out
        both = new.join(known.withColumnRenamed("value", "old"), [*CURVE, "bin"])
        change = both.where("value <> 0").groupBy(*CURVE).agg(F.avg((F.col("value") - F.col("old")) ** 2).alias("change"))
        ready = kept(change.where(~(F.col("change") >= enough)).select(*CURVE), made)
        done.append(kept(new.join(ready, CURVE, "left_semi")))
        curve = kept(new.join(ready, CURVE, "left_anti"), made)
        if curve.isEmpty():
            break
        known = kept(both.select(*CURVE, "bin", F.when(F.col("value") != 0, F.col("value")).otherwise(F.col("old")).alias("value")), made)
        discard(spark, older)
        older = made
    curves = [*done, kept(curve)]
    discard(spark, written + older + made)
    return reduce(DataFrame.unionByName, curves)
