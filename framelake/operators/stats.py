"""Frame statistics: partial aggregation by frame, tiny results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color
from .lineage import discard, kept
from .pixels import RGB


def luminance(df: DataFrame) -> DataFrame:
    return df.withColumn("lum", color.rgb_to_y(*map(F.col, RGB)))


def with_stats(df: DataFrame, stats: DataFrame, keys=("frame_id",)) -> DataFrame:
    """Join a frame's statistics to its pixels. The statistics have a row a frame; the engine picks broadcast or shuffle by their size."""
    return df.join(stats, list(keys))


def inspect(df: DataFrame, col: str, keys=("frame_id",)) -> DataFrame:
    """Samples, minimum, maximum, NaN and infinite counts of a column; both kinds stay out of the extremes."""
    c = F.col(col)
    inf = F.abs(c) == float("inf")
    fine = F.when(~F.isnan(c) & ~inf, c)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(fine).alias("lo"), F.max(fine).alias("hi"), F.count_if(F.isnan(c)).alias("nans"), F.count_if(inf).alias("infs"))


def frame_minmax(df: DataFrame, keys=("frame_id",)) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(F.least(*RGB)).alias("lo"), F.max(F.greatest(*RGB)).alias("hi"))


def log_average(df: DataFrame, col: str, eps: float, keys=("frame_id",)) -> DataFrame:
    return df.groupBy(*keys).agg(F.exp(F.avg(F.ln(F.col(col) + eps))).alias("log_avg"))


def luminance_properties(df: DataFrame, brightness: float = 0.0, also: tuple[Column, ...] = ()) -> DataFrame:
    """Extremes, averages, key, contrast and brightness of a frame's luminance, with `also`, further aggregates of the same pass."""
    base = df.groupBy("frame_id").agg(*also, F.ln(F.max("lum")).alias("ln_max"), F.ln(F.min("lum")).alias("ln_min"), F.avg(F.ln(F.col("lum") + 2.3e-5)).alias("adapted"), F.avg("lum").alias("mean"))
    out = base.withColumn("key", (F.col("ln_max") - F.col("adapted")) / (F.col("ln_max") - F.col("ln_min")))
    return out.withColumn("contrast", 0.3 + 0.7 * F.pow("key", F.lit(1.4))).withColumn("bright", F.lit(2.718281828459045) ** F.lit(-brightness))


def dot(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy("frame_id").agg(F.sum(F.col(a) * F.col(b)).alias("dot"), F.sum(a).alias("total"), F.sum(F.col(a) * F.col(a)).alias("squares"))


def histogram(df: DataFrame, value: Column, keys=("frame_id",)) -> DataFrame:
    """Counts by bin; `value` is the bin of a row, null for rows that are not counted."""
    return df.withColumn("bin", value).where("bin is not null").groupBy(*keys, "bin").agg(F.count("*").alias("n"))


def floor_bin(c: Column, lo: Column, hi: Column, bins: int, reject: bool = True) -> Column:
    """Bins of equal width; what lies outside is not counted, or counts in the first and last bin."""
    i = F.floor((c - lo) / (hi - lo) * float(bins)).cast("int")
    return F.when((i >= 0) & (i < bins), i) if reject else F.greatest(F.lit(0), F.least(F.lit(bins - 1), i))


def histogram_256(df: DataFrame, col: str, keys=("frame_id",)) -> DataFrame:
    """(keys, bin, share) of 8-bit samples: counts over the largest count."""
    hist = histogram(df, F.col(col).cast("int"), keys)
    top = hist.groupBy(*keys).agg(F.max("n").alias("top"))
    return hist.join(top, list(keys)).select(*keys, "bin", (F.col("n") / F.col("top")).alias("share"))


def binned_percentiles(df: DataFrame, col: str, shares: dict[str, float], keys=("frame_id",), bins: int = 1000) -> DataFrame:
    """(keys, a column for each share in percent) from a cumulated histogram, interpolated between the centres of its bins."""
    span = df.groupBy(*keys).agg(F.min(col).alias("lo"), F.max(col).alias("hi"), F.count("*").alias("total"))
    at = with_stats(df.select(*keys, col), span, keys)
    group = [*keys, "lo", "hi", "total"]
    hist = at.groupBy(*group, F.coalesce(floor_bin(F.col(col), F.col("lo"), F.col("hi"), bins, reject=False), F.lit(0)).alias("bin")).agg(F.count("*").alias("n"))
    cum = hist.withColumn("cum", F.sum("n").over(Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
    width = (F.col("hi") - F.col("lo")) / float(bins)
    def reached(percent: float) -> Column:
        wanted = F.floor(percent * F.col("total") / 100)
        inside = F.min(F.when(F.col("cum") > wanted, F.struct("bin", (F.col("bin") - 0.5 + (wanted - F.col("cum") + F.col("n")) / F.col("n")).alias("place"))))
        place = F.when(F.first(wanted) <= F.min(F.when(F.col("bin") == 0, F.col("cum"))), F.lit(0.5)).when(inside.isNull(), F.lit(bins - 0.5)).otherwise(inside["place"])
        return F.first("lo") + F.first(width) * place

    return cum.groupBy(*keys).agg(*[reached(p).alias(name) for name, p in shares.items()])


def rounded_bin(c: Column, lo: Column, hi: Column, bins: int) -> Column:
    return F.floor((c - lo) / (hi - lo) * float(bins - 1) + 0.5).cast("int")


def cumulate(hist: DataFrame, keys=("frame_id",)) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("bin")
    return hist.withColumn("cum", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))


FINE_BITS = 10  # a coarse bin holds 2^10 fine ones


def channel_quantiles(df: DataFrame, columns, lo_share: float, hi_share: float, bins: int = 65535) -> DataFrame:
    """(frame_id, from_<c>, to_<c> of each column): edges of the bins in which the cumulated histograms reach the shares.

    All columns go together: one pass for their spans, one for the counts of coarse bins, and one for the bins inside those coarse ones that
    hold a quantile. So no more than some hundred counts a frame and column are shuffled, and few samples are counted twice.
    """
    span = df.groupBy("frame_id").agg(F.count("*").alias("total"), *[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    at = with_stats(df.select("frame_id", *columns), span)
    kinds = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.coalesce(rounded_bin(F.col(c), F.col(f"lo_{c}"), F.col(f"hi_{c}"), bins), F.lit(0)).alias("bin")) for c in columns]))
    each = at.select("frame_id", "total", kinds.alias("k")).select("frame_id", "total", "k.channel", "k.bin", F.shiftright("k.bin", FINE_BITS).alias("coarse"))
    key = ["frame_id", "channel"]
    hist = each.groupBy(*key, "total", "coarse").agg(F.count("*").alias("n"))
    cum = F.sum("n").over(Window.partitionBy(*key).orderBy("coarse").rowsBetween(Window.unboundedPreceding, 0))
    first = lambda share: F.min(F.when(F.col("cum") >= share * F.col("total"), F.struct("coarse", (F.col("cum") - F.col("n")).alias("before"))))
    held = hist.withColumn("cum", cum).groupBy(*key).agg(first(lo_share).alias("a"), first(hi_share).alias("b"))
    near = each.join(held, key).where((F.col("coarse") == F.col("a.coarse")) | (F.col("coarse") == F.col("b.coarse")))
    fine = near.groupBy(*key, "total", "a", "b", "coarse", "bin").agg(F.count("*").alias("n"))
    fine = fine.withColumn("cum", F.sum("n").over(Window.partitionBy(*key, "coarse").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
    reached = lambda e, share: (F.col("coarse") == F.col(f"{e}.coarse")) & (F.col(f"{e}.before") + F.col("cum") >= share * F.col("total"))
    ends = [F.min(F.when((F.col("channel") == c) & reached(e, share), F.col("bin"))).alias(f"{e}_{c}") for c in columns for e, share in (("a", lo_share), ("b", hi_share))]
    edges = with_stats(fine.groupBy("frame_id").agg(*ends), span)
    edge = lambda n, c: F.col(f"lo_{c}") + F.col(f"{n}_{c}") * (F.col(f"hi_{c}") - F.col(f"lo_{c}")) / float(bins - 1)
    return edges.select("frame_id", *[e for c in columns for e in (edge("a", c).alias(f"from_{c}"), edge("b", c).alias(f"to_{c}"))])


def hist_quantiles(df: DataFrame, col: str, lo_share: float, hi_share: float, bins: int = 65535) -> DataFrame:
    """(frame_id, q_lo, q_hi) of one column."""
    return channel_quantiles(df, (col,), lo_share, hi_share, bins).select("frame_id", F.col(f"from_{col}").alias("q_lo"), F.col(f"to_{col}").alias("q_hi"))


MEDIAN_BINS, MEDIAN_PASSES = 4096, 2


def ranked_value(df: DataFrame, col: str, share: float = 0.5) -> DataFrame:
    """(frame_id, value, mean): of each frame's n values that one of rank ceil(share * n), by narrowing its interval.

    Each pass counts the values of the interval in MEDIAN_BINS bins and goes on with the least and greatest value of the bin that holds the rank;
    what is left is counted value by value. So no frame is gathered or sorted, ties are exact, and only counts are shuffled. Nulls do not count.
    """
    values = df.select("frame_id", F.col(col).alias("v")).where("v is not null")
    bounds = values.groupBy("frame_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.ceil(share * F.count("*")).alias("rank"), F.avg("v").alias("mean"))
    known = ["frame_id", "rank", "mean"]
    for _ in range(MEDIAN_PASSES):
        at = with_stats(values, bounds).where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        place = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(MEDIAN_BINS - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * MEDIAN_BINS).cast("int"))).otherwise(0)
        bins = at.groupBy(*known, place.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        bins = bins.withColumn("cum", F.sum("n").over(Window.partitionBy("frame_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
        found = F.min(F.when(F.col("cum") >= F.col("rank"), F.struct("bin", "lo", "hi", (F.col("rank") - F.col("cum") + F.col("n")).alias("rank")))).alias("f")
        bounds = bins.groupBy("frame_id", "mean").agg(found).select("frame_id", "mean", "f.lo", "f.hi", "f.rank")
    left = with_stats(values, bounds).where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))).groupBy(*known, "v").agg(F.count("*").alias("n"))
    left = left.withColumn("cum", F.sum("n").over(Window.partitionBy("frame_id").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    return left.where("cum >= rank").groupBy("frame_id", "mean").agg(F.min("v").alias("value")).select("frame_id", "value", "mean")


def robust_center(df: DataFrame, col: str) -> DataFrame:
    """sqrt(mean * lower median)."""
    return ranked_value(df, col).select("frame_id", F.sqrt(F.col("mean") * F.col("value")).alias("center"))


def minkowski_mean(df: DataFrame, p: float = 6.0) -> DataFrame:
    return df.groupBy("frame_id").agg(*[F.pow(F.avg(F.pow(c, F.lit(p))), F.lit(1 / p)).alias(c) for c in RGB])


def dynamic_range_window(df: DataFrame) -> DataFrame:
    """log10 of the extremes (floor 1e-6), widened to half a decade."""
    w = df.groupBy("frame_id").agg(F.log10(F.greatest(F.min("lum"), F.lit(1e-6))).alias("lo"), F.log10(F.greatest(F.max("lum"), F.lit(1e-6))).alias("hi"))
    short = F.greatest(0.5 - (F.col("hi") - F.col("lo")), F.lit(0.0)) / 2
    return w.select("frame_id", (F.col("lo") - short).alias("lo"), (F.col("hi") + short).alias("hi"))


def stats_rollup(stack: DataFrame, col: str = "g", eps: float = 1e-6) -> DataFrame:
    """The inspector's numbers and both averages of a column per exposure, scene and corpus; NaN and infinite samples are counted, and left out of the rest."""
    c = F.col(col)
    odd = F.isnan(c) | (F.abs(c) == float("inf"))
    fine = F.when(~odd, c)
    return stack.rollup("scene_id", "exposure_idx").agg(
        F.count("*").alias("n"), F.min(fine).alias("lo"), F.max(fine).alias("hi"), F.avg(fine).alias("mean"), F.exp(F.avg(F.ln(fine + eps))).alias("log_avg"),
        F.count_if(F.isnan(c)).alias("nans"), F.count_if(F.abs(c) == float("inf")).alias("infs"),
    )


def top_frames(stats: DataFrame, by: str, k: int) -> DataFrame:
    return stats.orderBy(F.desc(by), "frame_id").limit(k)


def wb_color_balance(df: DataFrame, lo: float = 0.005, hi: float = 0.995) -> DataFrame:
    """Each channel clamped and normalised between two histogram quantiles; odd shares are mended and swapped."""
    lo, hi = sorted((max(lo, 0.0), min(hi, 1.0)))
    at = with_stats(df, channel_quantiles(df, RGB, lo, hi))
    unit = {c: color.normalize(color.clamp(F.col(c), F.col(f"from_{c}"), F.col(f"to_{c}")), F.col(f"from_{c}"), F.col(f"to_{c}")) for c in RGB}
    return at.withColumns(unit).drop(*[f"{n}_{c}" for c in RGB for n in ("from", "to")])


def wb_shades_of_gray(df: DataFrame, p: float = 6.0) -> DataFrame:
    gains = minkowski_mean(df, p).select("frame_id", *[(F.greatest(*RGB) / F.col(c)).alias(f"gain_{c}") for c in RGB])
    return with_stats(df, gains).withColumns({c: F.col(c) * F.col(f"gain_{c}") for c in RGB}).drop(*[f"gain_{c}" for c in RGB])


FOLDED = 2_000_000  # colours of a frame that one task folds; a frame with more of them takes a job a turn


def wb_robust(df: DataFrame, max_iter: int = 1000, u: float = 0.3, a: float = 0.8, b: float = 0.001, c: float = 10.0, t: float = 0.3) -> DataFrame:
    """(frame_id, gain_r, gain_b) of iterated grey-pixel balance.

    Pixels are first counted by colour, which is all that a turn needs. All turns of a frame of up to FOLDED colours are folded in one task, so
    they take one job together; frames with more colours take a job a turn over their counts, and drop out of the next turn once they have converged.
    """
    spark, written = df.sparkSession, []
    counts = kept(df.groupBy("frame_id", *RGB).agg(F.count("*").alias("n")), written)
    many = kept(counts.groupBy("frame_id").agg(F.count("*").alias("m")).where(F.col("m") > FOLDED).select("frame_id"), written)
    gains = balanced_at_once(counts.join(many, "frame_id", "left_anti"), max_iter, u, a, b, c, t)
    if not many.isEmpty():
        gains = gains.unionByName(balanced_by_turns(counts.join(many, "frame_id", "left_semi"), max_iter, u, a, b, c, t))
    found = kept(gains)
    discard(spark, written)
    return found


def balanced_at_once(counts: DataFrame, max_iter: int, u: float, a: float, b: float, c: float, t: float) -> DataFrame:
    """All turns of a frame over its colours (frame_id, r, g, b, n)."""
    yuv = color.RGB_TO_YUV

    def fold(part):
        import numpy as np
        import pandas as pd

        red, green, blue, n = (part[x].to_numpy(float) for x in (*RGB, "n"))
        gain_r = gain_b = 1.0
        for _ in range(max_iter):
            y, uu, vv = (k[0] * red * gain_r + k[1] * green + k[2] * blue * gain_b for k in yuv)
            with np.errstate(all="ignore"):
                grey = ((np.abs(uu) + np.abs(vv)) / y < t) & (y != 0)
            total = n[grey].sum()
            if not total:
                break
            ub, vb = (uu[grey] @ n[grey]) / total, (vv[grey] @ n[grey]) / total
            err = ub if abs(ub) > abs(vb) else vb
            if abs(err) >= c or abs(err) < b:
                break
            delta = 2 * np.sign(err) * u if abs(err) >= a else err * u
            gain_r, gain_b = (gain_r, gain_b - delta) if abs(ub) > abs(vb) else (gain_r - delta, gain_b)
        return pd.DataFrame({"frame_id": [part["frame_id"].iat[0]], "gain_r": [float(gain_r)], "gain_b": [float(gain_b)]})

    return counts.groupBy("frame_id").applyInPandas(fold, "frame_id bigint, gain_r double, gain_b double")


def balanced_by_turns(counts: DataFrame, max_iter: int, u: float, a: float, b: float, c: float, t: float) -> DataFrame:
    """The same, each turn one aggregation by frame. What a turn reads is kept in the shared folder, and deleted two turns later."""
    spark, old, older = counts.sparkSession, [], []
    gains = counts.select("frame_id").distinct().select("frame_id", F.lit(1.0).alias("gain_r"), F.lit(1.0).alias("gain_b"), F.lit(False).alias("done"))
    for _ in range(max_iter):
        at = counts.join(gains.where(~F.col("done")), "frame_id")
        y, uu, vv = color.rgb_to_yuv(F.col("r") * F.col("gain_r"), F.col("g"), F.col("b") * F.col("gain_b"))
        n = F.when((F.abs(uu) + F.abs(vv)) / y < t, F.col("n"))
        bars = at.groupBy("frame_id").agg((F.sum(uu * n) / F.sum(n)).alias("ub"), (F.sum(vv * n) / F.sum(n)).alias("vb"))
        err = F.when(F.abs("ub") > F.abs("vb"), F.col("ub")).otherwise(F.col("vb"))
        stop = F.col("ub").isNull() | (F.abs(err) >= c) | (F.abs(err) < b)
        delta = F.when(stop, 0.0).when(F.abs(err) >= a, 2 * F.sign(err) * u).otherwise(err * u)
        blue = F.abs("ub") > F.abs("vb")
        step = bars.select("frame_id", F.when(blue, 0.0).otherwise(delta).alias("dr"), F.when(blue, delta).otherwise(0.0).alias("db"), stop.alias("stop"))
        gains = gains.join(step, "frame_id", "left").select("frame_id", (F.col("gain_r") - F.coalesce("dr", F.lit(0.0))).alias("gain_r"), (F.col("gain_b") - F.coalesce("db", F.lit(0.0))).alias("gain_b"), (F.col("done") | F.coalesce("stop", F.lit(False))).alias("done"))
        discard(spark, older)
        older, old = old, []
        gains = kept(gains, old)
        if gains.where(~F.col("done")).isEmpty():
            break
    discard(spark, older)
    return gains.select("frame_id", "gain_r", "gain_b")
