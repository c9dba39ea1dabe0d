"""Ghosts in brackets: patches that moved, gradients blended under them, and a merge that leaves them to one exposure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .brackets import pair_deviation
from .merge import PIXEL, merge_debevec, repair_normalize
from .pixels import RGB, row_window

GRID = 40


def patch_sizes(stack: DataFrame, grid: int = GRID) -> DataFrame:
    """(scene_id, wide, high): pixels of a patch; what a grid of `grid` x `grid` patches leaves at the right and bottom belongs to none."""
    return stack.groupBy("scene_id").agg(F.floor((F.max("x") + 1) / grid).cast("int").alias("wide"), F.floor((F.max("y") + 1) / grid).cast("int").alias("high"))


def with_patch(df: DataFrame, sizes: DataFrame) -> DataFrame:
    return df.join(sizes, "scene_id").withColumns({"px": F.floor(F.col("x") / F.col("wide")).cast("int"), "py": F.floor(F.col("y") / F.col("high")).cast("int")})


def ghost_patches(stack: DataFrame, ref: int, threshold: float, grid: int = GRID) -> DataFrame:
    """(scene_id, px, py, ghost): a patch is one where, in some exposure, more than `threshold` of its pixels differ from the reference in a channel by more than twice
    that channel's deviation. A sample of 0 against one that is not differs; two of 0 do not."""
    base = stack.where(F.col("exposure_idx") == ref).select(*PIXEL, F.col("ev").alias("ev0"), *[F.col(c).alias(f"ref_{c}") for c in RGB])
    met = stack.where(F.col("exposure_idx") != ref).join(base, PIXEL).where("ev <> ev0").join(pair_deviation(stack, ref), ["scene_id", "exposure_idx"])
    step = F.signum(F.col("ev") - F.col("ev0")) * F.ln(F.abs(F.col("ev") - F.col("ev0")))

    def far(c: str):
        a, b = F.col(c), F.col(f"ref_{c}")
        return F.when((a > 0) & (b > 0), F.abs(F.ln(a) - F.ln(b) - step) > 2 * F.col(f"dev_{c}")).otherwise((a > 0) | (b > 0))

    sizes = patch_sizes(stack, grid)
    at = with_patch(met, sizes).where((F.col("px") < grid) & (F.col("py") < grid))
    share = at.groupBy("scene_id", "exposure_idx", "px", "py").agg((F.count_if(far("r") | far("g") | far("b")) / F.first(F.col("wide") * F.col("high"))).alias("share"))
    return share.groupBy("scene_id", "px", "py").agg((F.max("share") > threshold).alias("ghost"))


def ghost_percent(patches: DataFrame, grid: int = GRID) -> DataFrame:
    """(scene_id, percent) of patches that are flagged."""
    return patches.groupBy("scene_id").agg((F.count_if("ghost") * 100.0 / (grid * grid)).alias("percent"))


def blend_gradients(grad: DataFrame, good: DataFrame, patches: DataFrame, grid: int = GRID) -> DataFrame:
    """(frame_id, x, y, gx, gy): gradients of `good` (the reference exposure) inside flagged patches (frame_id, px, py, ghost).

    On the first column of a flagged patch they are half the good gradient below and half the own one above, on its first row half the good one to the
    right and half the own one to the left (the row wins in the corner); where a frame ends there is no such neighbour and the good one stays.
    The frame's last line keeps its own.
    """
    both = grad.select("frame_id", "x", "y", "gx", "gy").join(good.select("frame_id", "x", "y", F.col("gx").alias("good_x"), F.col("gy").alias("good_y")), ["frame_id", "x", "y"])
    w, h = row_window("x"), row_window("y")
    near = {f"{n}_{c}": f(f"{kind}{c}").over(win) for c in "xy" for n, f, kind, win in (("above", F.lag, "g", h), ("below", F.lead, "good_", h), ("left", F.lag, "g", w), ("right", F.lead, "good_", w))}
    at = both.withColumns(near)
    sizes = patch_sizes(grad.withColumnRenamed("frame_id", "scene_id"), grid)
    at = with_patch(at.withColumnRenamed("frame_id", "scene_id"), sizes).join(patches.withColumnRenamed("frame_id", "scene_id"), ["scene_id", "px", "py"], "left")
    flagged = F.coalesce("ghost", F.lit(False)) & F.col("below_x").isNotNull()

    def blended(c: str):
        across = (F.col("y") % F.col("high") == 0) & F.col(f"left_{c}").isNotNull() & F.col(f"right_{c}").isNotNull()
        down = (F.col("x") % F.col("wide") == 0) & F.col(f"above_{c}").isNotNull()
        good = F.when(across, (F.col(f"right_{c}") + F.col(f"left_{c}")) / 2).when(down, (F.col(f"below_{c}") + F.col(f"above_{c}")) / 2).otherwise(F.col(f"good_{c}"))
        return F.when(flagged, good).otherwise(F.col(f"g{c}"))

    return at.select(F.col("scene_id").alias("frame_id"), "x", "y", blended("x").alias("gx"), blended("y").alias("gy"))


def select_gradients(grad: DataFrame, good: DataFrame, painted: DataFrame) -> DataFrame:
    """The same under a painted mask (frame_id, x, y): the good gradients of its pixels, the own ones elsewhere."""
    mask = painted.select("frame_id", "x", "y").distinct().withColumn("_painted", F.lit(True))
    both = grad.select("frame_id", "x", "y", "gx", "gy").join(good.select("frame_id", "x", "y", F.col("gx").alias("_x"), F.col("gy").alias("_y")), ["frame_id", "x", "y"]).join(mask, ["frame_id", "x", "y"], "left")
    return both.select("frame_id", "x", "y", *[F.when(F.col("_painted"), F.col(f"_{c}")).otherwise(F.col(f"g{c}")).alias(f"g{c}") for c in "xy"])


def merge_deghosted(stack: DataFrame, patches: DataFrame, ref: int, grid: int = GRID, weight: str = "triangular", response: str | DataFrame = "linear") -> DataFrame:
    """The merge with only the reference exposure inside flagged patches, repaired and normalised."""
    at = with_patch(stack, patch_sizes(stack, grid)).join(patches, ["scene_id", "px", "py"], "left")
    kept = at.where((F.col("exposure_idx") == ref) | ~F.coalesce("ghost", F.lit(False))).select(*stack.columns)
    return repair_normalize(merge_debevec(kept, weight, response))
