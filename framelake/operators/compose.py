"""Frames from separate channels, tags from one file to another, and panoramas from one projection to another."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color
from .pixels import RGB, frame_sizes

PIXEL = ["frame_id", "x", "y"]
CHANNELS = ("r", "g", "b", "lum", "alpha")


def compose_channels(channels: dict[str, DataFrame], gains: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """One colour frame from mono frames (frame_id, x, y, value) of r, g, b, lum and alpha: all normalised by the frame's extremes over the channels that are there, times
    a gain each; a channel that is missing is 0, lum replaces the lightness, alpha is added to red."""
    if unknown := set(channels) - set(CHANNELS):
        raise ValueError(f"unknown channels {sorted(unknown)}; known: {', '.join(CHANNELS)}")
    rows = reduce(DataFrame.unionByName, [d.select(*PIXEL, F.lit(name).alias("channel"), "value") for name, d in channels.items()])
    span = rows.groupBy("frame_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    unit = rows.join(span, "frame_id").withColumn("unit", color.normalize(F.col("value"), F.col("lo"), F.col("hi")))
    wide = unit.groupBy(*PIXEL).agg(*[F.coalesce(F.max(F.when(F.col("channel") == c, F.col("unit"))), F.lit(0.0)).alias(c) for c in CHANNELS])
    rgb = wide.withColumns({c: F.col(c) * g for c, g in zip(RGB, gains, strict=True)})
    if "lum" in channels:
        h, s, _ = color.rgb_to_hsl(*map(F.col, RGB))
        rgb = rgb.withColumns({"_h": h, "_s": s})
        rgb = rgb.withColumns(dict(zip(RGB, color.hsl_to_rgb(F.col("_h"), F.col("_s"), F.col("lum")), strict=True)))
    return rgb.select(*PIXEL, (F.col("r") + F.col("alpha")).alias("r"), "g", "b")


# The tags that go from one file to another.
IMAGE_TAGS = (
    "Software ImageDescription Orientation Make Model DateTime ProcessingSoftware GPSTag SensingMethod MaxApertureValue SelfTimerMode ShutterSpeedValue ApertureValue ExposureBiasValue SubjectDistance MeteringMode"
    " CameraSerialNumber LensInfo ExposureTime FNumber ExposureProgram"
)
PHOTO_TAGS = (
    "SensitivityType ISOSpeed ISOSpeedRatings ISOSpeedLatitudeyyy ISOSpeedLatitudezzz FileSource SceneType SceneCaptureType UserComment ShutterSpeedValue ApertureValue BrightnessValue ExposureBiasValue MaxApertureValue"
    " SubjectDistance MeteringMode LightSource Flash FocalLength SubjectArea ExposureMode DigitalZoomRatio FocalLengthIn35mmFilm BodySerialNumber LensSpecification LensMake LensModel LensSerialNumber DateTimeOriginal"
    " DateTimeDigitized ExposureTime FNumber ExposureProgram"
)
CARRIED = tuple(f"Exif.Image.{t}" for t in IMAGE_TAGS.split()) + tuple(f"Exif.Photo.{t}" for t in PHOTO_TAGS.split())
ORIENTATION = "Exif.Image.Orientation"


def carried(tags: Column) -> Column:
    """The tags that may be carried: the listed ones and all of GPS, none of a thumbnail."""
    group = lambda k: F.element_at(F.split(k, "[.]"), 2)
    return F.map_filter(tags, lambda k, _: (group(k) == "GPSInfo") | (group(k) != "Thumbnail") & k.isin(*CARRIED))


def transplant_tags(src: DataFrame, dst: DataFrame, mode: str = "keep", comment: str = "", keep_rotation: bool = False, software: str = "framelake") -> DataFrame:
    """(file, tags) of `dst` with tags of `src`, the i-th file by name of a folder giving to the i-th. Both are (folder_id, file, tags).

    keep: a target's own tags hold; replace: it has only what is carried, and the comment if there is one; verbatim: all tags of the source. But for
    verbatim the orientation becomes 1. A target without a source keeps what it has.
    """
    place = F.row_number().over(Window.partitionBy("folder_id").orderBy("file"))
    left = dst.select("folder_id", "file", F.coalesce("tags", F.create_map().cast("map<string,string>")).alias("own"), place.alias("_i"))
    right = src.select("folder_id", F.coalesce("tags", F.create_map().cast("map<string,string>")).alias("from"), place.alias("_i"))
    both = left.join(right, ["folder_id", "_i"], "left")
    without = lambda tags, names: F.map_filter(tags, lambda k, _: ~k.isin(*names))
    extra = {} if keep_rotation else {ORIENTATION: "1"}
    if mode == "keep":
        made = F.map_concat("own", F.map_filter(carried(F.col("from")), lambda k, _: ~F.map_contains_key("own", k)))
    elif mode == "replace":
        made = carried(F.col("from"))
        if comment:
            extra |= {"Exif.Image.ProcessingSoftware": software, "Exif.Image.Software": software, "Exif.Image.ImageDescription": comment, "Exif.Photo.UserComment": f'charset="Ascii" {comment}'}
    elif mode == "verbatim":
        made, extra = F.col("from"), {}
    else:
        raise ValueError(f"unknown mode {mode}; known: keep, replace, verbatim")
    if extra:
        made = F.map_concat(without(made, list(extra)), F.create_map(*[F.lit(x) for pair in extra.items() for x in pair]))
    return both.select("folder_id", "file", F.when(F.col("from").isNull(), F.col("own")).otherwise(made).alias("tags"))


Vector = tuple[Column, Column, Column]
NEAR = 1e-7


def ball_direction(u: Column, v: Column, turn: Column) -> Vector:
    """Direction of a point of a disc, `turn` giving the angle to the axis from the distance to the centre."""
    phi, theta = F.atan2(v, u), turn
    return F.cos(phi) * F.sin(theta), -F.sin(phi) * F.sin(theta), F.cos(theta)


def disc_point(d: Vector, reach: Column) -> tuple[Column, Column]:
    """Point of a disc, `reach` being its distance to the centre."""
    x, y = d[0], -d[1]
    far = F.sqrt(x * x + y * y)
    return F.when(far > 0, x * reach / far + 0.5).otherwise(0.5), F.when(far > 0, y * reach / far + 0.5).otherwise(0.5)


def globe_point(d: Vector, v: Column, sine: Column) -> tuple[Column, Column]:
    """Longitude and the given height v; the poles have longitude 0."""
    ratio = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -d[2] / sine))
    lon = F.acos(ratio) / (2 * math.pi)
    u = F.when(d[0] < 0, lon).otherwise(1 - lon)
    pole = (v < NEAR) | (F.abs(1 - v) < NEAR)
    return F.when(pole | (u == 1), 0.0).otherwise(u), F.when(~pole & (v == 1), 0.0).otherwise(v)


def unit_disc(u: Column, v: Column) -> Column:
    return (u - 0.5) * (u - 0.5) + (v - 0.5) * (v - 0.5) <= 0.25


def project_to(name: str, d: Vector, angle: float) -> tuple[Column, Column]:
    within = lambda c: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))
    if name == "mirrorball":
        return disc_point(d, 0.5 * F.sin(F.acos(within(d[2])) / 2))
    if name == "angular":
        return disc_point(d, F.acos(within(d[2])) / (2 * math.pi))
    lat = F.acos(within(d[1]))
    return globe_point(d, (1 - d[1]) / 2 if name == "cylindrical" else lat / math.pi, F.sin(lat))


def direction_of(name: str, u: Column, v: Column, angle: float) -> Vector:
    if name in ("mirrorball", "angular"):
        share = 1.0 if name == "mirrorball" else angle / 360
        a, b = (2 * u - 1) * share, (2 * v - 1) * share
        far = F.sqrt(a * a + b * b)
        return ball_direction(a, b, 2 * F.asin(F.least(far, F.lit(1.0))) if name == "mirrorball" else math.pi * far)
    phi, theta = (0.75 - u) * (2 * math.pi), F.acos(1 - 2 * v) if name == "cylindrical" else v * math.pi
    return F.cos(phi) * F.sin(theta), F.cos(theta), F.sin(phi) * F.sin(theta)


def rotated(d: Vector, degrees: tuple[float, float, float]) -> Vector:
    """Turned about x, then y, then z, backwards: the surroundings turn about us."""
    x, y, z = d
    for axis, angle in enumerate(degrees):
        c, s = math.cos(math.radians(-angle)), math.sin(math.radians(-angle))
        if angle:
            x, y, z = (x, c * y - s * z, s * y + c * z) if axis == 0 else (c * x + s * z, y, c * z - s * x) if axis == 1 else (c * x - s * y, s * x + c * y, z)
    return x, y, z


SOURCE_TILE, TARGET_BLOCK = 64, 256


def sampled(points: DataFrame, df: DataFrame, interpolate: bool) -> DataFrame:
    """(frame_id, px, py, r, g, b): sums of the samples of `df` at the points (frame_id, px, py, sx, sy, width, height) of a target pixel that lie in one tile.

    Points meet the pixels of the tile of the source that they fall into (with the line and column behind it) once for each block of the target, so that a
    point is one row whatever its taps, a pixel is copied to a few blocks, and a pole that fills much of the target is no hot key. A point without a pixel gives 0.
    """
    keys = ["frame_id", "tx", "ty", "bx", "by"]
    start = (lambda c: F.floor(c)) if interpolate else (lambda c: F.floor(F.col(c) + 0.5))
    first = {f"{c}0": F.least(start(f"s{c}"), F.col(size) - 1).cast("int") for c, size in (("x", "width"), ("y", "height"))}
    tile = lambda c: F.floor(F.col(c) / SOURCE_TILE)
    block = {"bx": F.floor(F.col("px") / TARGET_BLOCK), "by": F.floor(F.col("py") / TARGET_BLOCK)}
    dealt = points.withColumns(first).withColumns({"tx": tile("x0"), "ty": tile("y0")} | block)
    dealt = dealt.select(*keys, "px", "py", "x0", "y0", (F.col("sx") - start("sx")).alias("fx"), (F.col("sy") - start("sy")).alias("fy"))
    both = lambda c: F.explode(F.when((F.col(c) % SOURCE_TILE == 0) & (F.col(c) > 0), F.array(tile(c), tile(c) - 1)).otherwise(F.array(tile(c))))
    pixels = df.select("frame_id", "x", "y", *RGB, both("x").alias("tx")).select("*", both("y").alias("ty")).join(dealt.select(*keys).distinct(), keys[:3])
    own_keys = {f"own_{k}": F.col(k) for k in keys}  # names of their own: both sides come from the same points
    pixels = pixels.select(*[c.alias(k) for k, c in own_keys.items()], "x", "y", *RGB)

    def look(at, own):
        import numpy as np
        import pandas as pd

        if not len(at):
            return pd.DataFrame(columns=["frame_id", "px", "py", *RGB])
        x0, y0, n = int(at["tx"].iat[0]) * SOURCE_TILE, int(at["ty"].iat[0]) * SOURCE_TILE, SOURCE_TILE + 1
        grid = np.zeros((n, n, 3))
        there = np.zeros((n, n), bool)
        ys, xs = own["y"].to_numpy(int) - y0, own["x"].to_numpy(int) - x0
        grid[ys, xs], there[ys, xs] = own[list(RGB)].to_numpy(float), True
        x, y = at["x0"].to_numpy(int) - x0, at["y0"].to_numpy(int) - y0
        if interpolate:
            right, below = np.where(there[y, np.minimum(x + 1, n - 1)], x + 1, x), np.where(there[np.minimum(y + 1, n - 1), x], y + 1, y)  # the last line stands for the one behind it
            fx, fy = at["fx"].to_numpy()[:, None], at["fy"].to_numpy()[:, None]
            value = (grid[y, x] * (1 - fx) + grid[y, right] * fx) * (1 - fy) + (grid[below, x] * (1 - fx) + grid[below, right] * fx) * fy
        else:
            value = grid[y, x]
        found = pd.DataFrame(value, columns=list(RGB)).assign(frame_id=at["frame_id"].iat[0], px=at["px"].to_numpy(), py=at["py"].to_numpy())
        return found.groupby(["frame_id", "px", "py"], as_index=False, sort=False)[list(RGB)].sum()

    return dealt.groupBy(*keys).cogroup(pixels.groupBy(*own_keys)).applyInPandas(look, "frame_id bigint, px int, py int, r double, g double, b double")


# Width over height of a panorama in each projection.
PROJECTIONS = {"mirrorball": 1, "angular": 1, "cylindrical": 2, "polar": 2}


def project(df: DataFrame, src: str, dst: str, xsize: int, rotation=(0.0, 0.0, 0.0), oversample: int = 1, interpolate: bool = True, angle: float = 360.0) -> DataFrame:
    """Frames of one projection in another, xsize wide: each target pixel is the mean of oversample^2 directions, looked up in the source with four taps or the nearest;
    pixels outside a disc are 0. Directions go to the tile of the source that they point at; see sampled()."""
    src, dst = src.lower(), dst.lower()
    for name in (src, dst):
        if name not in PROJECTIONS:
            raise ValueError(f"unknown projection {name}; known: {', '.join(PROJECTIONS)}")
    if not 0 < angle <= 360:
        raise ValueError("the angle of an angular projection is in (0, 360] degrees")
    ysize = xsize // PROJECTIONS[dst]
    grid = frame_sizes(df).select("*", F.explode(F.sequence(F.lit(0), F.lit(xsize - 1))).alias("px")).select("*", F.explode(F.sequence(F.lit(0), F.lit(ysize - 1))).alias("py"))
    every = grid.select("frame_id", "px", "py")
    steps = F.array(*[F.struct(F.lit((i + 0.5) / oversample).alias("i"), F.lit((j + 0.5) / oversample).alias("j")) for j in range(oversample) for i in range(oversample)])
    if PROJECTIONS[dst] == 1:
        grid = grid.where(unit_disc((F.col("px") + 0.5) / xsize, (F.col("py") + 0.5) / xsize))
    grid = grid.select("*", F.explode(steps).alias("s")).withColumns({"u": (F.col("px") + F.col("s.i")) / xsize, "v": (F.col("py") + F.col("s.j")) / ysize})
    grid = grid.withColumns(dict(zip(("dx", "dy", "dz"), direction_of(dst, F.col("u"), F.col("v"), angle), strict=True)))
    grid = grid.withColumns(dict(zip(("dx", "dy", "dz"), rotated((F.col("dx"), F.col("dy"), F.col("dz")), rotation), strict=True)))
    u, v = project_to(src, (F.col("dx"), F.col("dy"), F.col("dz")), angle)
    grid = grid.withColumns({"sx": u * F.col("width"), "sy": v * F.col("height")})
    met = sampled(grid.select("frame_id", "px", "py", "sx", "sy", "width", "height"), df, interpolate)
    sums = met.groupBy("frame_id", "px", "py").agg(*[(F.sum(c) / oversample**2).alias(c) for c in RGB])
    return every.join(sums, ["frame_id", "px", "py"], "left").select("frame_id", F.col("px").alias("x"), F.col("py").alias("y"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in RGB])
