"""Levels, zones and bracket operators on small frames, degenerate ones included."""

import pytest
from pyspark.sql import functions as F

from framelake.operators import brackets, levels, pixels, tonemap

PIXELS = "frame_id bigint, x int, y int, r double, g double, b double"


@pytest.fixture(scope="module")
def flat(spark):
    return spark.createDataFrame([(1, x, y, 0.5, 0.5, 0.5) for y in range(8) for x in range(8)], PIXELS)


def test_constant_frame(flat):
    assert levels.percentiles(flat, "g", 0.01, 0.99).first()[1:] == (0.5, 0.5)
    for name in ("kimkautz", "mai", "pattanaik", "zone"):
        assert tonemap.get_tone_mapper(name)(flat).count() == 64
    assert {r["stop"] for r in levels.zone_exposure(flat)[1].collect()} == {0.0}


def test_empty_frames(flat):
    none = flat.limit(0)
    for f in (levels.tm_kimkautz, levels.tm_mai, levels.tm_zone, levels.tm_pattanaik, levels.auto_levels, lambda d: levels.resize_lanczos(d, 4)):
        assert f(none).count() == 0


def test_lanczos_keeps_a_constant(flat):
    for size in (3, 8, 20):
        got = levels.resize_lanczos(flat, size).agg(F.min("r"), F.max("r"), F.count("*")).first()
        assert got[0] == pytest.approx(0.5) and got[1] == pytest.approx(0.5) and got[2] == size * size


def test_halving_undoes_doubling(spark):
    df = spark.createDataFrame([(1, x, y, 0.0, float(3 * y + x), 0.0) for y in range(2) for x in range(3)], PIXELS)
    back = pixels.downsample2(levels.upsample2(df, "g"), "g")
    assert {tuple(r) for r in back.select("x", "y", "g").collect()} == {tuple(r) for r in df.select("x", "y", "g").collect()}


def test_auto_levels_of_two_peaks(spark):
    df = spark.createDataFrame([(1, x, 0, v, v, v) for x, v in enumerate([40] * 5 + [100] * 90 + [180] * 5)], "frame_id bigint, x int, y int, r int, g int, b int")
    lo, hi = levels.auto_levels(df, 0.985).select("lo", "hi").first()
    assert lo == pytest.approx(40 / 255) and hi == pytest.approx(181 / 255)


def test_names_that_meet(spark):
    files = spark.createDataFrame([(f, 0, "a.tif", 0) for f in (1, 2)] + [(2, 1, "b.tif", 0)], "folder_id bigint, bracket int, file string, place int")
    got = {(r["folder_id"], r["bracket"]): (r["name"], r["counter"]) for r in brackets.output_names(files, "drago", "png").collect()}
    assert got == {(1, 0): ("a-a_drago.png", "1"), (2, 0): ("a-a_drago-2.png", "1"), (2, 1): ("b-b_drago.png", "2")}


def test_masks_and_presets(spark):
    a, b = (spark.createDataFrame([(1, i, 0) for i in ids], "scene_id bigint, px int, py int") for ids in ([1, 2], [2, 3]))
    assert [brackets.combine_masks(a, b, how).count() for how in ("union", "intersect", "subtract")] == [3, 1, 1]
    with pytest.raises(ValueError):
        brackets.combine_masks(a, b, "xor")
    presets = {"drago": spark.sql("select 'dim' as comment, 0.85D as bias"), "ferwerda": spark.sql("select 'dim' as comment, 0.01D as mul")}
    assert brackets.preset_catalogue(presets).count() == 2
    assert {(r["tmo"], r["bias"], r["mul"]) for r in brackets.presets_by_comment(presets, "dim").collect()} == {("drago", 0.85, None), ("ferwerda", None, 0.01)}


def test_first_of_equal_references(spark):
    stack = spark.createDataFrame([(1, i, float(i), 0, 0, 0.5, 0.4, 0.3) for i in range(3)], "scene_id bigint, exposure_idx int, ev double, x int, y int, r double, g double, b double")
    assert brackets.reference_exposure(stack).first()["exposure_idx"] == 0
