"""Golden vectors, geometry on a counting image, files and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions import color
from framelake.operators import merge, pixels, tonemap
from framelake.sources import pfs, text_files


@pytest.fixture(scope="module")
def counting(spark):
    return spark.createDataFrame([(1, x, y, float(y * 6 + x), float(y * 6 + x), float(y * 6 + x)) for y in range(5) for x in range(6)], "frame_id bigint, x int, y int, r double, g double, b double")


def grid(df):
    out = df.toPandas()
    m = np.full((out.y.max() + 1, out.x.max() + 1), np.nan)
    m[out.y, out.x] = out.r
    return m


def test_white_is_white(spark):
    row = spark.range(1).select(*color.srgb_to_xyz(F.lit(1.0), F.lit(1.0), F.lit(1.0))).first()
    assert row[0] == pytest.approx(0.95047, abs=1e-4) and row[1] == pytest.approx(1, abs=1e-6) and row[2] == pytest.approx(1.08883, abs=1e-4)


def test_round_trips(spark):
    c = (F.lit(0.2), F.lit(0.3), F.lit(1.4))  # negatives do not come back: the inverse curve has another factor there
    for pair in ((color.rgb_to_xyz, color.xyz_to_rgb), (color.srgb_to_xyz, color.xyz_to_srgb)):
        assert list(spark.range(1).select(*pair[1](*pair[0](*c))).first()) == pytest.approx([0.2, 0.3, 1.4], abs=1e-4)


def test_unknown_names():
    with pytest.raises(ValueError):
        tonemap.get_tone_mapper("none")
    with pytest.raises(ValueError):
        color.convert_colorspace(None, "rgb", "lab")


def test_shift(counting):
    got = grid(pixels.shift(counting, -2, -1))
    assert got[0].tolist() == [0] * 6 and got[1].tolist() == [0, 0, 0, 1, 2, 3]


def test_crop_and_rotation(counting):
    assert grid(pixels.crop(counting, 1, 1, 4, 3)).tolist() == [[7, 8, 9], [13, 14, 15]]
    assert (grid(pixels.rotate(pixels.rotate(counting, True), False)) == grid(counting)).all()
    assert (grid(pixels.rotate(counting, True)) == np.rot90(grid(counting), -1)).all()


def test_samples(spark):
    assert spark.range(1).select(color.to_uint(F.lit(0.5), 8), color.to_uint(F.lit(1.0), 16)).first() == (128, 65535)


def test_single_exposure_merge(spark):
    one = spark.createDataFrame([(1, 0, 1.0, x, 0, 0.25, 0.5, 0.6) for x in range(3)], "scene_id bigint, exposure_idx int, ev double, x int, y int, r double, g double, b double")
    for f in (merge.merge_debevec, merge.merge_robertson):
        row = f(one).first()
        assert row["g"] == pytest.approx(np.floor(0.5 * 4095) / 4095 / 2)


def test_container(spark, counting, tmp_path):
    for row in pixels.each(counting, lambda c: c + 0.5).transform(pfs.to_pfs_bytes).collect():
        (tmp_path / f"{row['frame_id']}.pfs").write_bytes(bytes(row["content"]))
    (tmp_path / "broken.pfs").write_bytes(b"PFS2\n")
    back = pfs.read_pfs(spark, str(tmp_path / "*.pfs")).toPandas()
    assert back.error.notna().sum() == 1
    good = back[back.error.isna()].sort_values(["y", "x"])
    assert good.r.tolist() == [v + 0.5 for v in range(30)]


def test_text_files(spark, tmp_path):
    (tmp_path / "r.m").write_text("# rows: 2\n# columns: 7\n 0 -6 0 -6 0 -6 0\n 1 0 1 0 1 0 1\n")
    rows = text_files.read_response(spark, str(tmp_path / "r.m")).orderBy("m").collect()
    assert [(r["m"], r["log_r"], r["b"]) for r in rows] == [(0, -6, 0), (1, 0, 1)]
    (tmp_path / "bad.m").write_text("# rows: 3\n# columns: 7\n 0 -6 0 -6 0 -6 0\n")
    with pytest.raises(Exception, match="row count"):
        text_files.read_response(spark, str(tmp_path / "bad.m")).collect()
    (tmp_path / "s.txt").write_text("# made\nTMO=Drago03\nBIAS = 0.8\nTMO=Mai\nLOCAL=yes\n")
    got = text_files.read_settings(spark, str(tmp_path / "s.txt")).first()
    assert (got["tmo"], got["numbers"], got["switches"], got["texts"]) == ("Mai", {"bias": 0.8}, {"local": True}, {})
