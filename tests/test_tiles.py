"""Tiles are done many at a time and where the frames' pixels already are; frames of several tiles give what whole frames give."""

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from framelake.operators import pyramids, stencils
from framelake.plans import catalogue


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(3)
    im = np.exp(np.sin(np.mgrid[0:90, 0:210][1] / 19) + 1.5 * (np.mgrid[0:90, 0:210][0] > 40) + rng.normal(0, 0.2, (90, 210)))
    rows = [(1, x, y, float(im[y, x])) for y in range(90) for x in range(210)] + [(2, x, 0, 3.0) for x in range(5)]
    return im, spark.createDataFrame(rows, "frame_id bigint, x int, y int, v double").repartition(4, "frame_id").cache()


@pytest.mark.parametrize("name", ["bilateral_grid", "tm_durand_wide"])
def test_grid_shuffles_no_cells(spark, name):
    """One shuffle brings a frame's pixels together; cells are never shuffled and pixels never joined with them."""
    text = plan(catalogue.QUERIES[name](spark, SF))
    assert "cx" not in text and text.count("hashpartitioning(l_suppkey") == text.count("Exchange hashpartitioning") - text.count("Exchange hashpartitioning(frame_id")
    assert "Exchange hashpartitioning(frame_id#" not in text or ", x#" not in text.split("Exchange hashpartitioning(frame_id", 1)[1].split(")", 1)[0]


@pytest.mark.parametrize("cells", [2_000_000, 2_000])
def test_grid_of_tiles_and_of_rows(spark, wide, monkeypatch, cells):
    """Tiles, whole or by slabs of the value, give what cells as rows give."""
    _, df = wide
    df = df.withColumn("i", F.ln("v"))
    want = {tuple(r[:3]): r["value"] for r in stencils.grid_by_joins(df, "i", 5.0, 0.3, 2, ()).collect()}
    monkeypatch.setattr(stencils, "MOST_CELLS", cells)
    got = stencils.bilateral_grid(df, "i", 5.0, 0.3, 2, ("v",)).collect()
    assert len(got) == len(want) == 90 * 210 + 5
    np.testing.assert_allclose([r["value"] for r in got], [want[tuple(r[:3])] for r in got], rtol=1e-9)
    monkeypatch.setattr(stencils, "WIDEST_MARGIN", 0)
    assert {tuple(r[:3]): r["value"] for r in stencils.bilateral_grid(df, "i", 5.0, 0.3, 2).collect()} == pytest.approx(want)


@pytest.mark.parametrize("name", ["tm_pattanaik_local", "contrast_density"])
def test_tiles_share_a_call(spark, name):
    text = plan(catalogue.QUERIES[name](spark, SF))
    assert "MapInPandas" in text and "FlatMapGroupsInPandas" not in text
    assert text.count("MapInPandas") == 1  # nothing is done twice


def test_local_adaptation_over_tiles(spark, wide):
    im, df = wide
    got = stencils.disc_mean(df.where("frame_id = 1").withColumnRenamed("v", "lum"), 4).toPandas()
    logs, h, w = np.log(im) / np.log(5), *im.shape
    for x, y, value in got.sample(300, random_state=1)[["x", "y", "value"]].itertuples(index=False):
        ys, xs = np.mgrid[max(1, y - 4) : min(h, y + 5), max(1, x - 4) : min(w, x + 5)]
        k = np.exp(-((logs[ys, xs] - logs[y, x]) ** 6)) * ((ys - y) ** 2 + (xs - x) ** 2 <= 16)
        assert value == pytest.approx((k * im[ys, xs]).sum() / k.sum(), rel=1e-9)


def test_contrast_counts_every_pixel(spark, wide):
    """Frames of several tiles count each pixel once a level, a frame without contrast gets a one beside the middle."""
    _, df = wide
    got = pyramids.contrast_density(df, "v").toPandas()
    assert got[got.frame_id == 1].groupby("level")["n"].sum().tolist() == [90 * 210] * 4
    assert sorted(got[(got.frame_id == 2) & (got.level == 0)][["contrast", "n"]].itertuples(index=False, name=None)) == [(6, 1), (7, 5), (8, 1)]
