"""Resizes join by frame alone, and frames too flat for a target line have none."""

import numpy as np
import pytest
from conftest import SF

from framelake.operators import levels, pixels
from framelake.plans import catalogue

SCHEMA = "frame_id bigint, x int, y int, r double, g double, b double"


@pytest.mark.parametrize("name", ["resize_bilinear", "resize_lanczos"])
def test_joins_by_frame_alone(spark, name):
    """No table of taps, which grows with the targets and looks as small as the table of sizes, is joined (or broadcast)."""
    text = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in text.splitlines() if "Join" in line]
    assert joins and all(line.count("#") <= 2 or "[frame_id" in line and ", x#" not in line and ", y#" not in line for line in joins)


@pytest.mark.parametrize("resize", [pixels.resize_bilinear, levels.resize_lanczos])
def test_flat_frames(spark, resize):
    rows = [(1, x, 0, 1.0, 2.0, 3.0) for x in range(24)] + [(2, x, y, 5.0, 5.0, 5.0) for x in range(24) for y in range(5)]
    got = resize(spark.createDataFrame(rows, SCHEMA), 10).collect()
    assert {r["frame_id"] for r in got} == {2} and len(got) == 20


@pytest.mark.parametrize(("w", "h", "xsize"), [(7, 9, 3), (5, 4, 12), (1, 6, 4), (30, 2, 15)])
def test_bilinear_against_loops(spark, w, h, xsize):
    rng = np.random.default_rng(w)
    im = rng.uniform(0, 9, (h, w))
    got = {(r["x"], r["y"]): r["g"] for r in pixels.resize_bilinear(spark.createDataFrame([(1, x, y, 0.0, float(im[y, x]), 0.0) for y in range(h) for x in range(w)], SCHEMA), xsize).collect()}
    tall = h * xsize // w
    assert len(got) == tall * xsize
    for (x, y), value in got.items():
        sx, sy = x * (w - 1) / xsize, y * (h - 1) / tall
        want = sum((1 - abs(sx - i)) * (1 - abs(sy - j)) * im[j, i] for i in (int(sx), int(sx) + 1) for j in (int(sy), int(sy) + 1) if i < w and j < h)
        assert value == pytest.approx(want)
