"""Cases in which an operator once did less than its whole job."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions import color
from framelake.plans import catalogue, render
from framelake.sources import views


def test_batch_plan_many_presets(spark):
    frames = spark.range(3).withColumnRenamed("id", "frame_id")
    presets = spark.range(10_050).select(F.lit("drago").alias("tmo"), F.col("id").cast("double").alias("pregamma"))
    got = render.batch_plan(frames, presets)
    assert got.count() == got.distinct().count() == 3 * 10_050


def test_wb_robust_converges(spark, monkeypatch):
    rng = np.random.default_rng(5)
    frames = {i: rng.uniform(1.5, 2.5, (40, 1)) * cast * rng.uniform(0.97, 1.03, (40, 3)) for i, cast in enumerate(([1.1, 1, 0.9], [0.95, 1, 1.08], [1, 1, 1], [9, 1, 0.1]))}
    rows = [(i, x, 0, *map(float, p)) for i, own in frames.items() for x, p in enumerate(own)]
    monkeypatch.setattr(views, "px", lambda s, d: spark.createDataFrame(rows, "frame_id bigint, x int, y int, r double, g double, b double"))
    got = {r["frame_id"]: (r["gain_r"], r["gain_b"]) for r in catalogue.QUERIES["wb_robust"](spark, "").collect()}
    turns = []
    for i, own in frames.items():
        gain = np.ones(3)
        for turn in range(1000):
            y, u, v = np.array(color.RGB_TO_YUV) @ (own * gain).T
            grey = (abs(u) + abs(v)) / y < 0.3
            if not grey.any():
                break
            err, channel = max((v[grey].mean(), 0), (u[grey].mean(), 2), key=lambda e: abs(e[0]))
            if abs(err) < 0.001 or abs(err) >= 10:
                break
            gain[channel] -= 0.6 * np.sign(err) if abs(err) >= 0.8 else 0.3 * err
        turns.append(turn)
        assert got[i] == pytest.approx((gain[0], gain[2]), abs=2e-6)
    assert 3 < max(turns) < 999
