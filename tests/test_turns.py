"""A turn of calibration by the name of the first response gives what the table of it gives, without joining samples to a table of every bin."""

import pytest
from conftest import SF

from framelake.operators import calibration
from framelake.plans import catalogue
from framelake.sources import views


def test_turn_by_name(spark):
    samples = calibration.samples_of(views.stack(spark, SF).where("scene_id < 3"), "triangular").cache()
    key = lambda df: {tuple(r[:3]): r["value"] for r in df.collect()}
    got, want = key(calibration.calibrate_turn(samples, "linear")), key(calibration.calibrate_turn(samples, calibration.first_curves(samples)))
    assert got.keys() == want.keys() and len(got) % 4096 == 0 and got == pytest.approx(want)
    text = catalogue.QUERIES["calibrate_turn"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in text and "HashJoin" not in text  # what is left multiplies pixels by the three exposures
