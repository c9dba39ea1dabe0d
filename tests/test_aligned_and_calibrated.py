"""Alignment over several levels, calibration to convergence and robust balance, against plain numpy."""

import duckdb
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from framelake.operators import alignment, calibration, stats
from framelake.plans import catalogue
from framelake.sources import views

SCHEMA = "scene_id bigint, exposure_idx int, ev double, x int, y int, r double, g double, b double"


def halved(im):
    h, w = im.shape
    at = lambda n: np.arange(n // 2) * (n - 1) / (n // 2)
    sx, sy = at(w), at(h)
    x, y = np.floor(sx).astype(int), np.floor(sy).astype(int)
    fx, fy = (sx - x)[None, :], (sy - y)[:, None]
    out = (im[y][:, x] * (1 - fx) + im[y][:, x + 1] * fx) * (1 - fy) + (im[y + 1][:, x] * (1 - fx) + im[y + 1][:, x + 1] * fx) * fy
    return np.floor(out + 1e-9).astype(int)


def shifts_of(shots, levels):
    """Offsets between neighbours by loops over pixels' planes, summed along the bracket."""
    grey = [np.floor(np.clip(0.2126729 * s + 0.7151522 * s + 0.072175 * s, 0, 1) * 255 + 0.5).astype(int) for s in shots]
    medians = [int(np.flatnonzero(np.cumsum(np.bincount(g.ravel(), minlength=256)) >= g.size // 2)[0]) for g in grey]
    planes = [grey]
    for _ in range(levels):
        planes.append([halved(g) for g in planes[-1]])
    found = [(0, 0)]
    for i in range(1, len(shots)):
        dx = dy = 0
        for level in range(levels, -1, -1):
            a, b = planes[level][i - 1], planes[level][i]
            bit = lambda g, k: g >= medians[k]
            mask = lambda g, k: np.abs(g - medians[k]) >= alignment.NOISE
            h, w = a.shape
            best = None
            for p in (-1, 0, 1):
                for q in (-1, 0, 1):
                    u, v = dx + p, dy + q
                    x0, x1, y0, y1 = max(0, -u), min(w, w - u), max(0, -v), min(h, h - v)
                    errors = 0
                    if x0 < x1 and y0 < y1:
                        here, there = (slice(y0, y1), slice(x0, x1)), (slice(y0 + v, y1 + v), slice(x0 + u, x1 + u))
                        errors = int((bit(a, i - 1)[here] != bit(b, i)[there])[mask(a, i - 1)[here] & mask(b, i)[there]].sum())
                    if best is None or errors < best[0]:
                        best = (errors, u, v)
            dx, dy = best[1] * (2 if level else 1), best[2] * (2 if level else 1)
        found.append((found[-1][0] + dx, found[-1][1] + dy))
    return found


@pytest.mark.parametrize("size,levels", [((150, 131), None), ((67, 203), 3), ((64, 64), 2), ((9, 130), 1)])
def test_alignment_by_loops(spark, size, levels):
    """Frames wider than one word, moved across words, and noise; levels by size or as given."""
    rng = np.random.default_rng(size[0])
    h, w = size
    big = np.kron(rng.uniform(0, 1, (h // 6 + 12, w // 6 + 12)), np.ones((6, 6)))
    moves = [(0, 0), (5, -3), (2, 2)]
    shots = [np.clip(big[30 + dy : 30 + dy + h, 30 + dx : 30 + dx + w] + rng.normal(0, 0.02, size), 0, 1) for dx, dy in moves]
    rows = [(s, i, 0.0, x, y, *[float(im[y, x])] * 3) for s in (4, 9) for i, im in enumerate(shots) for y in range(h) for x in range(w)]
    got = {(r["scene_id"], r["exposure_idx"]): (r["dx"], r["dy"]) for r in alignment.mtb_align(spark.createDataFrame(rows, SCHEMA), levels=levels).collect()}
    depth = max(0, int(np.log2(min(size))) - 6) if levels is None else min(levels, int(np.log2(min(size))) - 2)
    want = shifts_of(shots, depth)
    assert got == {(s, i): m for s in (4, 9) for i, m in enumerate(want)}


def test_scenes_of_different_sizes(spark):
    """Levels follow each scene's own size."""
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for scene, (h, w) in enumerate([(20, 30), (140, 136), (270, 260)]):
        big = np.kron(rng.uniform(0, 1, (h // 5 + 12, w // 5 + 12)), np.ones((5, 5)))
        shots = [big[20 + dy : 20 + dy + h, 20 + dx : 20 + dx + w] for dx, dy in [(0, 0), (1, 1), (-2, 3)]]
        rows += [(scene, i, 0.0, x, y, *[float(im[y, x])] * 3) for i, im in enumerate(shots) for y in range(h) for x in range(w)]
        want |= {(scene, i): m for i, m in enumerate(shifts_of(shots, max(0, int(np.log2(min(h, w))) - 6)))}
    got = {(r["scene_id"], r["exposure_idx"]): (r["dx"], r["dy"]) for r in alignment.mtb_align(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want
    assert alignment.mtb_align(spark.createDataFrame([], SCHEMA)).count() == 0


def curves_of(shots, times, turns):
    """The loop over one channel: shots (exposures, pixels), darkest first, none as dark as another."""
    bins, last = np.floor(shots * 4095).astype(int), 4095
    m = np.floor(shots * 4095) / 4095
    w = np.where((m < 2 / 4096) | (m > 1 - 2 / 4096), 0, np.where(m < 0.5, 2 * m, 2 * (1 - m)))

    def unit(i):
        lit = np.flatnonzero(i)
        return i / i[lit[lit >= lit[0] + (lit[-1] - lit[0]) // 2][0]] if len(lit) else i

    curve = unit(np.maximum(np.arange(4096), 1) / 4095)
    known, t = curve.copy(), np.array(times)[:, None]
    for n in range(1, turns + 1):
        res = curve[bins]
        weight = np.stack([np.maximum(w[0], 1e-6), *[w[i] * np.maximum(0, 1 - (times[i] / times[i - 1] * res[i - 1] / curve[last]) ** 4) for i in range(1, len(times))]])
        merged = (weight * res).sum(0) / (weight * t).sum(0)
        total, count = np.bincount(bins.ravel(), (t * merged).ravel(), 4096), np.bincount(bins.ravel(), minlength=4096)
        new, held = np.zeros(4096), 0.0
        for k in range(4096):
            held = new[k] = total[k] / count[k] if count[k] else held
        curve = unit(new)
        lit = curve != 0
        change = ((curve - known)[lit] ** 2).mean()
        known[lit] = curve[lit]
        if change < calibration.ENOUGH:
            return curve, n
    return curve, turns


def by_loops(spark):
    """(scene, channel) to the curve, and the most turns of any, over the whole fixture."""
    stack, out, most = views.stack(spark, SF).toPandas().sort_values(["scene_id", "exposure_idx", "y", "x"]), {}, 0
    for scene, part in stack.groupby("scene_id"):
        for c in "rgb":
            shots = np.stack([p[c].to_numpy() for _, p in part.groupby("exposure_idx")])
            out[scene, c], n = curves_of(shots, [2.0**e for e in (-2, 0, 2)], calibration.MOST_TURNS)
            most = max(most, n)
    return out, most


def test_calibration_to_convergence(spark, monkeypatch):
    """The registered query over its whole table, and the way of curves with too many tuples, against loops."""
    want, most = by_loops(spark)
    assert most > 1
    got = catalogue.QUERIES["calibrate_response"](spark, SF).toPandas().sort_values("bin")
    assert len(got) == len(want) * 4096
    for (scene, c), part in got.groupby(["scene_id", "channel"]):
        np.testing.assert_allclose(part.value.to_numpy(), want[scene, c], rtol=1e-6, atol=1e-6)
    scene = min(s for s, _ in want)
    monkeypatch.setattr(calibration, "FOLDED", 3)
    slow = calibration.calibrate_response(views.stack(spark, SF).where(F.col("scene_id") == scene), turns=2).toPandas().sort_values("bin")
    part = views.stack(spark, SF).where(F.col("scene_id") == scene).toPandas().sort_values(["exposure_idx", "y", "x"])
    for c, own in slow.groupby("channel"):
        shots = np.stack([p[c].to_numpy() for _, p in part.groupby("exposure_idx")])
        np.testing.assert_allclose(own.value.to_numpy(), curves_of(shots, [0.25, 1.0, 4.0], 2)[0], rtol=1e-6, atol=1e-6)


def test_calibration_with_equal_exposures(spark):
    """Of exposures as dark as each other the last is the darker one of the next; both ways agree."""
    rng = np.random.default_rng(6)
    rows = [(1, i, ev, x, y, *(np.floor(rng.uniform(0, 1, 3) * 255) / 255).tolist()) for i, ev in enumerate([-1.0, 0.0, 0.0, 1.0]) for x in range(6) for y in range(5)]
    rows = [r for r in rows if r[1] != 2 or (r[3] + r[4]) % 3]  # some pixels lack an exposure
    stack = spark.createDataFrame(rows, SCHEMA)
    key = ["scene_id", "channel", "bin"]
    a = calibration.turned_at_once(calibration.sample_tuples(stack, "gaussian"), "gamma", 4, 0.0).toPandas().sort_values(key).value.to_numpy()
    b = calibration.turned_by_jobs(calibration.samples_of(stack, "gaussian"), "gamma", 4, 0.0).toPandas().sort_values(key).value.to_numpy()
    np.testing.assert_allclose(a, b, rtol=1e-9)


def test_robust_balance_both_ways(spark, monkeypatch):
    """All turns in one task and a job a turn give the same gains."""
    px = views.px(spark, SF).where("frame_id < 4")
    once = stats.wb_robust(px).toPandas().sort_values("frame_id").to_numpy()
    monkeypatch.setattr(stats, "FOLDED", 5)
    turns = stats.wb_robust(px).toPandas().sort_values("frame_id").to_numpy()
    np.testing.assert_allclose(once, turns, rtol=1e-9)


@pytest.mark.parametrize("name", ["wb_robust", "calibrate_turn", "mtb_align", "mtb_align_levels", "shift", "darker_samples", "select_gradients", "apply_saturation"])
def test_changed_queries_on_the_next_size(spark, name):
    """These queries, row by row, on the tables that are ten times larger."""
    large = SF.replace("0.001", "0.01")
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{large}/lineitem.parquet'")
    con.execute(f"create view orders as select * from '{large}/orders.parquet'")
    con.execute(f"create view events as select * from '{large}/events.parquet'")
    got, want = catalogue.QUERIES[name](spark, large).toPandas(), con.execute(catalogue.ORACLES[name]).df()
    keys = [c for c in ("frame_id", "scene_id", "exposure_idx", "channel", "bin", "x", "y") if c in want]
    got, want = (d[sorted(want.columns)].sort_values(keys).reset_index(drop=True) for d in (got, want))
    assert len(got) == len(want)
    for c in want.columns:
        if want[c].dtype.kind == "f":
            assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all() if name != "calibrate_turn" else np.allclose(got[c], want[c], atol=2e-6), c
        else:
            assert got[c].astype(str).tolist() == want[c].astype(str).tolist(), c
