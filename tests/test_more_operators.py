"""Operators of look-ups, calibration, alignment, neighbourhoods, panoramas and sequences against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions import color
from framelake.operators import alignment, brackets, calibration, compose, levels, merge, pyramids, stencils
from framelake.plans import render
from framelake.sources import frames
from framelake.streaming import sequences

RGB = "rgb"


def pixels(spark, images: dict[int, np.ndarray]):
    """Frames (height, width, 3) as rows."""
    rows = [(k, x, y, *map(float, im[y, x])) for k, im in images.items() for y in range(im.shape[0]) for x in range(im.shape[1])]
    return spark.createDataFrame(rows, "frame_id bigint, x int, y int, r double, g double, b double")


def grid(df, col: str, shape) -> np.ndarray:
    out = np.full(shape, np.nan)
    for r in df.select("x", "y", col).collect():
        out[r["y"], r["x"]] = r[col]
    return out


def test_hsl_corner_cases(spark):
    cases = [(1.0, 0.0, 0.0), (0.5, 0.5, 0.5), (0.0, 0.0, 0.0), (0.2, 0.9, 0.9), (0.9, 0.2, 0.9), (0.3, 0.1, 0.7)]
    df = spark.createDataFrame(cases, "r double, g double, b double")
    h, s, light = (c.alias(n) for c, n in zip(color.rgb_to_hsl(*map(F.col, RGB)), "hsl", strict=True))
    got = df.select(*RGB, h, s, light).select(*RGB, "h", "s", "l", *[c.alias(f"{n}2") for c, n in zip(color.hsl_to_rgb(F.col("h"), F.col("s"), F.col("l")), RGB, strict=True)]).collect()
    assert got[0]["h"] == 1.0 and (got[0]["r2"], got[0]["g2"], got[0]["b2"]) == (0.5, 0.5, 0.5)  # hue 1 goes back as grey
    assert [(r["h"], r["s"]) for r in got[1:3]] == [(0.0, 0.0)] * 2
    for r in got[1:]:
        assert [r["r2"], r["g2"], r["b2"]] == pytest.approx([r["r"], r["g"], r["b"]], abs=1e-12)


def test_ties_take_the_darker_exposure(spark):
    rows = [(1, i, ev, 0, 0, v, v, v) for i, (ev, v) in enumerate([(-2.0, 0.1), (0.0, 0.4), (0.0, 0.5), (1.0, 0.9)])]
    got = merge.darker_samples(spark.createDataFrame(rows, "scene_id int, exposure_idx int, ev double, x int, y int, r double, g double, b double")).collect()
    assert {r["exposure_idx"]: (r["dark_time"], r["dark_r"]) for r in got} == {0: (None, None), 1: (0.25, 0.1), 2: (0.25, 0.1), 3: (1.0, 0.5)}


def test_response_calibration(spark):
    """Turns on a small bracket against loops over arrays."""
    rng = np.random.default_rng(3)
    light = rng.uniform(0.02, 1.0, (2, 4, 5, 3))
    times = [0.25, 1.0, 4.0]
    shots = np.floor(np.minimum(1, light[:, None] * np.array(times)[None, :, None, None, None] / 2) ** 0.7 * 255 + 0.5) / 255
    rows = [(s, i, math.log2(t), x, y, *map(float, shots[s, i, y, x])) for s in range(2) for i, t in enumerate(times) for y in range(4) for x in range(5)]
    stack = spark.createDataFrame(rows, "scene_id bigint, exposure_idx int, ev double, x int, y int, r double, g double, b double")
    got = {(r["scene_id"], r["channel"], r["bin"]): r["value"] for r in calibration.calibrate_response(stack, turns=3).collect()}
    bins = np.floor(shots * 4095).astype(int)
    m = np.arange(4096) / 4095
    weight = np.where((m < 2 / 4096) | (m > 1 - 2 / 4096), 0, np.where(m < 0.5, 2 * m, 2 * (1 - m)))
    for s in range(2):
        for c, name in enumerate(RGB):
            unit = lambda i: i / i[(mid := (nz := np.flatnonzero(i))[0] + (nz[-1] - nz[0]) // 2) + np.flatnonzero(i[mid:])[0]]
            curve = unit(np.maximum(np.arange(4096), 1) / 4095)
            old = curve.copy()
            for _ in range(3):
                b = bins[s, ..., c]
                res, w = curve[b], weight[b]
                w = np.stack([np.maximum(w[0], 1e-6), *[w[i] * np.maximum(0, 1 - (times[i] / times[i - 1] * res[i - 1] / curve[-1]) ** 4) for i in (1, 2)]])
                t = np.array(times)[:, None, None]
                merged = (w * res).sum(0) / (w * t).sum(0)
                total, count = np.zeros(4096), np.zeros(4096)
                np.add.at(total, b, np.broadcast_to(t * merged, b.shape))
                np.add.at(count, b, 1)
                new, last = np.zeros(4096), 0.0
                for k in range(4096):
                    last = new[k] = total[k] / count[k] if count[k] else last
                curve = unit(new)
                hit = curve != 0
                change = ((curve - old)[hit] ** 2).mean()
                old[hit] = curve[hit]
                if change < calibration.ENOUGH:
                    break
            assert [got[s, name, k] for k in range(4096)] == pytest.approx(curve.tolist(), rel=1e-6, abs=1e-9)


def test_alignment_of_a_moved_bracket(spark):
    """Frames of 150 lines take a coarse and a fine step."""
    rng = np.random.default_rng(5)
    big = np.kron(rng.uniform(0, 1, (30, 30)), np.ones((8, 8)))
    shot = lambda dx, dy: big[40 + dy : 190 + dy, 40 + dx : 190 + dx]
    moves = [(0, 0), (2, -1), (1, 2)]
    rows = [(7, i, x, y, *[float(im[y, x])] * 3) for i, im in enumerate(shot(*m) for m in moves) for y in range(150) for x in range(150)]
    stack = spark.createDataFrame(rows, "scene_id bigint, exposure_idx int, x int, y int, r double, g double, b double")
    got = {r["exposure_idx"]: (r["dx"], r["dy"]) for r in alignment.mtb_align(stack).collect()}
    assert got == {i: (-dx, -dy) for i, (dx, dy) in enumerate(moves)}
    back = brackets.apply_shifts(stack, alignment.mtb_align(stack))
    inner = back.where("x between 10 and 140 and y between 10 and 140").groupBy("x", "y").agg((F.max("g") - F.min("g")).alias("d"))
    assert inner.agg(F.max("d")).first()[0] == 0


def test_neighbourhoods_do_not_hang_on_tiles(spark):
    rng = np.random.default_rng(1)
    im = rng.uniform(0.1, 50, (23, 31, 3))
    df = pixels(spark, {1: im})
    near = stencils.local_adaptation(df)
    y = grid(df.withColumn("lum", color.rgb_to_y(*map(F.col, RGB))), "lum", im.shape[:2])
    want = np.empty_like(y)
    for j in range(y.shape[0]):
        for i in range(y.shape[1]):
            v = [y[j + b, i + a] for b in range(-4, 5) for a in range(-4, 5) if a * a + b * b <= 16 and 0 < i + a < y.shape[1] and 0 < j + b < y.shape[0]]
            w = np.exp(-((np.log(v) / math.log(5) - math.log(y[j, i]) / math.log(5)) ** 6))
            want[j, i] = (w * v).sum() / w.sum() if w.sum() > 0 else y[j, i]
    assert grid(near, "value", y.shape) == pytest.approx(want)
    small = stencils.tiled(df, "g", 2, lambda v, ys, xs: np.nansum([stencils.moved(v, b, a) for b in (-2, 0, 2) for a in (-2, 0, 2)], axis=0), tile=5)
    g = np.pad(im[..., 1], 2)
    assert grid(small, "value", y.shape) == pytest.approx(sum(g[2 + b : 25 + b, 2 + a : 33 + a] for b in (-2, 0, 2) for a in (-2, 0, 2)))
    local = grid(stencils.tm_pattanaik_local(df), "g", y.shape)
    assert ((local >= 0) & (local <= 1)).all() and not np.allclose(local, grid(levels.tm_pattanaik(df), "g", y.shape))
    flat = grid(stencils.tm_durand(df, 1.0, 0.4, 2.0), "g", y.shape)
    assert np.isfinite(flat).all() and np.corrcoef(np.log(im[..., 1]).ravel(), flat.ravel())[0, 1] > 0.8


def test_panoramas(spark):
    """A frame that is its own direction comes through; discs are 0 outside."""
    h, w = 40, 80
    v, u = np.mgrid[0:h, 0:w]
    lon, lat = (0.75 - (u + 0.5) / w) * 2 * math.pi, (v + 0.5) / h * math.pi
    im = np.stack([np.cos(lon) * np.sin(lat), np.cos(lat), np.sin(lon) * np.sin(lat)], axis=2)
    df = pixels(spark, {1: im})
    out = compose.project(df, "polar", "angular", 21)
    for r in out.collect():
        a, b = 2 * (r["x"] + 0.5) / 21 - 1, 2 * (r["y"] + 0.5) / 21 - 1
        far = math.hypot(a, b)
        if far > 1:
            assert (r["r"], r["g"], r["b"]) == (0, 0, 0)
        elif 0.1 < far < 0.9:
            want = (a / far * math.sin(math.pi * far), -b / far * math.sin(math.pi * far), math.cos(math.pi * far))
            assert (r["r"], r["g"], r["b"]) == pytest.approx(want, abs=0.12)
    turned = compose.project(df, "polar", "polar", w, (0.0, 90.0, 0.0), interpolate=False)
    x = grid(turned, "r", (h, w))
    assert np.abs(x[5:-5] - -im[5:-5, :, 2]).max() < 0.15 or np.abs(x[5:-5] - im[5:-5, :, 2]).max() < 0.15
    with pytest.raises(ValueError, match="unknown projection"):
        compose.project(df, "flat", "polar", 8)


def test_sequences_by_chunk_and_by_hand(spark):
    rng = np.random.default_rng(2)
    seqs = {1: rng.uniform(0, 400, 37), 2: rng.uniform(0, 5, 3)}
    df = spark.createDataFrame([(s, n + 1, float(v)) for s, own in seqs.items() for n, v in enumerate(own)], "seq_id bigint, n bigint, lum double")
    for chunk in (5, 4096):
        got = {(r["seq_id"], r["n"]): r for r in sequences.temporal_adaptation(df, chunk=chunk).collect()}
        for s, own in seqs.items():
            cone, rod, bc, br, dt = 60.0, 60.0, 2e6 / 2000060, 0.04 / 60.04, 0.04
            for n, v in enumerate(own, 1):
                cone += (1 - math.exp(-dt / 0.08)) * (v - cone)
                rod += (1 - math.exp(-dt / 0.15)) * (v - rod)
                bc += dt * (1 - bc) / 110 - dt * v * bc / 2.2e8
                br += dt * (1 - br) / 400 - dt * v * br / 16
                assert [got[s, n][c] for c in sequences.STATES] == pytest.approx([cone, rod, bc, br])
    curves = df.select("seq_id", "n", F.lit(0).alias("point"), F.lit(1.5).alias("y"))
    assert [r["y"] for r in sequences.filter_tone_curves(curves, 60).collect()] == pytest.approx([1.5] * 40)  # a still curve stays
    with pytest.raises(ValueError, match="no filter"):
        sequences.filter_tone_curves(curves, 24)


def test_contrast_density_by_hand(spark):
    rng = np.random.default_rng(4)
    lum = np.exp(rng.normal(0, 2, (11, 13)))
    df = pixels(spark, {1: np.stack([lum] * 3, axis=2)})
    high, want = np.log10(lum), {}
    for level in range(2):
        low = high
        for axis in (1, 0):
            n, at = low.shape[axis], np.arange(low.shape[axis])
            total = 0
            for j, k in zip((-2, -1, 0, 1, 2), (0.05, 0.25, 0.4, 0.25, 0.05), strict=True):
                i = np.abs(at + (j << level))
                total = total + k * np.take(low, np.where(i >= n, 2 * n - 2 - i, i), axis)
            low = total
        g = high - low
        for a, b in zip(low.ravel(), g.ravel(), strict=True):
            light, place = math.floor((a + 8) / 0.1 + 0.5), math.floor((b + 0.7) / 0.1 + 0.5)
            if 0 <= light < 161 and 0 <= place < 15:
                k = (level, light, 8 if 0.0043 < b < 0.05 else 6 if -0.05 < b < -0.0043 else place)
                want[k] = want.get(k, 0) + 1
        high = low
    for level, light in {k[:2] for k in want if k[2] == 7}:
        if not any((level, light, c) in want for c in range(15) if c != 7):
            want[level, light, 6] = want[level, light, 8] = 1
    got = {(r["level"], r["light"], r["contrast"]): r["n"] for r in pyramids.contrast_density(df, "g", 2).collect()}
    assert got == want


def test_errors_do_not_stop_the_others(spark):
    """A preset that cannot be planned and a frame that has no result are rows of the error table; the rest is made."""
    rng = np.random.default_rng(1)
    broken = rng.uniform(0.1, 9, (6, 7, 3))
    broken[2, 3] = np.nan
    df = pixels(spark, {1: rng.uniform(0.1, 9, (6, 7, 3)), 2: np.zeros((4, 4, 3)), 3: broken})
    presets = {"a": {"tmo": "reinhard02"}, "b": {"tmo": "nothing"}, "c": {"tmo": "reinhard02", "bits": 16, "postgamma": 2.0}, "d": {"tmo": "drago", "no_such": 1}}
    made, errors = render.render_batch(df, presets)
    told = {(r["preset"], r["frame_id"]) for r in errors.collect()}
    assert {("b", None), ("d", None), ("a", 3), ("c", 3)} <= told and ("a", 1) not in told
    want = {(p, f) for p in ("a", "c") for f in (1, 2, 3)} - told
    assert {(r["preset"], r["frame_id"]) for r in made.select("preset", "frame_id").distinct().collect()} == want and ("a", 1) in want
    one = made.where("preset = 'c' and frame_id = 1").orderBy("y", "x").select("r", "g", "b").collect()
    alone = render.render(df.where("frame_id = 1"), "reinhard02", postgamma=2.0, bits=16).orderBy("y", "x").select("r", "g", "b").collect()
    assert [tuple(r) for r in one] == [tuple(r) for r in alone]
    with pytest.raises(ValueError, match="no preset"):
        render.render_batch(df, {"b": {"tmo": "nothing"}})
    auto = render.render(df.where("frame_id = 1"), "reinhard02", auto=0.985, bits=16)
    assert auto.agg(F.max("g")).first()[0] <= 65535


def test_presets_that_begin_alike_share_statistics(spark):
    """One aggregation by frame serves both presets; the other shuffles of the plan are reuses of it."""
    df = pixels(spark, {1: np.random.default_rng(1).uniform(0.1, 9, (6, 7, 3))})
    base = render.mapped(df, "reinhard02")
    both = render.finished(base, postgamma=2.0).unionByName(render.finished(base, postsaturation=0.5))
    both.collect()
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReusedExchange") >= 1


def test_formats(spark, tmp_path):
    df = pixels(spark, {1: np.random.default_rng(1).uniform(0, 1, (2, 3, 3))})
    for ext in ("parquet", "orc", "json", "csv"):
        frames.write_pixels(df, str(tmp_path / f"a.{ext}"))
        assert frames.read_pixels(spark, str(tmp_path / f"a.{ext}")).exceptAll(df).isEmpty()
    for call in (lambda: frames.read_pixels(spark, "a.tga"), lambda: frames.write_pixels(df, "a.tga")):
        with pytest.raises(ValueError, match="unknown format"):
            call()


def test_frame_containers(spark, tmp_path):
    """A folder of whole files, the schema of the other formats; broken and existing targets are errors."""
    rng = np.random.default_rng(3)
    df = frames.as_floats(pixels(spark, {7: rng.uniform(0, 1, (2, 3, 3)), 12: rng.uniform(0, 9, (4, 1, 3))}))
    path = str(tmp_path / "a.pfs")
    frames.write_pixels(df, path)
    assert sorted(p.name for p in (tmp_path / "a.pfs").iterdir() if not p.name.startswith(".")) == ["12.pfs", "7.pfs"]
    got = frames.read_pixels(spark, path)
    assert got.schema == frames.read_pixels(spark, path).schema and got.columns == ["frame_id", "x", "y", "r", "g", "b"]
    assert got.exceptAll(df).isEmpty() and got.count() == df.count()
    with pytest.raises(Exception, match="exists already"):
        frames.write_pixels(df, path)
    frames.write_pixels(df, f"file://{tmp_path}/b.pfs")
    assert frames.read_pixels(spark, f"file://{tmp_path}/b.pfs").exceptAll(df).isEmpty()
    (tmp_path / "a.pfs" / "9.pfs").write_bytes(b"PFS1\n2 2\n")
    with pytest.raises(Exception, match="9.pfs"):
        frames.read_pixels(spark, path).collect()
