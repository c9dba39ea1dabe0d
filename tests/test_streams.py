"""Streams give what their batch forms give, whatever batch a row comes in; sequences in chunks give what a loop gives."""

import datetime
import random

import numpy as np
import pytest

from framelake.streaming import sequences

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
SEQ = "seq_id bigint, n bigint, lum double, ts timestamp"


def at(seconds: float) -> datetime.datetime:
    return START + datetime.timedelta(seconds=seconds)


def streamed(spark, folder, batches: list[list], schema: str, make) -> list:
    """Rows of a stream over files that come one by one."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in/{i:03}")
    name = f"t{random.getrandbits(60)}"
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    query = make(source).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).collect()


def dealt(rows: list, seed: int, ahead: int = 6) -> list[list]:
    """Batches of rows that come up to `ahead` places too late; at last a row of a far time moves the watermark over all."""
    rng = random.Random(seed)
    moved = [r for _, r in sorted(((i + rng.uniform(0, ahead), r) for i, r in enumerate(rows)), key=lambda p: p[0])]
    return [moved[i : i + 7] for i in range(0, len(moved), 7)]


@pytest.mark.parametrize("seed", [1, 2])
def test_adaptation_out_of_order(spark, tmp_path, seed):
    rows = [(s, n, float((s * 7 + n * 3) % 11), at(n)) for n in range(1, 15) for s in range(3)]
    batches = [*dealt(rows, seed), [(99, 1, 1.0, at(10_000))]]
    got = streamed(spark, tmp_path, batches, SEQ, lambda s: sequences.temporal_adaptation_stream(s, delay="30 seconds"))
    want = sequences.temporal_adaptation(spark.createDataFrame(rows, SEQ)).collect()
    key = lambda r: (r["seq_id"], r["n"])
    got, want = sorted((r for r in got if r["seq_id"] < 99), key=key), sorted(want, key=key)
    assert list(map(key, got)) == list(map(key, want))
    np.testing.assert_allclose([r[2:] for r in got], [r[2:] for r in want], rtol=1e-12)


def test_late_frames_are_dropped(spark, tmp_path):
    """A frame that comes when a later one has been folded is left out."""
    batches = [[(1, 1, 5.0, at(1)), (1, 2, 6.0, at(2))], [(1, 4, 8.0, at(100))], [(1, 5, 9.0, at(1000))], [(1, 3, 7.0, at(3))], [(2, 1, 1.0, at(10_000))]]
    got = streamed(spark, tmp_path, batches, SEQ, lambda s: sequences.temporal_adaptation_stream(s, delay="10 seconds"))
    got = sorted((r for r in got if r["seq_id"] == 1), key=lambda r: r["n"])
    assert [r["n"] for r in got] == [1, 2, 4, 5]
    want = sequences.temporal_adaptation(spark.createDataFrame([(1, i + 1, v, at(0)) for i, v in enumerate((5.0, 6.0, 8.0, 9.0))], SEQ)).orderBy("n").collect()
    np.testing.assert_allclose([r[2:] for r in got], [r[2:] for r in want], rtol=1e-12)


CURVES = "seq_id bigint, n bigint, point int, y double, ts timestamp"


def test_curves_out_of_order(spark, tmp_path):
    rows = [(s, n, p, float(np.sin(n * (p + 1)) + s), at(n)) for n in range(1, 20) for s in range(2) for p in range(2)]
    batches = [*dealt(rows, 5), [(99, 1, 0, 1.0, at(10_000))]]
    got = streamed(spark, tmp_path, batches, CURVES, lambda s: sequences.filter_tone_curves_stream(s, 30, lo=-1.0, hi=1.5, delay="30 seconds"))
    want = sequences.filter_tone_curves(spark.createDataFrame(rows, CURVES), 30, lo=-1.0, hi=1.5).collect()
    key = lambda r: (r["seq_id"], r["point"], r["n"])
    got, want = sorted((r for r in got if r["seq_id"] < 99), key=key), sorted(want, key=key)
    assert list(map(key, got)) == list(map(key, want))
    np.testing.assert_allclose([r["y"] for r in got], [r["y"] for r in want], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("chunk", [4, 5, 16, 4096])
def test_filter_in_chunks(spark, chunk):
    """Any chunk gives the outputs of one loop over a sequence."""
    rng = np.random.default_rng(chunk)
    series = {(s, p): rng.normal(size=n).cumsum() for (s, n) in ((1, 50), (2, 3), (3, 17), (4, 16), (5, 1)) for p in range(2)}
    rows = [(s, n + 1, p, float(v)) for (s, p), x in series.items() for n, v in enumerate(x)]
    got = sequences.filter_tone_curves(spark.createDataFrame(rows, "seq_id bigint, n bigint, point int, y double"), 25, chunk=chunk).toPandas()
    assert len(got) == len(rows)
    (a1, a2, a3), (b0, b1, b2, b3) = sequences.FILTERS[25]
    for (s, p), x in series.items():
        y = []
        for t in range(len(x)):
            past = lambda v, k, t=t, x=x: v[t - k] if t >= k else x[0]
            y.append(b0 * x[t] + b1 * past(x, 1) + b2 * past(x, 2) + b3 * past(x, 3) - a1 * past(y, 1) - a2 * past(y, 2) - a3 * past(y, 3))
        own = got[(got.seq_id == s) & (got.point == p)].sort_values("n")
        assert own.n.tolist() == list(range(1, len(x) + 1))
        np.testing.assert_allclose(own.y.to_numpy(), y, rtol=1e-6, atol=1e-6)


FILES = "folder_id bigint, file string, ts timestamp"


def test_brackets_out_of_order(spark, tmp_path):
    """Brackets do not hang on arrival; copies are ignored, an incomplete one is dropped at the timeout."""
    times = [0, 10, 20, 30, 40, 5000, 5010, 5020, 5030, 5040, 5050, 5060]
    rows = [(f, f"img_{i:02}", at(t + f)) for i, t in enumerate(times) for f in range(3)]
    rows += [(1, "img_03", at(33)), (2, "img_00", at(9))]
    rows.sort(key=lambda r: r[2])
    batches = [*dealt(rows, 4), [(99, "z", at(100_000))]]
    got = streamed(spark, tmp_path, batches, FILES, lambda s: sequences.assemble_brackets_stream(s, 3, "10 minutes", "10 minutes"))
    want = sequences.assemble_brackets(spark.createDataFrame(rows, FILES), 3, "10 minutes").collect()
    plain = lambda rows: sorted((r["folder_id"], tuple(r["files"])) for r in rows)
    assert plain(got) == plain(want)
    assert plain(want) == sorted((f, tuple(f"img_{i:02}" for i in part)) for f in range(3) for part in ((0, 1, 2), (5, 6, 7), (8, 9, 10)))


def test_empty_tables(spark):
    assert sequences.filter_tone_curves(spark.createDataFrame([], "seq_id bigint, n bigint, point int, y double")).count() == 0
    assert sequences.assemble_brackets(spark.createDataFrame([], FILES), 3).count() == 0


def test_sequences_share_a_group_call(spark):
    """Many short sequences, and one far longer than the others, come to the fold together and whole."""
    rows = [(s, n, float((s * 7 + n * 3) % 11)) for s in range(40) for n in range(1, 2 + (3000 if s == 7 else s % 5))]
    df = spark.createDataFrame(rows, "seq_id bigint, n bigint, lum double")
    sizes = sequences.in_groups(df, ["seq_id"], "n", lambda f: f.groupby("seq_id", as_index=False).agg(n=("n", "size"), first=("n", "first")).assign(rows=len(f)), "seq_id bigint, n bigint, first bigint, rows bigint", rows=100).collect()
    assert sorted((r["seq_id"], r["n"], r["first"]) for r in sizes) == [(s, 3001 if s == 7 else 1 + s % 5, 1) for s in range(40)]
    assert min(r["rows"] for r in sizes if r["seq_id"] == 7) == 3001 and max(r["rows"] for r in sizes if r["seq_id"] != 7) > 5
    got = {(r["seq_id"], r["n"]): r[2:] for r in sequences.temporal_adaptation(df, chunk=16).collect()}
    state, s = list(sequences.START), -1
    for seq_id, n, lum in rows:
        state = list(sequences.START) if seq_id != s else state
        state, s = [a * x + b for (a, b), x in zip(sequences.steps(lum, 1 / 25), state, strict=True)], seq_id
        np.testing.assert_allclose(got[seq_id, n], state, rtol=1e-9)


@pytest.mark.parametrize("chunk", [4, 7, 4096])
def test_black_frames_and_missing_points(spark, chunk):
    """-inf (the logarithm of a black frame) takes the filter to NaN, which is clamped to the top as SQL has it; behind a missing input everything is at the bottom."""
    rows = [(s, n, 0, None if (s, n) == (9, 3) else -np.inf if s == n else 0.5 + n % 3) for s in (1, 4, 5, 8, 9, 30) for n in range(1, 20)]
    got = sequences.filter_tone_curves(spark.createDataFrame(rows, "seq_id bigint, n bigint, point int, y double"), 25, -0.5, 1.5, chunk).toPandas()
    for s, own in got.sort_values("n").groupby("seq_id"):
        state, want = sequences.UNSEEN, []
        for y in (r[3] for r in rows if r[0] == s):
            out, state = sequences.filtered(np.nan if y is None else y, state, 25)
            want.append(1.5 if np.isnan(out) else min(1.5, max(-0.5, out)))
        if s == 9:
            want[2:] = [-0.5] * 17
        np.testing.assert_allclose(own["y"], want, atol=1e-9)
    assert sorted(set(got[(got.seq_id == 4) & (got.n > 5)]["y"])) == [1.5]
