"""Frame sequences as streams and their batch forms."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.groups import in_groups, lines_of

# Times of adaptation and of bleaching of cones and rods, the light that bleaches half, and the level at the start.
CONE_TIME, ROD_TIME, CONE_BLEACH, ROD_BLEACH = 0.080, 0.150, 110.0, 400.0
CONE_HALF, ROD_HALF = 2.2e8, 16.0
START = (60.0, 60.0, 2e6 / (2e6 + 60.0), 0.04 / (0.04 + 60.0))
STATES = ("cone", "rod", "cone_pigment", "rod_pigment")
CHUNK = 4096  # frames of a sequence that are folded in one group


def steps(lum, dt: float) -> list[tuple]:
    """(a, b) of each state: a frame of that luminance takes a state s to a s + b."""
    fade = [math.exp(-dt / t) for t in (CONE_TIME, ROD_TIME)]
    return [(0 * lum + f, (1 - f) * lum) for f in fade] + [(1 - dt / tau - dt * lum / half, 0 * lum + dt / tau) for tau, half in ((CONE_BLEACH, CONE_HALF), (ROD_BLEACH, ROD_HALF))]


def laid_out(values, own, place, empty):
    """The groups' values side by side: line t holds the t-th one of each group."""
    import numpy as np

    out = np.full((place.max() + 1, own[-1] + 1), empty, values.dtype)
    out[place, own] = values
    return out


def temporal_adaptation(seq: DataFrame, dt: float = 1 / 25, chunk: int = CHUNK) -> DataFrame:
    """(seq_id, n, cone, rod, cone_pigment, rod_pigment) after every frame n = 1, 2, ... of a sequence.

    Every state is a linear recurrence, so chunks of a sequence are summed up on their own (what they make of any state), the sums of a sequence, a row for
    each chunk, are carried through in order, and the chunks are folded from what they begin with. A group holds a chunk, however long a sequence is; the groups
    of a task are stepped through side by side.
    """
    at = seq.select("seq_id", F.col("n").cast("bigint").alias("n"), F.col("lum").cast("double").alias("lum"), F.floor((F.col("n") - 1) / chunk).alias("chunk"))
    by = ["seq_id", "chunk"]

    def sum_up(frame):
        import numpy as np

        first, own, place = lines_of(frame, by)
        lum, there = laid_out(frame["lum"].to_numpy(float), own, place, 0.0), laid_out(np.ones(len(own), np.bool_), own, place, False)
        out = frame.loc[first, by].reset_index(drop=True)
        for name, (a, b) in zip(STATES, steps(lum, dt), strict=True):
            scale, shift = np.ones(len(first)), np.zeros(len(first))
            for x, y, own_frame in zip(a, b, there, strict=True):
                scale, shift = np.where(own_frame, scale * x, scale), np.where(own_frame, shift * x + y, shift)
            out[f"{name}_a"], out[f"{name}_b"] = scale, shift
        return out

    def carry(frame):
        import numpy as np

        first, own, place = lines_of(frame, ["seq_id"])
        out = frame[by].copy()
        for name, start in zip(STATES, START, strict=True):
            state, begins = np.full(len(first), start), []
            for a, b in zip(*(laid_out(frame[f"{name}_{p}"].to_numpy(float), own, place, 1.0) for p in "ab"), strict=True):
                begins.append(state)
                state = a * state + b
            out[name] = np.array(begins)[place, own]
        return out

    def fold(frame):
        """The first row of a chunk, without n, holds what it begins with."""
        import numpy as np

        first, own, place = lines_of(frame, by)
        out = frame[["seq_id", "n"]].copy()
        for name, (a, b) in zip(STATES, steps(laid_out(frame["lum"].to_numpy(float), own, place, 0.0), dt), strict=True):
            state = frame[name].to_numpy(float)[first]
            states = [state]
            for x, y in zip(a[1:], b[1:], strict=True):
                state = x * state + y
                states.append(state)
            out[name] = np.array(states)[place, own]
        return out[place > 0].astype({"n": "int64"})

    kinds = ", ".join(f"{name} double" for name in STATES)
    sums = in_groups(at, by, "n", sum_up, "seq_id bigint, chunk bigint, " + ", ".join(f"{name}_{p} double" for name in STATES for p in "ab"))
    begins = in_groups(sums, ["seq_id"], "chunk", carry, f"seq_id bigint, chunk bigint, {kinds}")
    both = at.unionByName(begins, allowMissingColumns=True)
    return in_groups(both, by, "n", fold, f"seq_id bigint, n bigint, {kinds}")


def released(frames, state: GroupState, columns: tuple[str, ...], start: tuple) -> tuple[list[tuple], tuple, list[tuple]]:
    """(rows to fold, what was folded so far, rows to wait): of the rows (us, columns) that wait and those that came, the ones that the watermark has passed, in order
    of the columns. The state is (microseconds of the waiting rows, each of their columns, .. what was folded)."""
    held, now = [], start
    if state.exists:
        old = state.get
        held, now = list(zip(*old[: len(columns) + 1], strict=True)), tuple(old[len(columns) + 1 :])
    for f in frames:
        held += zip(f["us"].tolist(), *(f[c].tolist() for c in columns), strict=True)
    passed = state.getCurrentWatermarkMs() * 1000
    ready = sorted((r for r in held if r[0] <= passed), key=lambda r: r[1:])
    return ready, now, [r for r in held if r[0] > passed]


def wait(state: GroupState, waiting: list[tuple], width: int, now: tuple) -> None:
    """Keep the waiting rows and what was folded; come back when the watermark passes the first of them."""
    state.update((*(list(c) for c in (zip(*waiting, strict=True) if waiting else [[]] * (width + 1))), *now))
    if waiting:
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), min(r[0] for r in waiting) // 1000) + 1)


def temporal_adaptation_stream(seq: DataFrame, dt: float = 1 / 25, delay: str = "10 seconds") -> DataFrame:
    """The same recurrence over a stream of (seq_id, n, lum, ts): a frame waits until the watermark, `delay` behind the latest time seen, has passed it, and is then
    folded in order of n, whatever batch it came in. A frame that comes when a later one has been folded is dropped. State: four numbers a sequence and the frames of the delay."""
    kinds = ", ".join(f"{name} double" for name in STATES)

    def step(key, frames, state: GroupState):
        import pandas as pd

        ready, (last, *now), waiting = released(frames, state, ("n", "lum"), (0, *START))
        rows = []
        for _, n, lum in ready:
            if n > last:
                last, now = n, [a * s + b for (a, b), s in zip(steps(lum, dt), now, strict=True)]
                rows.append((key[0], n, *now))
        wait(state, waiting, 2, (last, *now))
        yield pd.DataFrame(rows, columns=["seq_id", "n", *STATES])

    timed = seq.withWatermark("ts", delay).select("seq_id", F.col("n").cast("bigint").alias("n"), F.col("lum").cast("double").alias("lum"), "ts", F.unix_micros("ts").alias("us"))
    kept = f"held array<bigint>, held_n array<bigint>, held_lum array<double>, last bigint, {kinds}"
    return timed.groupBy("seq_id").applyInPandasWithState(step, f"seq_id bigint, n bigint, {kinds}", kept, "append", GroupStateTimeout.EventTimeTimeout)


# Coefficients of the tone-curve filter by frames a second, of past outputs and of inputs.
FILTERS = {
    25: ((-2.748835809214676, 2.528231219142559, -0.777638560238080), (0.000219606211225409, 0.000658818633676228, 0.000658818633676228, 0.000219606211225409)),
    30: ((-2.790655305284069, 2.602653173508124, -0.810960871907291), (0.000129624539595474, 0.000388873618786423, 0.000388873618786423, 0.000129624539595474)),
    60: ((-2.895292177877897, 2.795994584283360, -0.900566088981622), (0.0000170396779801130, 0.0000511190339403389, 0.0000511190339403389, 0.0000170396779801130)),
}
CURVE_STATE = "seen int, " + ", ".join(f"{n} double" for n in ("x1", "x2", "x3", "y1", "y2", "y3"))


def tap(xs, ys, fps: int):
    """The filter's output from the newest input on and the outputs before it, newest first; added up as the terms are written, for an inf that meets another."""
    (a1, a2, a3), (b0, b1, b2, b3) = FILTERS[fps]
    return b0 * xs[0] + b1 * xs[1] + b2 * xs[2] + b3 * xs[3] - a1 * ys[0] - a2 * ys[1] - a3 * ys[2]


def filtered(value: float, state: tuple, fps: int) -> tuple[float, tuple]:
    """Next output of a curve's point and its state: how many frames were seen, the last inputs and outputs. Before there are four, the first input stands for the past."""
    seen, xs, ys = state[0] + 1, [value, *state[1:4]], [None, *state[4:7]]
    oldest = xs[min(seen, 4) - 1]
    xs = [xs[t] if t < seen else oldest for t in range(4)]
    out = tap(xs, [ys[t] if t < seen else xs[t] for t in range(1, 4)], fps)
    return out, (min(seen, 4), value, state[1], state[2], out, state[4], state[5])


UNSEEN = (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)


def clamped(y, gone, lo: float, hi: float):
    """Outputs between lo and hi. NaN is the largest number, as SQL orders it; after a missing input there is no output, and nothing is clamped to lo."""
    import numpy as np

    return np.where(gone, lo, np.clip(np.where(np.isnan(y), math.inf, y), lo, hi))


def filter_tone_curves(curves: DataFrame, fps: int = 25, lo: float = float("-inf"), hi: float = float("inf"), chunk: int = CHUNK) -> DataFrame:
    """(seq_id, n, point, y): tone curves (seq_id, n, point, y), n = 1, 2, ..., smoothed over time, each point on its own; outputs are clamped, what the filter remembers is not.

    The filter is linear in its last three outputs, so a chunk of a sequence is summed up as a matrix and a vector from its own inputs and the three before
    them; these sums are carried through in order, and the chunks are filtered from the outputs they begin with. A group holds a chunk of at least 4 frames; the
    groups of a task are stepped through side by side.
    """
    if fps not in FILTERS:
        raise ValueError(f"no filter for {fps} frames a second; known: {', '.join(map(str, FILTERS))}")
    chunk = max(4, chunk)
    place_of = F.floor((F.col("n") - 1) / chunk)
    both = F.when(F.pmod(F.col("n") - 1, F.lit(chunk)) >= chunk - 3, F.array(place_of, place_of + 1)).otherwise(F.array(place_of))  # the last three inputs also go to the next chunk
    at = curves.select("seq_id", F.col("n").cast("bigint").alias("n"), F.col("point").cast("int").alias("point"), F.col("y").cast("double").alias("y"), F.col("y").isNull().alias("missing"), F.explode(both).alias("chunk"))
    at = at.withColumn("own", place_of == F.col("chunk"))
    by, last = ["seq_id", "point", "chunk"], ("s0", "s1", "s2")

    def run(frame, first, own, place, outputs, gone):
        """A row's output, the last three outputs of each group and whether an input is missing, the three outputs and that before it being given. A first chunk
        begins with its first input, the others with the three inputs before them."""
        import numpy as np

        x, gap = laid_out(frame["y"].to_numpy(float), own, place, 0.0), laid_out(frame["missing"].to_numpy(np.bool_), own, place, False)
        begun, size = ~frame["own"].to_numpy(np.bool_)[first], np.bincount(own)
        ys, found, gaps = list(outputs), [], []
        with np.errstate(invalid="ignore"):
            for t in range(len(x)):
                xs = [x[max(t - i, 0)] for i in range(4)]
                before = [ys[i] if i < t else np.where(begun, ys[i], xs[i + 1]) for i in range(3)]
                y = tap(xs, before, fps)
                now = (t < size) & ~(begun & (t < 3))
                gone = gone | gap[t]
                ys = [np.where(now, new, old) for new, old in zip((y, ys[0], ys[1]), ys, strict=True)]
                found.append(y)
                gaps.append(gone)
        return np.array(found)[place, own], ys, np.array(gaps)[place, own], gone

    def sum_up(frame):
        import numpy as np

        first, own, place = lines_of(frame, by)
        zero = np.zeros(len(first))
        _, shift, _, gone = run(frame, first, own, place, (zero, zero, zero), np.zeros(len(first), np.bool_))
        a, count = FILTERS[fps][0], np.bincount(own, frame["own"].to_numpy(float)).astype(int)
        step = np.array([[-a[0], -a[1], -a[2]], [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]])
        turns = {n: np.linalg.matrix_power(step, int(n)).ravel().tolist() for n in np.unique(count)}
        begun = ~frame["own"].to_numpy(np.bool_)[first]
        turn = [turns[n] if b else [0.0] * 9 for n, b in zip(count, begun, strict=True)]
        out = frame.loc[first, by].reset_index(drop=True).assign(turn=turn, gone=gone, shift=np.stack(shift, axis=1).tolist())
        return out[count > 0]  # without what lies behind the last chunk

    def carry(frame):
        import numpy as np

        first, own, place = lines_of(frame, ["seq_id", "point"])
        turn, shift = np.array(frame["turn"].tolist()).reshape(-1, 3, 3), np.array(frame["shift"].tolist(), float)
        state, gone, begins, gaps = np.zeros((len(first), 3)), np.zeros(len(first), np.bool_), np.zeros((len(frame), 3)), np.zeros(len(frame), np.bool_)
        for t in range(place.max() + 1):
            rows = np.flatnonzero(place == t)
            at = own[rows]
            begins[rows], gaps[rows] = state[at], gone[at]
            with np.errstate(invalid="ignore"):
                then = np.einsum("kij,kj->ki", turn[rows], state[at]) + shift[rows]
            then[~np.isfinite(state[at]).all(axis=1)] = np.nan  # an inf among the outputs is none some frames later
            state[at], gone[at] = then, gone[at] | frame["gone"].to_numpy(np.bool_)[rows]
        return frame[by].assign(begins=begins.tolist(), missing=gaps)

    def filter_chunk(frame):
        """The first row of a chunk, without n, holds what it begins with; none comes to the rows behind the last chunk."""
        import numpy as np

        start = frame["n"].isna().to_numpy()
        known = lines_of(frame, by)
        led = start[known[0]][known[1]]
        frame, start = frame[led].reset_index(drop=True), start[led]
        if not len(frame):
            return frame.assign(y=0.0)[["seq_id", "n", "point", "y"]].astype({"n": "int64"})
        begins = np.array(frame.loc[start, "begins"].tolist(), float)
        gone = frame.loc[start, "missing"].to_numpy(np.bool_)
        rows = frame[~start].reset_index(drop=True)
        first, own, place = lines_of(rows, by)
        y, _, gaps, _ = run(rows, first, own, place, tuple(begins.T), gone)
        mine = rows["own"].to_numpy(np.bool_)
        return rows[["seq_id", "n", "point"]].assign(y=clamped(y, gaps, lo, hi))[mine].astype({"n": "int64"})

    key = "seq_id bigint, point int, chunk bigint"
    sums = in_groups(at, by, "n", sum_up, f"{key}, turn array<double>, gone boolean, shift array<double>")
    begins = in_groups(sums, ["seq_id", "point"], "chunk", carry, f"{key}, begins array<double>, missing boolean")
    return in_groups(at.unionByName(begins, allowMissingColumns=True), by, "n", filter_chunk, "seq_id bigint, n bigint, point int, y double")


def filter_tone_curves_stream(curves: DataFrame, fps: int = 25, lo: float = float("-inf"), hi: float = float("inf"), delay: str = "10 seconds") -> DataFrame:
    """The same over a stream of (seq_id, n, point, y, ts) with the last three inputs and outputs of every point as state; frames wait for the watermark as in
    temporal_adaptation_stream."""
    if fps not in FILTERS:
        raise ValueError(f"no filter for {fps} frames a second; known: {', '.join(map(str, FILTERS))}")

    def step(key, frames, state: GroupState):
        import pandas as pd

        ready, (last, *now), waiting = released(frames, state, ("n", "y"), (0, *UNSEEN))
        rows = []
        for _, n, v in ready:
            if n > last:
                y, now = filtered(v, tuple(now), fps)
                last = n
                rows.append((key[0], n, key[1], float(clamped(y, False, lo, hi))))
        wait(state, waiting, 2, (last, *now))
        yield pd.DataFrame(rows, columns=["seq_id", "n", "point", "y"])

    timed = curves.withWatermark("ts", delay).select("seq_id", F.col("n").cast("bigint").alias("n"), "point", F.col("y").cast("double").alias("y"), "ts", F.unix_micros("ts").alias("us"))
    kept = f"held array<bigint>, held_n array<bigint>, held_y array<double>, last bigint, {CURVE_STATE}"
    return timed.groupBy("seq_id", "point").applyInPandasWithState(step, "seq_id bigint, n bigint, point int, y double", kept, "append", GroupStateTimeout.EventTimeTimeout)


def frame_stats(seq: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str | None = None, gap: str | None = None) -> DataFrame:
    """Statistics of frames in tumbling (or sliding) windows of frame time, or with `gap` in sessions of a sequence; with `delay`, late frames are dropped (streams)."""
    timed = seq.withWatermark("ts", delay) if delay else seq
    window = F.session_window("ts", gap) if gap else F.window("ts", size, slide) if slide else F.window("ts", size)
    keys = ["seq_id"] if gap else []
    out = timed.groupBy(*keys, window.alias("w")).agg(F.count("*").alias("frames"), F.min("lum").alias("lo"), F.max("lum").alias("hi"), F.avg("lum").alias("mean"))
    return out.select(*keys, F.col("w.start").alias("start"), "frames", "lo", "hi", "mean")


def assemble_brackets(files: DataFrame, n: int, timeout: str = "1 hour") -> DataFrame:
    """(folder_id, files): the brackets of n files that (folder_id, file, ts) form in order of time, then name. A file that comes again is ignored; when nothing
    comes for longer than the timeout, an incomplete bracket is dropped. A window sorts a folder's files; nothing gathers them."""
    first = files.groupBy("folder_id", "file").agg(F.min("ts").alias("ts"))
    along = Window.partitionBy("folder_id").orderBy("ts", "file")
    late = F.col("ts") > F.lag("ts").over(along) + F.expr(f"interval {timeout}")
    sessions = first.withColumn("late", F.coalesce(late.cast("int"), F.lit(0))).withColumn("session", F.sum("late").over(along))
    place = F.row_number().over(Window.partitionBy("folder_id", "session").orderBy("ts", "file")) - 1
    whole = sessions.withColumn("bracket", F.floor(place / n)).groupBy("folder_id", "session", "bracket").agg(F.sort_array(F.collect_list("file")).alias("files"))
    return whole.where(F.size("files") == n).select("folder_id", "files")


def assemble_brackets_stream(files: DataFrame, n: int, timeout: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """The same over a stream: a file waits until the watermark, `delay` behind the latest time seen, has passed it, so that brackets do not hang on the order of
    arrival; files behind those that were taken are dropped, and so are copies that come within the delay. State: the waiting files and an incomplete bracket of each folder."""

    def gather(key, frames, state: GroupState):
        import pandas as pd

        ready, (names, last), waiting = released(frames, state, ("at", "file"), ([], 0))
        names, done, most = list(names), [], int(pd.Timedelta(timeout).total_seconds() * 1_000_000)
        for ts, _, name in ready:
            if ts < last:
                continue
            if ts - last > most:
                names = []
            last = ts
            if name not in names:
                names.append(name)
            if len(names) == n:
                done.append(sorted(names))
                names = []
        wait(state, waiting, 2, (names, last))
        yield pd.DataFrame({"folder_id": [key[0]] * len(done), "files": done})

    fresh = files.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["folder_id", "file"]).select("folder_id", "file", "ts", F.unix_micros("ts").alias("us"), F.unix_micros("ts").alias("at"))
    kept = "held array<bigint>, held_at array<bigint>, held_file array<string>, names array<string>, last bigint"
    return fresh.groupBy("folder_id").applyInPandasWithState(gather, "folder_id bigint, files array<string>", kept, "append", GroupStateTimeout.EventTimeTimeout)
