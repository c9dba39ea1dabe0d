"""Operator 11: runs of repeated words by internal pattern matching.

A run is a stretch of words with smallest period q and at least max(6, 4 * q) words that no neighbour extends. Many texts are searched at once:
a word is coded together with its text, so equal codes stand for equal words of one text and nothing matches across texts.

1. Suffixes are sorted by prefix doubling. After the step for 2^k words, equal ranks are equal factors of that length, and each such group is an
   interval of the suffix array. Only suffixes whose first words occur again are sorted on.
2. The dyadic blocks of level k are the factors of L = 2^k words that begin at multiples of L / 2. Each asks in its interval for its next occurrence
   in the neighbouring window of L places: a range successor, answered for all blocks together by a wavelet tree over the suffix array (how many of
   the interval's places are not behind the block, then the place of the next rank).
3. A run of period q with L / 2 < q <= L holds at least one whole block of the level together with its copy q words on (for L = 4, every q up to
   4), and the next occurrence of that block is q words on, since L >= q and q is the smallest period. Blocks of the same run give the same
   difference at places L / 2 apart: such a progression is one candidate. Its stretch misses the run's ends by less than L / 2 words, which are
   then compared word by word. A stretch that is too short for its period is no run.

The number of words is bounded by nothing: texts are gathered up to GATHER words, a longer one is searched by itself in time n log n.

Words are `[^\\x20\\x09-\\x0D]+`; null and empty texts have none. A word is dropped if a run contains it behind the run's first q words. A null
doc_id counts as the empty string where a number is drawn from it. Repeated rows are each searched alike, ties between longest runs go to the
smallest start, then period; other columns are kept, columns named as results are replaced.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tidied

LEAST = 6  # words of a run
TURNS = 4  # periods of a run
FIRST = 4  # words of the smallest block
GATHER = 150_000  # words that are searched at once
LONGEST = ("n_runs", "start", "length", "period", "exponent_milli")


def spans(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. up to each count, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


class WaveletTree:
    """A sequence of numbers below 2^bits, level by level stably parted by their bits: ranks and quantiles of any interval."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels = []
        for bit in range(bits - 1, -1, -1):
            one = (values >> bit & 1).astype(bool)
            zeros = np.zeros(len(values) + 1, np.int32)
            np.cumsum(~one, out=zeros[1:])
            self.levels.append((bit, zeros))
            values = np.concatenate([values[~one], values[one]])

    def not_above(self, low: np.ndarray, high: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many entries in [low, high) are at most `limit`."""
        limit, found = limit + 1, np.zeros(len(low), np.int64)
        for bit, zeros in self.levels:
            a, b, one = zeros[low].astype(np.int64), zeros[high].astype(np.int64), (limit >> bit & 1).astype(bool)
            found += np.where(one, b - a, 0)
            low, high = np.where(one, zeros[-1] + low - a, a), np.where(one, zeros[-1] + high - b, b)
        return found

    def quantile(self, low: np.ndarray, high: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The entry of [low, high) with `rank` smaller ones."""
        value, rank = np.zeros(len(low), np.int64), rank.copy()
        for bit, zeros in self.levels:
            a, b = zeros[low].astype(np.int64), zeros[high].astype(np.int64)
            one = rank >= b - a
            rank -= np.where(one, b - a, 0)
            value |= one.astype(np.int64) << bit
            low, high = np.where(one, zeros[-1] + low - a, a), np.where(one, zeros[-1] + high - b, b)
        return value

    def successor(self, low: np.ndarray, high: np.ndarray, after: np.ndarray) -> np.ndarray:
        """The smallest entry of each [low, high) above `after`, -1 where there is none."""
        rank, out = self.not_above(low, high, after), np.full(len(low), -1, np.int64)
        some = np.flatnonzero(rank < high - low)
        out[some] = self.quantile(low[some], high[some], rank[some])
        return out


def sorted_suffixes(codes: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """The suffixes whose first FIRST words occur again, in order; for each level, (L, blocks, low, high) with the intervals of its blocks.

    `codes` are numbers from 0 on. The order is that of the ranks, which tell factors apart: suffixes that begin alike stand together, but a
    suffix that is alone with its first words ranks behind all others.
    """
    n, length = len(codes), 1
    rank, own = codes.astype(np.int64), np.arange(n)  # own: suffixes that some other one still equals
    suffixes, levels = None, []
    while len(own):
        rest = own + length
        pair = rank[own] * (n + 1) + np.where(rest < n, rank[np.minimum(rest, n - 1)] + 1, 0)
        order = np.argsort(pair, kind="stable")
        own, pair = own[order], pair[order]
        head = np.empty(len(own), bool)
        head[0] = True
        np.not_equal(pair[1:], pair[:-1], out=head[1:])
        first = np.flatnonzero(head)
        size = np.diff(np.append(first, len(own)))
        length *= 2
        if length < FIRST:
            rank[own] = np.repeat(np.arange(len(first)), size)
            continue
        if suffixes is None:  # groups of one hold nothing to find: the array begins with the rest
            rank[own] = np.repeat(len(own) + np.arange(len(first)), size)
            keep = np.repeat(size > 1, size)
            own, size = own[keep], size[size > 1]
            low = np.cumsum(size) - size
            suffixes = own.copy()
            rank[own] = np.repeat(low, size)
        else:
            # places in the array: a group keeps its place, its parts follow each other
            old = rank[own]
            top = np.empty(len(own), bool)
            top[0] = True
            np.not_equal(old[1:], old[:-1], out=top[1:])
            place = old + spans(np.diff(np.append(np.flatnonzero(top), len(own))))
            suffixes[place] = own
            low = place[first]
            rank[own] = np.repeat(low, size)
            keep = np.repeat(size > 1, size)
            own, low, size = own[keep], low[size > 1], size[size > 1]
        lows, highs = np.repeat(low, size), np.repeat(low + size, size)
        block = own % (length // 2) == 0
        levels.append((length, own[block], lows[block], highs[block]))
    return np.zeros(0, np.int64) if suffixes is None else suffixes, levels


def find_runs(codes: np.ndarray) -> np.ndarray:
    """(start, length, period) of every run of `codes`, by start and period."""
    n = len(codes)
    suffixes, levels = sorted_suffixes(codes)
    found = [np.zeros((0, 3), np.int64)]
    if len(suffixes):
        tree = WaveletTree(suffixes, int(n).bit_length() + 1)
        for length, block, low, high in levels:
            step = tree.successor(low, high, block) - block
            near = (step > (length // 2 if length > FIRST else 0)) & (step <= length)
            block, step = block[near], step[near]
            order = np.lexsort((block, step))
            block, step = block[order], step[order]
            if not len(block):
                continue
            head = np.empty(len(block), bool)
            head[0] = True
            head[1:] = (step[1:] != step[:-1]) | (np.diff(block) > length // 2)
            first = np.flatnonzero(head)
            last = np.append(first[1:], len(block)) - 1
            period, start, end = step[first], block[first], block[last] + length + step[last]
            reach = length // 2
            likely = end - start + 2 * (reach - 1) >= np.maximum(LEAST, TURNS * period)
            period, start, end = period[likely], start[likely], end[likely]
            start, end = extended(codes, start, end, period, reach)
            whole = end - start >= np.maximum(LEAST, TURNS * period)
            found.append(np.stack([start, end - start, period], axis=1)[whole])
    runs = np.concatenate(found)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def extended(codes: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Each stretch, with the words on both sides that keep its period, up to `reach` of them."""
    n = len(codes)
    for side in (-1, 1):
        room = np.minimum(reach, start if side < 0 else n - end)
        at = spans(room)
        if len(at):
            own = np.repeat(np.arange(len(room)), room)
            place = start[own] - 1 - at if side < 0 else end[own] + at
            differs = codes[place] != codes[place - side * period[own]]
            stop = room.copy()
            np.minimum.at(stop, own[differs], at[differs])
        else:
            stop = room
        start, end = (start - stop, end) if side < 0 else (start, end + stop)
    return start, end


def repeated(words: list[bytes], draw: int) -> list[bytes]:
    """The words, for every tenth draw with a periodic rest: from word a on they repeat p words."""
    n = len(words)
    if draw % 10 or not n:
        return words
    g = draw // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[: n - a]


def search(texts: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each list of words its runs, and a mark for every word that stays."""
    counts = np.array([len(x) for x in texts], np.int64)
    n = int(counts.sum())
    if not n:
        yield from ((np.zeros((0, 3), np.int64), np.zeros(0, bool)) for _ in texts)
        return
    known: dict[bytes, int] = {}
    words = np.fromiter((known.setdefault(w, len(known)) for x in texts for w in x), np.int64, n)
    pairs = np.repeat(np.arange(len(texts)), counts) * len(known) + words
    codes = np.unique(pairs, return_inverse=True)[1]
    runs, starts = find_runs(codes), np.cumsum(counts) - counts
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    stays = np.cumsum(change[:-1]) == 0
    cuts = np.searchsorted(runs[:, 0], np.append(starts, n))
    for i, start in enumerate(starts):
        yield runs[cuts[i] : cuts[i + 1]] - [start, 0, 0], stays[start : start + counts[i]]


def summary(words: list[bytes], runs: np.ndarray, stays: np.ndarray, digests: bool) -> tuple:
    if len(runs):
        start, length, period = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist()
        longest = (len(runs), start, length, period, 1000 * length // period)
    else:
        longest = (0, None, None, None, None)
    kept = b" ".join(words) if stays.all() else b" ".join([w for w, s in zip(words, stays.tolist(), strict=True) if s])
    if digests:
        told = "".join(f"{a},{b},{c}\n" for a, b, c in runs.tolist())
        return *longest, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()
    return *longest, [{"start": a, "length": b, "period": c} for a, b, c in runs.tolist()], kept.decode()


def gathered(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[list[list[bytes]]]:
    """The batches' texts as words; those of a batch in parts of about GATHER words, the last part of a batch marked by an empty list behind it."""
    for draws, texts in batches:
        part, held = [], 0
        for draw, x in zip(draws, texts, strict=True):
            words = (x.encode(errors="replace") if isinstance(x, str) else b"").split()
            part.append(words if draw is None else repeated(words, int(draw)))
            held += len(words)
            if held >= GATHER:
                yield part
                part, held = [], 0
        if part:
            yield part
        yield []


def period_runs(documents: DataFrame, text: str = "text", draw: Column | None = None, digests: bool = False) -> DataFrame:
    """`documents` with the number of runs, the longest one, all runs and the text without repetitions.

    `draw`, an unsigned number, gives every tenth text a periodic rest first. `digests`: runs_sha256 and collapsed_sha256 instead of the runs and the text.
    """
    names, made = [*LONGEST, *(("runs_sha256", "collapsed_sha256") if digests else ("runs", "collapsed"))], f"_{uuid.uuid4().hex}"
    last = ("string", "string") if digests else ("array<struct<start: bigint, length: bigint, period: bigint>>", "string")
    kind = ", ".join(f"{c} {t}" for c, t in zip(names, (*["bigint"] * len(LONGEST), *last), strict=True))

    @tidied
    def find(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        rows = []
        for part in gathered(parts):
            if part:
                rows += [summary(w, runs, stays, digests) for w, (runs, stays) in zip(part, search(part), strict=True)]
                continue
            out = pd.DataFrame(rows, columns=names)
            yield out.astype(dict.fromkeys(LONGEST, "Int64"))
            rows = []

    def batches(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        yield from find(parts)

    kept = [F.col(f"`{c}`") for c in documents.columns if c not in names]
    drawn = F.lit(1).cast("bigint") if draw is None else draw.cast("bigint")
    told = documents.select(*kept, F.pandas_udf(batches, kind)(drawn, F.col(text).cast("string")).alias(made))
    return told.select(*kept, *[F.col(f"{made}.{f}").alias(f) for f in names])


def op11_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    draw = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    found = period_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), draw=draw, digests=True)
    return found.select("doc_id", *LONGEST, "runs_sha256", "collapsed_sha256")
