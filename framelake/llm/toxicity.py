"""Operator 12: toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text in lower case, with everything but letters and digits as one space, gives its character n-grams of SIZES, hashed; a feature is the presence
of an n-gram, so that neither length nor repetition dilutes a single word. Its value is the naive Bayes log-count ratio
r = ln((1 + texts of label 1 with it) / (1 + all of label 1)) - ln((1 + texts of label 0 with it) / (1 + all of label 0)); n-grams that the labels
do not part by LEAST_Z standard errors have value 0. A logistic regression with an L2 penalty is trained on these values, and its bias moved to
the labels' true shares. A score is 1 / (1 + exp(-(bias + sum of w r))) over the n-grams present, for the whole text.

Null and empty texts score by the bias alone. Labels that are null, or neither 0 nor 1, teach nothing; a doc_id with several labels teaches its
highest, one with several texts the first of them. Without texts of both labels to learn from, all texts score the share of label 1, kept within
0.05 and 0.95 (0.5 with no label). Repeated rows and extra columns are kept, a column named score is replaced.

The sample is bounded in number and length: SAMPLE_TOXIC documents of label 1 and SAMPLE_CLEAN of label 0, picked by a hash of the id; a longer
text teaches by a piece of SAMPLE_CHARS.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, from_text, table

SIZES = (3, 4, 5, 6)
BITS = 20
SAMPLE_TOXIC, SAMPLE_CLEAN = 4000, 8000  # labelled texts of each label
SAMPLE_CHARS = 20_000
LEAST_Z = 6.5
PENALTY = 0.02
TURNS = 250
STEP = 0.07
SPACE = 32
PLAIN = np.array([chr(i).isalnum() or i >= 128 for i in range(0x3000)])  # punctuation beyond Latin stays


def grams(text: str) -> np.ndarray:
    """Hashes of the character n-grams of a text, as often as they occur."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    points = np.where(PLAIN[np.minimum(points, len(PLAIN) - 1)], points, SPACE)
    padded = np.full(len(points) + 2, SPACE, np.uint64)
    padded[1:-1] = points
    stays = np.ones(len(padded), bool)
    stays[1:] = (padded[1:] != SPACE) | (padded[:-1] != SPACE)
    padded = padded[stays]
    base, spread, shift, found, now = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(64 - BITS), [], padded
    for size in range(2, SIZES[-1] + 1):
        now = now[:-1] * base + padded[size - 1 :]
        if size in SIZES:
            mixed = now * spread
            found.append(((mixed ^ mixed >> np.uint64(29)) * base) >> shift)
        if len(now) < 2:
            break
    return np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32)


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-min(35.0, max(-35.0, x)))))


def ratios(texts: list[str], labels: np.ndarray) -> np.ndarray:
    """The log-count ratio of each hashed n-gram, 0 where the labels hardly part it."""
    count = np.zeros((2, 1 << BITS))
    for text, label in zip(texts, labels, strict=True):
        count[label, np.unique(grams(text))] += 1
    total = np.bincount(labels, minlength=2)[:, None]
    share, both = count / total, count.sum(axis=0)
    mean = both / total.sum()
    error = np.sqrt(np.maximum(mean * (1 - mean), 1e-12) * (1 / total[0] + 1 / total[1]))
    r = np.log((1 + count[1]) / (1 + total[1])) - np.log((1 + count[0]) / (1 + total[0]))
    return np.where((np.abs(share[1] - share[0]) >= LEAST_Z * error) & (both >= 3), r, 0.0)


def train(texts: list[str], labels: list[int], shares: dict[int, float]) -> np.ndarray:
    """w r of each hashed n-gram; the last entry is the bias. Texts come in a fixed order; `shares` are those of the labels in all data."""
    y = np.array(labels)
    r = ratios(texts, y)
    used = np.flatnonzero(r)
    column = np.full(1 << BITS, -1, np.int32)
    column[used] = np.arange(len(used))
    rows = [np.unique(c[c >= 0]) for c in (column[grams(t)] for t in texts)]  # read again: all n-grams of all texts would not fit the driver
    own, at = np.repeat(np.arange(len(rows)), [len(x) for x in rows]), np.concatenate(rows)
    value, taken = r[used][at], np.bincount(y, minlength=2) / len(y)
    w, bias = np.zeros(len(used)), 0.0
    mean, square, even = np.zeros(len(used) + 1), np.zeros(len(used) + 1), 0.5 / taken[y]
    for turn in range(1, TURNS + 1):
        margin = np.bincount(own, w[at] * value, len(rows)) + bias
        wrong = even * (1 / (1 + np.exp(-np.clip(margin, -35, 35))) - y) / len(y)
        slope = np.append(np.bincount(at, wrong[own] * value, len(used)) + PENALTY * w / len(y), wrong.sum())
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope * slope
        move = STEP * (mean / (1 - 0.9**turn)) / (np.sqrt(square / (1 - 0.99**turn)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    out = np.zeros((1 << BITS) + 1)
    out[used] = w * r[used]
    out[-1] = bias + np.log(shares[1] / shares[0])  # trained as if both labels were as frequent
    return out


def fit(documents: DataFrame, labels: DataFrame, usable: Column) -> np.ndarray:
    """Learn from (doc_id, text) and (doc_id, toxic) rows where `usable`, a condition on doc_id, holds."""
    own = labels.where(usable & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total, hash_ = sum(sizes.values()), F.xxhash64("doc_id", F.lit(12))
    each = [own.where(F.col("toxic") == label).orderBy(hash_, "doc_id").limit(most) for label, most in ((0, SAMPLE_CLEAN), (1, SAMPLE_TOXIC))]
    start = F.pmod(hash_, F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS)).cast("int") + 1
    texts = documents.where("text is not null").select("doc_id", F.col("text").cast("string").substr(start, F.lit(SAMPLE_CHARS)).alias("text"))
    found = texts.join(F.broadcast(each[0].unionAll(each[1])), "doc_id")  # at most SAMPLE_TOXIC + SAMPLE_CLEAN rows
    rows = found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("doc_id").collect()
    if {r["toxic"] for r in rows} != {0, 1}:
        flat, likely = np.zeros((1 << BITS) + 1), min(0.95, max(0.05, sizes.get(1, 0) / total)) if total else 0.5
        flat[-1] = np.log(likely / (1 - likely))
        return flat
    return train([r["text"] for r in rows], [r["toxic"] for r in rows], {k: n / total for k, n in sizes.items()})


def rate(text: str, weights: np.ndarray) -> float:
    """The score of one text: each n-gram counts once."""
    found = grams(text)
    found = found[weights[found] != 0]
    return sigmoid(float(weights[-1] + weights[np.unique(found)].sum()))


def score(documents: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """`documents` with `score`, the likelihood of label 1, from the whole text alone."""
    shipped = documents.sparkSession.sparkContext.broadcast(weights)

    def rated(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            yield pd.DataFrame({"score": [rate(x if isinstance(x, str) else "", shipped.value) for x in texts]})

    return from_text(documents, text, "score double", rated)


def held_out() -> Column:
    return crc_fold("doc_id", 5) == 0


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    return score(docs, weights).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
