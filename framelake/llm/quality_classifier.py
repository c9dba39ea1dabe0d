"""Operator 7: quality by hashed word n-gram logistic regression with follow-the-regularised-leader updates.

Words and their shapes (letters, capitals, digits and signs, runs cut short) give hashed uni-, bi- and trigrams; a
word that repeats the one before it is a feature of its own. A feature's value is its share of the text's words, so a
score is a sparse dot product: the mean of the weights at the text's features. Weights are learned by FTRL-proximal
on a bounded sample of labelled rows and are re-weighted to the labels' true shares.

Null and empty texts score by the bias alone. Labels that are null, or neither 0 nor 1, teach nothing; a doc_id with several
labels teaches its highest, one with several texts the first of them. Without texts of both labels to learn from, all texts score the share of
label 1, kept within 0.05 and 0.95 (0.5 with no label). Repeated rows and extra columns are kept, a column named score is replaced. Texts are
scored whole.

The sample is bounded in number and length: SAMPLE_PER_LABEL documents of each label, picked by a hash of the id; a longer text teaches by a
piece of SAMPLE_CHARS.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, crc_fold, from_text, table

BITS = 18
SAMPLE_PER_LABEL = 2500  # labelled texts of each label
SAMPLE_CHARS = 20_000
EPOCHS = 3
SCALE = 10.0
SHAPE = bytes(65 if 65 <= i <= 90 else 48 if 48 <= i <= 57 else 97 if 97 <= i <= 122 or i >= 128 else i for i in range(256))
RUNS = re.compile(rb"(.)\1+")


def word_codes(word: bytes) -> tuple[int, int]:
    return xxhash.xxh3_64_intdigest(word), xxhash.xxh3_64_intdigest(RUNS.sub(rb"\1\1", word.translate(SHAPE)), 7)


def code_memo() -> Memo:
    """Both codes of a word, packed."""
    return Memo(lambda word: struct.pack("<QQ", *word_codes(word)), 128 << 20)


def features(text: bytes, codes: Memo) -> tuple[np.ndarray, int]:
    """Hashed features of a text, repeated as often as they occur, and its number of words."""
    words = text.split()
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), 0
    both = np.frombuffer(b"".join(map(codes.__getitem__, words)), "<u8").reshape(-1, 2)
    raw, shape = both[:, 0], both[:, 1]
    k1, k2, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(64 - BITS)
    two = (shape[:-1] * k1) ^ shape[1:]
    parts = [raw * k1, ((raw[:-1] * k2) ^ raw[1:]) * k1, shape * k2, two * k2, (two[:-1] * k1 ^ shape[2:]) * k2]
    again = np.flatnonzero(raw[1:] == raw[:-1])
    found = np.concatenate(parts) >> shift
    return np.concatenate([found.astype(np.int64), np.zeros(len(again), np.int64)]), n


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-min(35.0, max(-35.0, x)))))


class Ftrl:
    """Per-coordinate FTRL-proximal for logistic loss."""

    def __init__(self, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.002, l2: float = 0.05):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, at: np.ndarray, value: np.ndarray, label: int, importance: float) -> None:
        w = self.weights(at)
        g = (sigmoid(float(w @ value)) - label) * value * importance
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def train(rows: list[tuple[bytes, int]], importance: dict[int, float]) -> np.ndarray:
    """Weights; the last is the bias. `rows` are (text, label) in a fixed order."""
    codes, model, prepared = code_memo(), Ftrl(), []
    for text, label in rows:
        found, n = features(text, codes)
        at, times = np.unique(found, return_counts=True)
        prepared.append((np.append(at, 1 << BITS), np.append(times * (SCALE / max(n, 1)), 1.0), label))
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(prepared)):
            at, value, label = prepared[i]
            model.update(at, value, label, importance[label])
    return model.weights(slice(None))


def fit(documents: DataFrame, labels: DataFrame, usable: Column) -> np.ndarray:
    """Learn from (doc_id, text) and (doc_id, quality) rows where `usable`, a condition on doc_id, holds."""
    own = labels.where(usable & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    sizes = {r["quality"]: r["n"] for r in own.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    total, hash_ = sum(sizes.values()), F.xxhash64("doc_id", F.lit(7))
    each = [own.where(F.col("quality") == q).orderBy(hash_, "doc_id").limit(SAMPLE_PER_LABEL) for q in (0, 1)]
    sample = each[0].unionAll(each[1])
    start = F.pmod(hash_, F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS)).cast("int") + 1
    texts = documents.where("text is not null").select("doc_id", F.col("text").substr(start, F.lit(SAMPLE_CHARS)).cast("binary").alias("text"))
    found = texts.join(F.broadcast(sample), "doc_id")  # at most 2 * SAMPLE_PER_LABEL rows
    rows = [(bytes(r["text"]), r["quality"]) for r in found.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).orderBy("doc_id").collect()]
    taken = {q: sum(r[1] == q for r in rows) for q in (0, 1)}
    if not all(taken.values()):
        flat, likely = np.zeros((1 << BITS) + 1), min(0.95, max(0.05, sizes.get(1, 0) / total)) if total else 0.5
        flat[-1] = np.log(likely / (1 - likely))
        return flat
    return train(rows, {q: sizes[q] / total / (taken[q] / len(rows)) for q in (0, 1)})


def score(documents: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """`documents` with `score`, the likelihood of label 1, from the text alone."""
    shipped = documents.sparkSession.sparkContext.broadcast(weights)

    def rate(parts: Iterator):
        w, codes = shipped.value, code_memo()
        for texts in parts:
            out = []
            for x in texts:
                found, n = features(x.encode(errors="replace") if isinstance(x, str) else b"", codes)
                out.append(sigmoid(w[-1] + (SCALE * float(w[found].sum()) / n if n else 0.0)))
            yield pd.DataFrame({"score": out})

    return from_text(documents, text, "score double", rate)


def held_out() -> Column:
    return crc_fold("doc_id", 3) == 1


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    return score(docs, weights).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
