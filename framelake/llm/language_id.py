"""Operator 4: language identification by nearest centroid.

A text is a vector of hashed character n-grams (1 to 3, lower-cased letters, word boundaries marked) weighted by
TF-IDF and scaled to length one. Every language has several centroids, found by spherical k-means on a
bounded sample of its training texts. The nearest centroid by cosine names the language; a text farther from it than
nearly all training texts of that language and of its size are from theirs is rejected. Short texts are farther from everything, so
whole training texts and pieces of them set a limit for each size, the number of different n-grams. Their distances are
taken from centroids of the other half of the texts. A language with a single training text rejects nothing.

Null texts and texts without a letter get `und`, score 0, and are rejected. Whole texts are read, in chunks that bound
memory; n-grams across the edge of a chunk count. Ties go to the first language in alphabetical order. With nothing to learn from, all
texts get `und`. Extra columns and repeated rows are kept; columns named as the results are replaced.

The sample is bounded in number and length: SAMPLE_PER_LANGUAGE rows of each language, fewer if SAMPLE of all languages are reached (never under
LEAST_PER_LANGUAGE), picked by a hash of the row; a longer text teaches by a piece of SAMPLE_CHARS. The model grows with the number of languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_fold, from_text, in_worker, table

DIM = 4096
SAMPLE_PER_LANGUAGE, LEAST_PER_LANGUAGE, SAMPLE = 600, 20, 20_000  # training texts: bounds of what the driver holds
SAMPLE_CHARS = 8_000
CLUSTERS = 3
CHUNK = 1_000_000
REJECT_QUANTILE = 0.005
PIECES = (6, 12, 25, 50, 100, 200, 400, 800, 1600)  # characters of the pieces of training texts that set the limits
UNDETERMINED = "und"


def letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.bool_, 0x110000)


def n_gram_counts(text: str, letters: np.ndarray) -> np.ndarray | None:
    """Counts of hashed 1- to 3-grams; None without a letter."""
    total, any_letter, text = np.zeros(DIM, np.float32), False, text.lower()
    after_letter, before = True, np.zeros(0, np.uint32)  # the first character is kept; before: the last two that were
    for at in range(0, len(text), CHUNK):
        code = np.frombuffer(text[at : at + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letters[code]
        any_letter |= bool(is_letter.any())
        keep = is_letter.copy()
        keep[0] |= after_letter
        keep[1:] |= is_letter[:-1]
        after_letter = bool(is_letter[-1])
        new = np.where(is_letter, code, np.uint32(32))[keep] * np.uint32(2654435761)
        c, old = np.concatenate([before, new]), len(before)
        two = (c[:-1] ^ (c[1:] >> np.uint32(7))) * np.uint32(2246822519)
        three = (two[:-1] ^ (c[2:] >> np.uint32(5))) * np.uint32(3266489917)
        for h in (new, two[max(0, old - 1) :], three):
            total += np.bincount(h >> np.uint32(20), minlength=DIM)
        before = c[-2:]
    return total if any_letter else None


def size_class(counts: np.ndarray) -> int:
    """Half-octave of the number of different n-grams."""
    return int(2 * np.log2(np.count_nonzero(counts)))


@dataclass
class LanguageModel:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    floor: dict[str, np.ndarray]  # least cosine that is accepted, by size class

    def vector(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * self.idf
        return v / max(float(np.sqrt(v @ v)), 1e-9)

    def predict(self, text: str | None, letters: np.ndarray) -> tuple[str, float, bool]:
        counts = n_gram_counts(text, letters) if isinstance(text, str) and self.languages else None
        if counts is None:
            return UNDETERMINED, 0.0, True
        cosines = self.centroids @ self.vector(counts)
        best = int(np.argmax(cosines))
        score = min(1.0, max(0.0, float(cosines[best])))
        return self.languages[best], score, score < float(self.floor[self.languages[best]][size_class(counts)])


def cluster(vectors: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means with a spread-out start."""
    centroids = [vectors.mean(axis=0)]
    for _ in range(1, min(k, len(vectors))):
        centroids.append(vectors[np.argmin(np.max(vectors @ np.array(centroids).T, axis=1))])
    c = np.array(centroids)
    for _ in range(rounds):
        home = np.argmax(vectors @ c.T, axis=1)
        c = np.array([vectors[home == i].sum(axis=0) if (home == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def limits(texts: list[str], vectors: np.ndarray, idf: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Least cosine accepted, by size class, from training texts and pieces of them held against centroids of the other half."""
    rng, model = np.random.default_rng(4), LanguageModel([], vectors, idf, {})
    found: dict[int, list[float]] = {}
    half = np.arange(len(texts)) % 2
    for own in (0, 1) if len(texts) > 1 else ():
        centroids = cluster(vectors[half != own], CLUSTERS)
        for text in texts[own::2]:
            starts = [(int(rng.integers(len(text) - n)), n) for n in PIECES if n < len(text)]
            for at, n in [*starts, (0, len(text))]:
                if (counts := n_gram_counts(text[at : at + n], letters)) is not None:
                    found.setdefault(size_class(counts), []).append(float((centroids @ model.vector(counts)).max()))
    classes = np.arange(size_class(np.ones(DIM)) + 1)
    if not found:
        return np.zeros(len(classes))
    known = sorted(found)
    least = np.interp(classes, known, [float(np.quantile(found[k], REJECT_QUANTILE)) for k in known])
    least = np.minimum.accumulate(least[::-1])[::-1]  # a smaller text has no higher limit
    return least * np.minimum(1, 2.0 ** ((classes - known[0]) / 4))  # below the least size seen, by the root of the size


def sample(documents: DataFrame, train: Column) -> list[tuple[str, str]]:
    """(lang, text) of a bounded number of rows of each language, by a hash of the row; of long texts a piece."""
    hash_, known = F.xxhash64("doc_id", "text", F.lit(4)), documents.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return []
    most = min(SAMPLE_PER_LANGUAGE, max(LEAST_PER_LANGUAGE, SAMPLE // len(sizes)))
    start = F.pmod(hash_, F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS)).cast("int") + 1
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "text"))

    def pick(rows: DataFrame) -> list:
        slim = rows.select("lang", "doc_id", hash_.alias("h"), F.col("text").substr(start, F.lit(SAMPLE_CHARS)).alias("text"))
        return slim.withColumn("rank", rank).where(F.col("rank") <= most).orderBy("lang", "rank").collect()

    # The share keeps four times what is wanted, so that little is sorted; a language of a few different rows may have none of them in it.
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 4 * most / n))).otherwise(share)
    rows = pick(known.where(F.pmod(hash_, F.lit(1_000_000)) < share * 1_000_000))
    if missing := sorted(set(sizes) - {r["lang"] for r in rows}):
        rows += pick(known.where(F.col("lang").isin(missing)))
    return [(r["lang"], r["text"]) for r in rows]


def fit(documents: DataFrame, train: Column) -> LanguageModel:
    """Learn from a bounded sample of the rows of (doc_id, text, lang) where `train` holds."""
    letters = letter_table()
    counted = [(lang, c, text) for lang, text in sample(documents, train) if (c := n_gram_counts(text, letters)) is not None]
    if not counted:
        return LanguageModel([], np.zeros((0, DIM), np.float32), np.ones(DIM, np.float32), {})
    counts = np.array([c for _, c, _ in counted])
    langs = np.array([lang for lang, _, _ in counted])
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    vectors = np.log1p(counts) * idf
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    names, centroids, floor = [], [], {}
    for lang in sorted(set(langs.tolist())):
        own = vectors[langs == lang]
        c = cluster(own, CLUSTERS)
        floor[lang] = limits([text for name, _, text in counted if name == lang], own, idf, letters)
        names += [lang] * len(c)
        centroids.append(c)
    return LanguageModel(names, np.concatenate(centroids).astype(np.float32), idf, floor)


def identify(documents: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """`documents` with lang_pred, score and rejected, from the text alone."""
    shipped = documents.sparkSession.sparkContext.broadcast((model.languages, model.centroids, model.idf, model.floor))

    def predict(parts: Iterator):
        letters, model = in_worker("letters", letter_table), LanguageModel(*shipped.value)
        for texts in parts:
            yield pd.DataFrame([model.predict(x, letters) for x in texts], columns=["lang_pred", "score", "rejected"])

    return from_text(documents, text, "lang_pred string, score double, rejected boolean", predict)


def held_out() -> Column:
    return crc_fold("doc_id", 4) == 2


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, ~held_out())
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
