"""Operator 10: vector best-fit packing of tokenised documents into fixed sequences.

Every document becomes ids plus an end id; longer ones are cut into full pieces. A full piece is a
sequence of its own. The others meet in groups of bounded size, dealt by a hash and the place of the row, and each group is packed
longest first. A sequence has residual capacities in tokens, documents and attention cost (sum of squared lengths); a piece
may only go where all three hold it. Of all such sequences it takes the one whose residual vector after the placement has the
smallest weighted norm, the oldest among equals. A piece that alone costs more than a sequence may is a sequence of its own. The default limits of documents
and cost are the largest that can matter: they steer the choice by their weights and never cost a sequence; a caller may set smaller ones, which bind.

Null and empty texts are documents of the end id alone. Repeated rows are packed as often as they come;
a null doc_id is kept. An empty table gives no sequence.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, in_worker, materialize, table, tidied

VOCABULARY = "word_bpe_49k.json"
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
CAPACITY = 2048
MAX_DOCS = CAPACITY  # documents of a sequence: each has a token at least, so this limit costs no sequence
COST_SHARE = 1.0  # attention cost of a sequence, as a share of the squared capacity: nor does this one
WEIGHTS = (1.0, 0.05, 0.05)  # of the residual tokens, documents and cost
GROUP_PIECES = 20_000  # pieces that meet in one task; a group's waste is about one sequence
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = PIECES + ", sequence_id bigint, offset bigint"


# Fixed value: the pre-tokens of the vocabulary's pattern in lower-cased text of ASCII alone.
ASCII_PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\s\x1c-\x1fa-z0-9]+")
# The same for any text, and the signs that stand for bytes: printable Latin-1 for themselves, the others from 256 on.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_SIGNS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in SHOWN)}
LATIN = "\u0250"  # below it, lower case is that of each letter by itself


class WordEncoder:
    """Little-endian ids of a text, word by word: the vocabulary's pre-tokeniser drops white space, so words are independent.

    A word is normalised and cut into pre-tokens, and each of these is merged by the library's model, once while it is remembered.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.normalizer, self.cut = self.tokenizer.model, self.tokenizer.normalizer, self.tokenizer.pre_tokenizer  # each access makes a new one
        self.words, self.parts = Memo(self.encode_word, 160 << 20), Memo(self.merge, 80 << 20)

    def encode(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def merge(self, part: str) -> bytes:
        return np.array([t.id for t in self.model.tokenize(part)], "<u4").tobytes()

    def encode_word(self, word: str) -> bytes:
        if word.isascii():
            if not word.isprintable():  # control characters and white space: as the library has them
                return self.encode(word)
            return b"".join([self.parts[p] for p in ASCII_PRE_TOKEN.findall(word.lower())])
        if max(word) < LATIN and word.isprintable() and unicodedata.is_normalized("NFC", word):
            return b"".join([self.parts[p.encode().decode("latin-1").translate(BYTE_SIGNS)] for p in PRE_TOKEN.findall(word.lower())])
        normal = self.normalizer.normalize_str(word)
        return b"".join([self.parts[p] for p, _ in self.cut.pre_tokenize_str(normal)])

    def __call__(self, text: str) -> bytes:
        if "<|" in text and any(s in text for s in SPECIAL):
            return self.encode(text)
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


def cut_pieces(documents: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Pieces of at most `capacity` ids of every document of (doc_id, text)."""

    def cut(batches: Iterator):
        encoder = in_worker(f"encoder {vocabulary}", lambda: WordEncoder(vocabulary))
        end, wide = np.uint32(end_id).tobytes(), 4 * capacity
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"].astype("Int64"), batch["text"], strict=True):
                ids = encoder(text) + end if isinstance(text, str) else end
                for k, at in enumerate(range(0, len(ids), wide)):
                    part = ids[at : at + wide]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return documents.select("doc_id", "text").mapInPandas(tidied(cut), PIECES)


def best_fit(lengths: np.ndarray, capacity: int, max_docs: int, max_cost: int, weights: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every length. Sequences that have no room for the shortest length that is left are set aside."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    w = np.array(weights) / (capacity, max_docs, max_cost)
    left = np.zeros((3, len(lengths)))  # residual tokens, documents, cost of the open sequences
    name, opened, count = np.zeros(len(lengths), np.int64), 0, 0
    shortest = int(lengths[order[-1]]) if len(order) else 0
    for i in order.tolist():
        length = int(lengths[i])
        need = np.array([length, 1, length * length])
        after = left[:, :opened] - need[:, None]
        fits = after.min(axis=0) >= 0
        if fits.any():
            after *= w[:, None]
            norm = np.einsum("ij,ij->j", after, after)
            norm[~fits] = np.inf
            k = int(norm.argmin())
        else:
            k, opened, count = opened, opened + 1, count + 1
            left[:, k], name[k] = (capacity, max_docs, max_cost), count - 1
        bins[i], offsets[i] = name[k], capacity - left[0, k]
        left[:, k] -= need
        if (left[:, k] < (shortest, 1, shortest * shortest)).any():  # keeps the order of the others
            left[:, k : opened - 1], name[k : opened - 1] = left[:, k + 1 : opened].copy(), name[k + 1 : opened].copy()
            opened -= 1
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, max_docs: int = MAX_DOCS, max_cost: int | None = None, weights=WEIGHTS, group: int = GROUP_PIECES) -> DataFrame:
    """`pieces` (length at least), written or read before, with sequence_id and offset."""
    max_cost = int(COST_SHARE * capacity**2) if max_cost is None else max_cost
    alone = (F.col("length") >= capacity) | (F.col("length") * F.col("length") > max_cost)
    full, rest = pieces.where(alone), pieces.where(~alone)
    groups = max(1, -(-rest.count() // group))
    dealt = rest.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id(), "length"), F.lit(groups)))  # equal rows are dealt out

    def fit(key, frame):
        bins, offsets = best_fit(frame["length"].to_numpy(), capacity, max_docs, max_cost, weights)
        return frame.drop(columns="g").assign(sequence_id=(int(key[0]) << 32) | bins, offset=offsets)

    packed = dealt.groupBy("g").applyInPandas(fit, pieces.select("*", F.lit(0).cast("bigint").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")).schema)
    single = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("bigint"))
    return packed.unionByName(single)


def pack_documents(documents: DataFrame, vocabulary: str, capacity: int = CAPACITY, **limits) -> DataFrame:
    return pack(materialize(cut_pieces(documents, vocabulary, capacity), "pieces"), capacity, **limits)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
