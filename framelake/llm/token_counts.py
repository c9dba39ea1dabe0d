"""Operator 5: token counts by heap-and-linked-list byte-pair merging.

A piece starts as a linked list of characters. A heap holds the adjacent pairs that the vocabulary
can join, best rank first and leftmost among equals; each valid pop is one merge. The count is the
number of initial symbols minus the merges; no identifier is looked up. A symbol that the vocabulary
lacks counts as its UTF-8 bytes (byte fallback).

The vocabulary has no piece with a word mark behind another character, so merges never cross the
start of a word and a text's count is the sum over its words; that is checked when the model is read,
and a model without the property is merged over whole texts.

Null and empty texts count 0 tokens; texts of any length are counted whole; repeated rows and extra
columns are kept as they come, a column named as the result is replaced.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, from_text, table

MARK = "▁"
MODEL = "piece_bpe_32k.model"
LIMIT = 4096


class PieceCounter:
    """Counts tokens as a sentencepiece BPE model file does, without its encoder."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.score = {model.id_to_piece(i): -model.get_score(i) for i in plain}
        self.longest = max(map(len, self.score))
        self.by_word = not any(MARK in piece.lstrip(MARK) for piece in self.score)
        self.cache = Memo(self.merge, 192 << 20)

    def merge(self, piece: str) -> int:
        n, score = len(piece), self.score
        symbol, after, before = list(piece), [*range(1, n), -1], list(range(-1, n - 1))
        heap: list[tuple[float, int, str]] = []
        for i in range(n - 1):
            if (s := score.get(two := piece[i : i + 2])) is not None:
                heap.append((s, i, two))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, joined = heapq.heappop(heap)
            if not symbol[i] or (j := after[i]) < 0 or len(symbol[i]) + len(symbol[j]) != len(joined) or symbol[i] + symbol[j] != joined:
                continue  # an older state of the list
            symbol[i], symbol[j] = joined, ""
            merges += 1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (s := score.get(two := joined + symbol[k])) is not None:
                    heapq.heappush(heap, (s, i, two))
            if (p := before[i]) >= 0 and (s := score.get(two := symbol[p] + joined)) is not None:
                heapq.heappush(heap, (s, p, two))
        unknown = sum(len(x.encode()) - 1 for x in symbol if len(x) == 1 and x not in score)
        return n - merges + unknown

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.by_word or "  " in text or MARK in text or text[0] == " ":
            whole = MARK + text.replace(" ", MARK)
            if not self.by_word:
                return self.merge(whole)
            total, at, n = 0, 0, len(whole)
            while at < n:  # a run of marks, then what follows up to the next mark
                end = at
                while end < n and whole[end] == MARK:
                    end += 1
                stop = whole.find(MARK, end)
                stop = n if stop < 0 else stop
                total += self.cache[whole[at:stop]]
                at = stop
            return total
        cache = self.cache
        return sum([cache[MARK + word] for word in text.split(" ")])


def count_tokens(documents: DataFrame, model_path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """`documents` with the token count of every whole text in a column `out`."""

    def count(parts: Iterator):
        counter = PieceCounter(model_path)
        for texts in parts:
            yield pd.DataFrame({out: [counter.count(x) if isinstance(x, str) else 0 for x in texts]})

    return from_text(documents, text, f"{out} bigint", count)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    counted = count_tokens(docs, public_tokenizers.path(MODEL))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
