"""Operator 1: byte-level BPE encoding and decoding by a global shuffle of distinct words.

1. Each task splits its documents into pre-tokens and numbers the distinct ones of a block of documents; a
   document becomes the sequence of those numbers, position by position.
2. The distinct pre-tokens of all blocks are shuffled by their hash. Equal ones meet, each is encoded once,
   and its ids go back to every block that holds it.
3. Blocks join their ids and put the documents together by position.
4. Decoding looks every id up in the token-byte table, whose size is that of the vocabulary: a broadcast join that
   runs on packed arrays in the worker, as a row for each id would be many times the input.

Word lists and positions travel compressed, a row for each block and share of the hash space, so that a word
that stands in every document is one entry of each block: no key can grow hot. (A share of more distinct words than the
worker's memory of WORD_BYTES holds encodes some of them again.)

Null and empty texts have no ids and decode to nothing. Rows are carried through, never looked up by doc_id:
repeated and null ids are kept. Extra columns are dropped. Texts are encoded whole. The documents are read twice and must come in the
same order both times, as files do; blocks carry a mark of their words, and a job whose marks differ fails.
"""

from __future__ import annotations

import base64
import itertools
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, in_worker, table, tidied

RANKS = "byte_bpe_50k.tiktoken"
BLOCK_CHARS, BLOCK_DOCS = 8_000_000, 100_000  # text and rows of a block: bound the memory of steps 1 and 3
WORD_BYTES = 128 << 20
LEAST_SHARES = 64  # shares of the hash space that a block's words are dealt into; as many as shuffle partitions, if these are more


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: join the adjacent pair of the lowest rank, the leftmost among equals, until none is left."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    parts = [word[i : i + 1] for i in range(len(word))]
    if len(parts) > 64:
        return merge_long(parts, ranks)
    while True:
        low = at = None
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (low is None or rank < low):
                low, at = rank, i
        if low is None:
            return [ranks[p] for p in parts]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


def merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """merge_word for long pre-tokens, with a heap of pairs over a linked list."""
    import heapq

    n = len(parts)
    after, before = [*range(1, n), -1], list(range(-1, n - 1))
    heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, joined = heapq.heappop(heap)
        if not parts[i] or (j := after[i]) < 0 or parts[i] + parts[j] != joined:
            continue
        parts[i], parts[j], after[i] = joined, b"", after[j]
        if (k := after[i]) >= 0:
            before[k] = i
            if (r := ranks.get(two := joined + parts[k])) is not None:
                heapq.heappush(heap, (r, i, two))
        if (p := before[i]) >= 0 and (r := ranks.get(two := parts[p] + joined)) is not None:
            heapq.heappush(heap, (r, p, two))
    return [ranks[p] for p in parts if p]


# The classes of public_tokenizers.PATTERN among the characters of Latin-1.
LETTERS, NUMBERS, SPACES = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
LATIN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"


def splitter(pattern: str):
    """A function from a text to its pre-tokens; texts of Latin-1 go by the faster standard library where the pattern is the public one."""
    import regex

    general = regex.compile(pattern).findall
    if pattern != public_tokenizers.PATTERN:
        return general
    latin = re.compile(LATIN).findall

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return general(text)
        return latin(text)

    return split


def split_blocks(documents: DataFrame, pattern: str, shares: int, positions: bool, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of step 1: of each document its positions (numbers of its block's words, packed), or of each block and share its words."""

    def split(batches: Iterator):
        cut, task, count = splitter(pattern), TaskContext.get().partitionId(), 0

        def block(docs: list, parts: list, number: dict[str, int]) -> pd.DataFrame:
            nonlocal count
            at = (task << 24) + count
            count += 1
            words = [w.encode() for w in number]
            mark = xxhash.xxh3_64_intdigest(b"\n".join(words)) - (1 << 63)
            share = np.fromiter((zlib.crc32(w) % shares for w in words), np.int64, len(words))
            order = np.argsort(share, kind="stable")  # words are numbered in the order in which the shares list them
            if positions:
                rank = np.empty(len(words), np.int64)
                rank[order] = np.arange(len(words))
                rows = [(at, mark, d, len(p), zlib.compress(rank[p].astype("<u4").reshape(-1, 1).view(np.uint8).T.tobytes(), 1)) for d, p in zip(docs, parts, strict=True)]
                return pd.DataFrame(rows, columns=["block", "mark", "doc_id", "n", "packed"]).astype({"doc_id": "Int64"})
            edges, rows = np.searchsorted(share[order], np.arange(shares + 1)), []
            for s in range(shares):
                own = [words[i] for i in order[edges[s] : edges[s + 1]]]
                sizes = np.fromiter(map(len, own), "<u4", len(own)).tobytes()
                rows.append((at, mark, s, len(own), zlib.compress(sizes + b"".join(own), 1)))
            return pd.DataFrame(rows, columns=["block", "mark", "share", "n", "packed"])

        docs, parts, number, chars = [], [], defaultdict(itertools.count().__next__), 0
        for batch in batches:
            for doc, value in zip(batch[doc_id].astype("Int64"), batch[text], strict=True):
                words = cut(value) if isinstance(value, str) else []
                found = np.fromiter(map(number.__getitem__, words), np.int32, len(words))
                docs.append(doc)
                parts.append(found if positions else None)
                chars += len(words) and len(value)
                if chars >= BLOCK_CHARS or len(docs) >= BLOCK_DOCS:
                    yield block(docs, parts, number)
                    docs, parts, number, chars = [], [], defaultdict(itertools.count().__next__), 0
        if docs:
            yield block(docs, parts, number)

    kind = "doc_id bigint" if positions else "share int"
    return documents.select(doc_id, text).mapInPandas(tidied(split), f"block bigint, mark bigint, {kind}, n bigint, packed binary")


def unpack_words(packed: bytes, n: int) -> list[bytes]:
    raw = zlib.decompress(packed)
    ends = np.cumsum(np.frombuffer(raw, "<u4", n)) + 4 * n
    at, out = 4 * n, []
    for end in ends.tolist():
        out.append(raw[at:end])
        at = end
    return out


def encode(documents: DataFrame, rank_path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row of (doc_id, text); ids are packed little-endian unsigned 32-bit integers."""
    shares = max(LEAST_SHARES, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # The rows of step 1 are as large as the input: to write them would cost more than to split twice, for words and for positions.
    words, docs = (split_blocks(documents, pattern, shares, positions) for positions in (False, True))

    def ranked() -> tuple[dict[bytes, int], str]:
        ranks = in_worker(f"ranks {rank_path}", lambda: read_ranks(rank_path))
        return ranks, "H" if max(ranks.values(), default=0) < 1 << 16 else "I"

    def encode_share(batches: Iterator):
        ranks, code = ranked()

        def ids_of(word: bytes) -> bytes:
            ids = merge_word(word, ranks)
            return struct.pack(f"<{len(ids)}{code}", *ids)

        once = Memo(ids_of, WORD_BYTES)
        for batch in batches:
            out = []
            for block, mark, share, n, packed in batch[["block", "mark", "share", "n", "packed"]].itertuples(index=False):
                ids = [once[w] for w in unpack_words(packed, n)]
                sizes = np.fromiter(map(len, ids), "<u4", n).tobytes()
                out.append((block, mark, share, n, zlib.compress(sizes + b"".join(ids), 1)))
            yield pd.DataFrame(out, columns=["block", "mark", "share", "n", "packed"])

    # Equal words lie in equal shares, so a share is the unit of the shuffle; its rows stay small and many.
    encoded = words.repartition(shares, "share").mapInPandas(tidied(encode_share), "block bigint, mark bigint, share int, n bigint, packed binary")

    def assemble(key, positions, ids):
        if {*positions["mark"]} != {*ids["mark"]}:
            raise ValueError("the documents came in another order when they were read again: write them out first")
        code, table = f"<{ranked()[1]}", []
        for n, packed in ids.sort_values("share")[["n", "packed"]].itertuples(index=False):
            table += unpack_words(packed, n)
        rows = []
        for doc, n, packed in zip(positions["doc_id"].astype("Int64"), positions["n"], positions["packed"], strict=True):
            raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1).T if n else np.zeros((0, 4), np.uint8)
            numbers = np.ascontiguousarray(raw).view("<u4").ravel().tolist()
            found = np.frombuffer(b"".join(map(table.__getitem__, numbers)), code)
            rows.append((doc, len(found), found.astype("<u4").tobytes()))
        return pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids"]).astype({"doc_id": "Int64"})

    return docs.groupBy("block").cogroup(encoded.groupBy("block")).applyInPandas(assemble, "doc_id bigint, n_tokens bigint, ids binary")


def decode(encoded: DataFrame, rank_path: str) -> DataFrame:
    """`encoded` (doc_id, n_tokens, ids) with the bytes of its ids in `decoded`, from the token-byte table."""

    def token_bytes() -> list[bytes]:
        known = {i: b for b, i in read_ranks(rank_path).items()}
        return [known.get(i, b"") for i in range(max(known, default=-1) + 1)]

    def join_bytes(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = in_worker(f"bytes {rank_path}", token_bytes)
        for ids in parts:
            yield pd.Series([b"".join(map(table.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in ids])

    return encoded.withColumn("decoded", F.pandas_udf(join_bytes, "binary")("ids"))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(RANKS)
    both = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
