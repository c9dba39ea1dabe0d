"""Operator 13: fill-in-the-middle transformation with cuts found in a Fenwick tree.

A text is held as UTF-8 in fixed blocks of BLOCK bytes. A unit is a run of white space and the word behind it, or white space at the end of the
text; it ends where a word ends. Two Fenwick trees hold the units that end in each block and the code points that begin in it. A cut after c
units is found by binary lifting: one descent gives the block of the c-th end, the code points and units before it; the end itself is then
looked up in this block alone. Cuts, form and order depend on SEED and the document's id, never on its neighbours.

Null and empty texts are plain with n = 0. A text that holds one of the three marks stays plain, so that the output can be taken apart again. A
null doc_id counts as the empty string. Repeated rows are each transformed alike; other columns are kept, columns named as results are replaced.
White space is `[\\x20\\x09-\\x0D]`. Texts of any length are treated whole.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tidied

SEED = 42
BLOCK = 1024  # bytes
FIM_PERCENT = 50  # of the texts without marks are transformed
SPM_PERCENT = 80  # of those have their suffix first
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MADE = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string, restored string"
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


class Fenwick:
    """Prefix sums of counts, and the descent to the entry that reaches a wanted sum."""

    def __init__(self, counts: np.ndarray):
        n = len(counts)
        sums, at = np.concatenate([[0], np.cumsum(counts)]), np.arange(n + 1)
        self.tree = (sums - sums[at - (at & -at)]).tolist()  # entry i: the sum over the lowest set bit of i entries up to i
        self.top = 1 << n.bit_length() >> 1

    def reach(self, wanted: int, other: Fenwick) -> tuple[int, int, int]:
        """The entry in which the sum comes to `wanted` (at least 1, at most the total); this tree's and the other tree's sums before it."""
        at = before = beside = 0
        step = self.top
        while step:
            if at + step < len(self.tree) and before + self.tree[at + step] < wanted:
                at += step
                before += self.tree[at]
                beside += other.tree[at]
            step >>= 1
        return at, before, beside


class Units:
    """The units of a text and where they end."""

    def __init__(self, text: bytes, block: int = BLOCK):
        self.text, self.block = text, block
        raw = np.frombuffer(text, np.uint8)
        blank = BLANK[raw]
        self.ends = np.empty(len(raw), bool)  # the byte is the last one of a unit
        if len(raw):
            np.greater(blank[1:], blank[:-1], out=self.ends[:-1])
            self.ends[-1] = True
        self.begins = (raw & 0xC0) != 0x80  # the byte is the first one of a code point
        starts = np.arange(0, len(raw), block)
        count = lambda marks: np.add.reduceat(marks, starts, dtype=np.int64) if len(raw) else np.zeros(0, np.int64)
        self.units, self.points = Fenwick(a := count(self.ends)), Fenwick(b := count(self.begins))
        self.n, self.chars = int(a.sum()), int(b.sum())

    def cut(self, c: int) -> tuple[int, int]:
        """Bytes and code points of the first `c` units."""
        if not c:
            return 0, 0
        at, units, points = self.units.reach(c, self.points)
        low = at * self.block
        inside = int(np.flatnonzero(self.ends[low : low + self.block])[c - units - 1]) + 1
        return low + inside, points + int(self.begins[low : low + inside].sum())


def draws(doc: str, seed: int) -> tuple[int, ...]:
    digest = hashlib.sha256(f"{seed}:{doc}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def transform(doc: str, text: bytes, seed: int = SEED, block: int = BLOCK) -> tuple[int, str, int | None, int | None, bytes]:
    """Units, form, code points of prefix and middle, and the output of one text."""
    held, (h1, h2, h3, h4) = Units(text, block), draws(doc, seed)
    if not text or h3 % 100 >= FIM_PERCENT or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return held.n, "plain", None, None, text
    low, high = sorted((h1 % (held.n + 1), h2 % (held.n + 1)))
    (a, points), (b, more) = held.cut(low), held.cut(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SPM_PERCENT:
        return held.n, "spm", points, more - points, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return held.n, "psm", points, more - points, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def restore(output: bytes, form: str) -> bytes:
    """The text, from the output and its form alone: the marks stand in it once each."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    head, _, rest = output.removeprefix(first).partition(second)
    tail, _, middle = rest.partition(MIDDLE)
    return tail + middle + head if form == "spm" else head + middle + tail


def fill_in_middle(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: int = SEED, digests: bool = False) -> DataFrame:
    """`documents` with n, form, prefix_chars, middle_chars, output and restored; `digests`: the last two as lowercase hex SHA-256."""
    names, made = [f.split()[0] for f in MADE.split(", ")], f"_{uuid.uuid4().hex}"
    tell = (lambda b: hashlib.sha256(b).hexdigest()) if digests else bytes.decode

    @tidied
    def rewrite(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for docs, texts in batches:
            rows = []
            for doc, x in zip(docs, texts, strict=True):
                n, form, prefix, middle, output = transform(doc, x.encode(errors="replace") if isinstance(x, str) else b"", seed)
                rows.append((n, form, prefix, middle, tell(output), tell(restore(output, form))))
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    def batches(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        yield from rewrite(parts)

    kept = [F.col(f"`{c}`") for c in documents.columns if c not in names]
    key, body = F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.col(text).cast("string")
    told = documents.select(*kept, F.pandas_udf(batches, MADE)(key, body).alias(made))
    return told.select(*kept, *[F.col(f"{made}.{f}").alias(f) for f in names])


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), digests=True)
    return docs.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.col("output").alias("output_sha256"), F.col("restored").alias("restored_sha256"))


OP13_SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), drawn AS (
  SELECT doc_id, body, u, len(u)::BIGINT AS n, ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2, ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4 FROM units
), cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS a, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS b,
    CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parts AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN body ELSE p || m || s END) AS restored_sha256
FROM parts
"""
