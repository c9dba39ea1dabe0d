"""Period runs, toxicity and fill-in-the-middle: brute force, the registered queries over the whole smallest tables, awkward rows."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_llm import AWKWARD, SCHEMA

from framelake.llm import fill_middle, period_runs, queries, toxicity

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def awkward(spark):
    extra = ["score", "n", "form", "output", "restored", "n_runs", "start", "runs", "collapsed", "text_", "draw"]
    return spark.createDataFrame(AWKWARD, SCHEMA).withColumns({c: F.lit("x") for c in extra})


def plain_runs(words: list) -> list[tuple[int, int, int]]:
    """Every run, by trying each period."""
    n, out = len(words), []
    codes = np.array([words.index(w) for w in words])
    for q in range(1, n // 4 + 1):
        same = np.concatenate([[0], (codes[q:] == codes[:-q]).astype(int), [0]])
        for a, b in zip(np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1), strict=True):
            a, size = int(a), int(b - a) + q
            if size >= max(6, 4 * q) and not any(q % d == 0 and (codes[a : a + size - d] == codes[a + d : a + size]).all() for d in range(1, q)):
                out.append((a, size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def own_words(doc: str, text: str) -> list[bytes]:
    words = SPACE.findall(text.encode())
    n, h = len(words), zlib.crc32(doc.encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def run_row(words: list[bytes]) -> tuple:
    runs = plain_runs(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    longest = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    told = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    return (len(runs), *((*longest, 1000 * longest[1] // longest[2]) if longest else (None,) * 4), hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def rows_of(frame: pd.DataFrame, columns: list[str]) -> list[tuple]:
    return [tuple(None if pd.isna(v) else v if isinstance(v, str) else int(v) for v in r) for r in frame[columns].itertuples(index=False, name=None)]


DIGEST = [*period_runs.LONGEST, "runs_sha256", "collapsed_sha256"]


def test_op11(spark, docs):
    got = queries.QUERIES["op11_period_runs"](spark, SF).toPandas()
    assert got.columns.tolist() == ["doc_id", *DIGEST] and len(got) == len(docs)
    found = dict(zip(got.doc_id, rows_of(got, DIGEST), strict=True))
    want = {doc: run_row(own_words(str(doc), text or "")) for doc, text in zip(docs.doc_id, docs.text, strict=True)}
    assert found == want and sum(r[0] > 0 for r in want.values()) > 10


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_of_random_words(seed):
    rng = random.Random(seed)
    for _ in range(150):
        texts = []
        for _ in range(rng.randrange(1, 6)):
            words, kinds = [], rng.choice([1, 2, 3, 5])
            while len(words) < rng.randrange(120):
                unit = [rng.randrange(kinds) for _ in range(rng.randrange(1, 14))]
                words += unit * rng.randrange(1, 7) + unit[: rng.randrange(len(unit))]
            texts.append([b"%d" % w for w in words])
        for words, (runs, stays) in zip(texts, period_runs.search(texts), strict=True):
            want = plain_runs(words)
            assert [tuple(r) for r in runs.tolist()] == want
            gone = {i for s, size, q in want for i in range(s + q, s + size)}
            assert np.flatnonzero(~stays).tolist() == sorted(gone)


def test_wavelet_tree():
    rng = np.random.default_rng(4)
    values = rng.permutation(500)
    tree = period_runs.WaveletTree(values, 10)
    low = rng.integers(0, 500, 400)
    high, after = np.minimum(500, low + rng.integers(0, 60, 400)), rng.integers(-1, 510, 400)
    want = [min((v for v in values[a:b] if v > x), default=-1) for a, b, x in zip(low, high, after, strict=True)]
    assert tree.successor(low, high, after).tolist() == want


def test_runs_awkward(spark, awkward):
    """A draw of 1 leaves the words as they are; texts of nulls, blanks and 70,000 equal words; repeated rows; no rows."""
    got = period_runs.period_runs(awkward).toPandas()
    assert len(got) == len(AWKWARD) and got.columns.tolist()[:4] == ["doc_id", "text", "lang", "source"] and (got.draw == "x").all()
    by = {r.doc_id: r for r in got.itertuples()}
    assert (by[5].n_runs, by[5].start, by[5].length, by[5].period, by[5].exponent_milli, by[5].collapsed) == (1, 0, 70_000, 1, 70_000_000, "word")
    assert by[2].n_runs == by[3].n_runs == 0 and pd.isna(by[2].start) and by[2].collapsed == "" and by[4].collapsed == "two spaces tabs"
    assert [tuple(r) for r in by[5].runs] == [(0, 70_000, 1)] and got[got.doc_id.isna()].collapsed.iat[0] == "un deux trois"
    assert period_runs.period_runs(awkward.limit(0)).count() == 0
    drawn = period_runs.period_runs(awkward, draw=F.lit(10), digests=True).toPandas()  # a = 1 % n, p = 1 + (n - a) // 4
    words = [w for w in SPACE.findall(AWKWARD[0][1].encode())]
    p = 1 + (len(words) - 1) // 4
    again = [w if i < 1 else words[1 + (i - 1) % p] for i, w in enumerate(words)]
    assert set(rows_of(drawn[drawn.doc_id == 1], DIGEST)) == {run_row(again)}


def test_op12(spark, docs):
    """Scores by hand from the fitted weights; held-out rows; nothing but the text counts."""
    got = queries.QUERIES["op12_toxicity"](spark, SF).toPandas().set_index("doc_id")
    assert got.columns.tolist() == ["held_out", "score", "predicted"] and len(got) == len(docs)
    weights = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"), ~toxicity.held_out())
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got.index]).all() and (got.predicted == (got.score >= 0.5)).all()
    for doc, text in zip(docs.doc_id, docs.text.fillna(""), strict=True):
        present = set(toxicity.grams(text).tolist())
        margin = weights[-1] + sum(weights[i] for i in present)
        assert abs(got.loc[doc].score - 1 / (1 + np.exp(-np.clip(margin, -35, 35)))) < 1e-9


def test_toxicity_learns_inserted_words(spark):
    rng = random.Random(3)
    syllables = ["ba", "lo", "ti", "ru", "ne", "sa", "ko", "mi"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    rude = ["zwurg", "Fnarx", "plokvat"]
    rows = []
    for i in range(1200):
        words, toxic = [word() for _ in range(rng.randrange(20, 200))], i % 6 == 0
        if toxic:
            for _ in range(rng.randrange(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(rude) + rng.choice(["", "!", "en", ","]))
        rows.append((i, " ".join(words), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    weights = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"), ~toxicity.held_out())
    got = toxicity.score(df, weights).withColumn("held", toxicity.held_out()).toPandas()
    held = got[got.held]
    assert len(held) > 150 and ((held.score >= 0.5) == (held.toxic == 1)).mean() > 0.99


def test_toxicity_awkward(spark, awkward):
    labels = spark.createDataFrame([(1, 1), (9, 0), (4, None), (None, 1), (7, 1), (8, 0), (8, 1), (5, 7)], "doc_id bigint, toxic int")
    weights = toxicity.fit(awkward, labels, F.lit(True))
    got = toxicity.score(awkward, weights).toPandas()
    assert len(got) == len(AWKWARD) and got.score.between(0, 1).all() and got[got.doc_id == 2].score.iat[0] == got[got.doc_id == 3].score.iat[0]
    assert got[got.doc_id == 1].score.nunique() == 1 and (got.form == "x").all()
    for some, score in ((labels.limit(0), 0.5), (labels.where("toxic = 1"), 0.95)):
        flat = toxicity.fit(awkward, some, F.lit(True))
        assert set(toxicity.score(awkward, flat).toPandas().score.round(9)) == {score}
    assert toxicity.score(awkward.limit(0), weights).count() == 0
    assert toxicity.fit(awkward.limit(0), labels, F.lit(True))[:-1].any() == False  # noqa: E712


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_TOXIC", 5)
    monkeypatch.setattr(toxicity, "SAMPLE_CLEAN", 7)
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 30)
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, labels, shares: seen.append((texts, labels, shares)) or np.zeros(3))
    toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"), F.lit(True))
    texts, labels, shares = seen[0]
    assert sorted(labels) == [0] * 7 + [1] * 5 and max(map(len, texts)) <= 30 and abs(shares[0] + shares[1] - 1) < 1e-9


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def test_op13(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(queries.ORACLES["op13_fill_in_middle"]).df()
    got = queries.QUERIES["op13_fill_in_middle"](spark, SF).toPandas()
    assert got.columns.tolist() == want.columns.tolist() and {"plain", "spm", "psm"} == set(got.form)
    assert sorted(map(repr, rows_of(got, got.columns.tolist()))) == sorted(map(repr, rows_of(want, want.columns.tolist())))


@pytest.mark.parametrize("block", [3, 8, 1024])
def test_cuts(block):
    rng = random.Random(block)
    for _ in range(200):
        text = "".join(rng.choice(["a", "é", "🎉", " ", "  ", "\n", "\t", "word", "日本"]) for _ in range(rng.randrange(60)))
        units, held = UNIT.findall(text), fill_middle.Units(text.encode(), block)
        assert (held.n, held.chars) == (len(units), len(text))
        for c in range(len(units) + 1):
            head = "".join(units[:c])
            assert held.cut(c) == (len(head.encode()), len(head))


def test_fill_in_middle_awkward(spark, awkward):
    """Whole outputs, rebuilt; marks in a text keep it plain; the same row gives the same result."""
    more = [(100 + i, t, "en", "a") for i, t in enumerate(["a <P> b c", "<S>", "x<M>", "one < P > two <", " \n ", "tail of blanks  \n"] * 8)]
    docs = awkward.unionByName(spark.createDataFrame(more, SCHEMA), allowMissingColumns=True)
    got = fill_middle.fill_in_middle(docs).toPandas()
    assert len(got) == len(AWKWARD) + len(more)
    for r in got.itertuples():
        text = r.text or ""
        units, doc = UNIT.findall(text), "" if pd.isna(r.doc_id) else str(int(r.doc_id))
        h = hashlib.sha256(f"42:{doc}".encode()).hexdigest()
        h = [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]
        a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
        p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
        form = "plain" if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50 else "spm" if h[3] % 100 < 80 else "psm"
        output = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        assert (r.n, r.form, r.output, r.restored) == (len(units), form, output, text)
        assert pd.isna(r.prefix_chars) and pd.isna(r.middle_chars) if form == "plain" else (r.prefix_chars, r.middle_chars) == (len(p), len(m))
    assert {"plain", "spm", "psm"} == set(got.form)
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0
