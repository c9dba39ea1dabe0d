"""Training-data operators against brute force, their libraries, and awkward inputs."""

import importlib.util
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers as public
import pytest
from conftest import SF
from pyspark.sql import functions as F

from framelake.llm import byte_bpe, html_text, language_id, licenses, metric_join, ngram_jaccard, packing, quality_classifier, quality_rules, token_counts

AWKWARD = [
    (1, "the cat sat on the mat and the dog lay by the door all day long", "en", "a"), (1, "the cat sat on the mat and the dog lay by the door all day long", "en", "a"), (2, None, None, None), (3, "", "de", "a"),
    (None, "un deux trois", "fr", "b"), (4, "  two  spaces \t\n\n tabs  ", "en", "b"), (5, "word " * 70_000, "en", "c"), (6, "é" * 5000 + " ▁ 日本語 🎉 <s> <|endoftext|> <unk>", None, "c"),
    (7, "one two", "en", "c"), (8, "ONE two", "en", "c"), (9, "12345 !!! ***", "en", "c"), (10, "Released under the MIT License.\nall rights reserved", "en", "a"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"


@pytest.fixture(scope="module")
def awkward(spark):
    extra = ["score", "rejected", "n_tokens", "key", "component", "w", "n", "lang_pred"]
    return spark.createDataFrame(AWKWARD, SCHEMA).withColumns({c: F.lit("x") for c in extra})


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def counter():
    return token_counts.PieceCounter(public.path(token_counts.MODEL))


def test_token_counts(spark, awkward, nothing):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public.path(token_counts.MODEL))
    got = token_counts.count_tokens(awkward, public.path(token_counts.MODEL)).toPandas()
    assert len(got) == len(AWKWARD)
    for text, n in zip(got.text, got.n_tokens, strict=True):
        assert n == len(model.encode(text or ""))
    assert token_counts.count_tokens(nothing, public.path(token_counts.MODEL)).count() == 0
    rng = random.Random(5)
    c = counter()
    for _ in range(300):
        text = "".join(rng.choice(["a", "th", "e ", " ", "  ", "▁", "\n", "é", "日", "<s>", "ing", "x́", "🎉"]) for _ in range(rng.randrange(30)))
        assert c.count(text) == len(model.encode(text)), repr(text)


def test_byte_bpe(spark, awkward, nothing):
    import tiktoken

    path = public.path(byte_bpe.RANKS)
    codec = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    got = byte_bpe.decode(byte_bpe.encode(awkward, path), path).toPandas()
    want = sorted((np.array(codec.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for _, t, _, _ in AWKWARD)
    assert sorted((bytes(a), bytes(b)) for a, b in zip(got.ids, got.decoded, strict=True)) == want
    assert byte_bpe.encode(nothing, path).count() == 0
    ranks = byte_bpe.read_ranks(path)
    for word in ("x" * 100, "abcdefghij" * 20, "é" * 90):
        assert byte_bpe.merge_word(word.encode(), ranks) == codec.encode_ordinary(word)


def test_packing(spark, awkward, nothing):
    from tokenizers import Tokenizer

    path = public.path(packing.VOCABULARY)
    library = Tokenizer.from_file(path)
    got = packing.pack_documents(awkward, path, 512, max_docs=3, weights=(1.0, 0.1, 0.1)).toPandas()
    want = []
    for doc, text, _, _ in AWKWARD:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(doc or -1, at // 512, at, len(ids[at : at + 512]), zlib.crc32(ids[at : at + 512].tobytes())) for at in range(0, len(ids), 512)]
    own = got.fillna({"doc_id": -1}).astype("int64")
    assert sorted(own[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(want)
    for _, s in own.sort_values("offset").groupby("sequence_id"):
        assert s.length.sum() <= 512 and s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]]
    assert packing.pack_documents(nothing, path).count() == 0


def test_best_fit_constraints():
    lengths = np.random.default_rng(1).integers(1, 90, 500)
    bins, offsets = packing.best_fit(lengths, 100, 3, 5000, (1.0, 0.1, 0.1))
    for b in set(bins.tolist()):
        own = lengths[bins == b]
        assert own.sum() <= 100 and len(own) <= 3 and ((own**2).sum() <= 5000 or len(own) == 1)
    loose, _ = packing.best_fit(lengths, 100, 100, 10_000, (1.0, 0.02, 0.0))
    assert loose.max() + 1 <= 1.05 * lengths.sum() / 100 + 1


def components(sets, linked):
    parent = list(range(len(sets)))
    find = lambda i: i if parent[i] == i else find(parent[i])
    for i in range(len(sets)):
        for j in range(i):
            if linked(sets[i], sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(sets))]


def random_texts(n, rng):
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    base = [rng.choice(vocabulary) for _ in range(80)]
    texts = []
    for i in range(n):
        kind = i % 4
        if kind == 0:
            words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))]
        elif kind == 1:
            words = [w if rng.random() > 0.012 else rng.choice(vocabulary) for w in base]
        elif kind == 2:
            words = [*passage.split(), *(rng.choice(vocabulary) for _ in range(rng.randrange(0, 15)))]
        else:
            words = rng.choice(texts).split() if texts else []
            words = [w.upper() for w in words[: len(words) - rng.randrange(0, 4)]]
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("block,frequent,long", [(1000, 64, 300), (7, 8, 40)])
def test_ngram_jaccard(spark, monkeypatch, block, frequent, long):
    monkeypatch.setattr(ngram_jaccard, "BLOCK", block)
    monkeypatch.setattr(ngram_jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_jaccard, "LOCAL", 2)
    monkeypatch.setattr(ngram_jaccard, "LONG", long)
    texts = random_texts(220, random.Random(block))
    got = ngram_jaccard.join_components(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), 4, 85).toPandas().sort_values("doc_id")

    def shingles(text):
        words = text.lower().split()
        return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()

    sets = [shingles(t) for t in texts]
    want = components(sets, lambda a, b: bool(a and b) and 100 * len(a & b) >= 85 * len(a | b))
    assert got.n_shingles.tolist() == [len(s) for s in sets]
    assert got.component_id.tolist() == want


def test_ngram_jaccard_awkward(awkward, nothing):
    got = ngram_jaccard.join_components(awkward, 4, 85).toPandas()
    assert len(got) == len(AWKWARD) and got.component_id.isna().sum() == 1
    assert set(got[got.doc_id.isin([7, 8])].component_id) == {7} and set(got[got.doc_id == 2].n_shingles) == {0}
    assert ngram_jaccard.join_components(nothing).count() == 0


def test_metric_join(spark, monkeypatch):
    monkeypatch.setattr(metric_join, "BLOCK", 9)
    monkeypatch.setattr(metric_join, "HOME_BLOCK", 4)
    monkeypatch.setattr(metric_join, "SLICE", 7)
    monkeypatch.setattr(metric_join, "PER_CELL", 10)
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 8))
    vectors = [(centers[i % 12] + rng.normal(size=8) * rng.choice([0.05, 0.2, 0.4])).astype("f4").tolist() for i in range(150)]
    vectors += vectors[:20] + [None, [0.0] * 8, [float("nan")] * 8, [None, *[1.0] * 7], [1.0, 2.0], []]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<float>").withColumn("key", F.lit(1))
    got = metric_join.near_duplicates(df).toPandas().sort_values("vec_id")

    def unit(v):
        if v is None or len(v) != 8 or any(c is None or not np.isfinite(c) for c in v) or not any(v):
            return None
        v = np.asarray(v, float)
        return v / np.sqrt(v @ v)

    units = [unit(v) for v in vectors]
    near = lambda a, b: a is not None and b is not None and float(a @ b) >= 0.95 - 1e-12
    assert got.component_id.tolist() == components(units, near)
    assert got.n_links.tolist() == [sum(near(a, b) for j, b in enumerate(units) if j != i) for i, a in enumerate(units)]
    assert metric_join.near_duplicates(df.limit(0)).count() == 0


def test_quality_rules(spark, awkward, nothing):
    con = duckdb.connect()
    con.register("t", pd.DataFrame(AWKWARD, columns=["doc_id", "text", "lang", "source"]).astype({"doc_id": "Int64"}))
    con.execute("create view documents as select * from t")
    want = con.execute(quality_rules.OP2_SQL).df()
    measured = quality_rules.measure(awkward)
    hosts = quality_rules.host_verdicts(measured).select(F.col("source").alias("host"), "host_kept")
    got = measured.join(hosts, F.col("source").eqNullSafe(F.col("host"))).withColumn("kept", ~F.col("base_failed") & F.col("host_kept")).select(want.columns.tolist()).toPandas()
    rows = lambda d: sorted(repr([None if pd.isna(v) else int(v) for v in r]) for r in d.itertuples(index=False, name=None))
    assert rows(got) == rows(want)
    assert quality_rules.host_verdicts(quality_rules.measure(nothing)).count() == 0


def test_language_id(spark, awkward, nothing):
    rng = random.Random(2)
    parts = {"aa": ["ba", "lo", "ti"], "bb": ["sch", "ung", "ver"]}
    rows = [(i, " ".join("".join(rng.choice(parts[k]) for _ in range(3)) for _ in range(20)), k) for i in range(80) for k in parts]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), F.lit(True))
    test = spark.createDataFrame([(1, "balotiba tiloba", "score"), (2, "schungver verung", "x"), (3, "日本 語語 日本", "x"), (4, None, "x"), (5, "123 !!", "x")], "doc_id bigint, text string, score string")
    got = {r["doc_id"]: r for r in language_id.identify(test, model).collect()}
    assert (got[1]["lang_pred"], got[2]["lang_pred"]) == ("aa", "bb") and not got[1]["rejected"]
    assert got[3]["rejected"] and got[4]["lang_pred"] == got[5]["lang_pred"] == "und" and got[4]["score"] == 0
    empty = language_id.fit(nothing, F.lit(True))
    assert {r["lang_pred"] for r in language_id.identify(awkward, empty).collect()} == {"und"}
    assert language_id.identify(nothing, model).count() == 0


def test_held_out_accuracy(spark):
    got = language_id.op4_language_id(spark, SF).toPandas().merge(pd.read_parquet(f"{SF}/documents.parquet"), on="doc_id")
    assert (got[got.held_out].lang_pred == got[got.held_out].lang).mean() > 0.95
    got = quality_classifier.op7_quality_classifier(spark, SF).toPandas().merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    assert (got.predicted == got.quality).mean() > 0.9


def test_quality_classifier(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1), (9, 0), (4, None), (None, 1), (7, 1), (8, 0), (8, 1)], "doc_id bigint, quality int")
    weights = quality_classifier.fit(awkward, labels, F.lit(True))
    got = quality_classifier.score(awkward, weights).toPandas()
    assert len(got) == len(AWKWARD) and got.score.between(0, 1).all()
    assert got[got.doc_id == 9].score.iat[0] < got[got.doc_id == 1].score.iat[0]
    flat = quality_classifier.fit(awkward, labels.limit(0), F.lit(True))
    assert set(quality_classifier.score(awkward, flat).toPandas().score) == {0.5}
    assert quality_classifier.score(nothing, weights).count() == 0


def test_licenses(spark, awkward, nothing):
    got = licenses.scan(awkward).toPandas()
    assert sorted(zip(got.doc_id, got.paragraph, got.family, strict=True)) == [(10, 0, "mit"), (10, 1, "proprietary")]
    assert licenses.scan(nothing).count() == 0


PAGE = """<html><head><title>t</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><nav><ul><li>menu</ul></nav><div class="block">Subscribe now to our site</div>
<div><h2>{0} &amp; title</h2><p>First <b>bold</b>&nbsp;text {0}<br>more<p>Second  para {0} <span class="ad">AD</span> end</div><script>var x = "</p>";</script><div class="comments"><p>nice</p></div>
<div>Terms of use of the site</div><form>f</form><aside>side</aside></body></html>"""


def test_html(spark):
    pages = [(i, f"http://www.a.org/{i}", PAGE.format(f"page{i}")) for i in range(6)] + [(7, None, None), (8, "x", ""), (8, "x", ""), (None, "http://b.org", "<p>only &lt;one&gt; &am")]
    pages += [(20 + i, f"http://b.org/{i}", "<body><article><h1>T</h1><p>same text</p></article><p>boiler</p>") for i in range(5)]
    got = html_text.extract(spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("text", F.lit(0))).toPandas()
    assert len(got) == len(pages) and (got.n_chars == got.text.map(len)).all()
    texts = {r.page_id: r.text for r in got.itertuples()}
    assert texts[3] == "page3 & title\nFirst bold text page3 more\nSecond para page3 end"
    assert texts[7] == texts[8] == "" and texts[22] == "T\nsame text"
    assert got[got.page_id.isna()].text.iat[0] == "only <one> &am"


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline goes with this folder")
def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, SF)
        assert after.columns == docs.columns, name
        after = after.cache()
        assert after.exceptAll(kept).isEmpty()
        kept = after
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids))
    found = ngram_jaccard.join_components(kept).toPandas()
    assert (found.doc_id == found.component_id).all()
    assert set(corpus_pipeline.STAGES[-1][1](spark, kept, SF).toPandas().doc_id) == set(ids)
