"""The registered queries by name, over the whole smallest tables, against libraries and brute force; the pipeline from end to end."""

import hashlib
import html as entities
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers as public
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_llm import components

from framelake.llm import byte_bpe, language_id, packing, quality_classifier, quality_rules, queries, token_counts


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet")


def run(spark, name: str) -> pd.DataFrame:
    return queries.QUERIES[name](spark, SF).toPandas()


def shingles(text: str, size: int) -> set:
    words = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def alike(percent: int):
    return lambda a, b: bool(a and b) and 100 * len(a & b) >= percent * len(a | b)


def test_op1(spark, docs):
    import tiktoken

    codec = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public.path(byte_bpe.RANKS)), special_tokens={})
    got = run(spark, "op1_byte_bpe").set_index("doc_id")
    assert len(got) == len(docs)
    for doc, text in zip(docs.doc_id, docs.text.fillna(""), strict=True):
        ids = np.array(codec.encode_ordinary(text), "<u4")
        row = got.loc[doc]
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_op2(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(quality_rules.OP2_SQL).df().sort_values("doc_id").reset_index(drop=True)
    got = run(spark, "op2_quality_rules").sort_values("doc_id").reset_index(drop=True)[want.columns]
    assert got.astype(str).equals(want.astype(str))


def test_op3(spark, docs):
    got = run(spark, "op3_ngram_jaccard").set_index("doc_id").loc[docs.doc_id]
    sets = [shingles(t, 4) for t in docs.text.fillna("")]
    assert got.n_shingles.tolist() == [len(s) for s in sets]
    assert got.component_id.tolist() == docs.doc_id.to_numpy()[components(sets, alike(85))].tolist()


def n_grams_by_hand(text: str) -> dict[int, int]:
    """Bucket to count of the 1- to 3-grams of lower-cased letters; what stands between words is one blank. 32-bit arithmetic on plain numbers."""
    symbols, word = [], True
    for c in text.lower():
        if c.isalpha():
            symbols.append(ord(c))
        elif word:
            symbols.append(32)
        word = c.isalpha()
    full = lambda x, k: x * k % 2**32
    one = [full(x, 2654435761) for x in symbols]
    two = [full(a ^ (b >> 7), 2246822519) for a, b in zip(one, one[1:], strict=False)]
    three = [full(a ^ (b >> 5), 3266489917) for a, b in zip(two, one[2:], strict=False)]
    found = {}
    for h in one + two + three:
        found[h >> 20] = found.get(h >> 20, 0) + 1
    return found


def test_op4(spark, docs):
    """Every row by hand: n-grams counted in loops, TF-IDF weights, and the cosine with each centroid of the fitted model."""
    got = run(spark, "op4_language_id").set_index("doc_id")
    model = language_id.fit(spark.read.parquet(f"{SF}/documents.parquet"), ~language_id.held_out())
    centroids, idf = np.asarray(model.centroids, float), np.asarray(model.idf, float)
    assert np.allclose(np.linalg.norm(centroids, axis=1), 1, atol=1e-4)
    assert {lang: model.languages.count(lang) for lang in model.languages} == dict.fromkeys(sorted(set(docs.lang.dropna())), language_id.CLUSTERS)
    for doc, text in zip(docs.doc_id, docs.text, strict=True):
        row = got.loc[doc]
        assert row.held_out == (zlib.crc32(str(doc).encode()) % 4 == 2)
        if not isinstance(text, str) or not any(c.isalpha() for c in text.lower()):
            assert (row.lang_pred, row.score) == ("und", 0)
            continue
        weights = {i: np.log1p(n) * idf[i] for i, n in n_grams_by_hand(text).items()}
        norm = np.sqrt(sum(w * w for w in weights.values()))
        cosines = [sum(w * c[i] for i, w in weights.items()) / norm for c in centroids]
        assert abs(row.score - max(cosines)) < 1e-4 and max(c for c, lang in zip(cosines, model.languages, strict=True) if lang == row.lang_pred) > max(cosines) - 1e-4


def test_op5(spark, docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public.path(token_counts.MODEL))
    got = run(spark, "op5_token_counts").set_index("doc_id")
    for doc, text in zip(docs.doc_id, docs.text.fillna(""), strict=True):
        n, row = len(model.encode(text)), got.loc[doc]
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len(text.encode()), n, n > 4096)


def test_op6(spark, docs):
    """The notices that the tables hold, and nothing in lines without a word of them."""
    kinds = {"Licensed under CC BY-NC 4.0.": "cc-by-nc", "This work is licensed under the GNU General Public License, version 3.": "gpl", "Licensed under the Apache License, Version 2.0.": "apache", "Released under the MIT License.": "mit", "All rights reserved.": "proprietary"}
    got = {(r.doc_id, r.paragraph): r.family for r in run(spark, "op6_license_scans").itertuples() if r.confirmed}
    want = {(doc, n): kinds[line] for doc, text in zip(docs.doc_id, docs.text.fillna(""), strict=True) for n, line in enumerate(text.split("\n")) if line in kinds}
    assert want and got == want


def test_op7(spark, docs):
    got = run(spark, "op7_quality_classifier").set_index("doc_id")
    spark_docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    weights = quality_classifier.fit(spark_docs, labels, ~quality_classifier.held_out())
    codes = quality_classifier.code_memo()
    for doc, text in zip(docs.doc_id, docs.text.fillna(""), strict=True):
        found, n = quality_classifier.features(text.encode(), codes)
        score = quality_classifier.sigmoid(weights[-1] + (quality_classifier.SCALE * float(weights[found].sum()) / n if n else 0.0))
        row = got.loc[doc]
        assert abs(row.score - score) < 1e-6 and row.predicted == int(row.score >= 0.5) and row.held_out == (zlib.crc32(str(doc).encode()) % 3 == 1)


def test_op8(spark):
    vectors = pd.read_parquet(f"{SF}/embeddings.parquet")
    x = np.array(vectors.embedding.tolist(), float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    got = run(spark, "op8_embedding_near_dedup").set_index("vec_id").loc[vectors.vec_id]
    assert got.n_links.tolist() == (near.sum(axis=1) - 1).tolist()
    root = components(list(range(len(x))), lambda a, b: near[a, b])
    assert got.component_id.tolist() == vectors.vec_id.to_numpy()[root].tolist() and (got.kept == (got.index == got.component_id)).all()


def test_op9(spark):
    """These pages have one article of headings and paragraphs: its text, block by block."""
    pages = pd.read_parquet(f"{SF}/pages.parquet")
    got = run(spark, "op9_html_extraction").set_index("page_id")
    for page, html in zip(pages.page_id, pages.html.fillna(""), strict=True):
        article = re.search(r"<article>(.*?)</article>", html, re.S)
        blocks = re.split(r"</?(?:p|h1)\b[^>]*>", article[1]) if article else []
        texts = [" ".join(entities.unescape(re.sub(r"<br\s*/?>", " ", b) if "<" not in re.sub(r"</?(?:b|br|i|a|em)\b[^>]*>", "", b) else b).split()) for b in blocks]
        texts = [" ".join(re.sub(r"</?(?:b|i|a|em)\b[^>]*>", "", t).split()) for t in texts]
        assert got.loc[page].text == "\n".join(t for t in texts if t), page
        assert got.loc[page].n_chars == len(got.loc[page].text)


def pieces_of(docs) -> list[tuple]:
    from tokenizers import Tokenizer

    library, rows = Tokenizer.from_file(public.path(packing.VOCABULARY)), []
    for doc, text in zip(docs.doc_id, docs.text.fillna(""), strict=True):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        rows += [(doc, at // 2048, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for at in range(0, len(ids), 2048)]
    return rows


def holds(got: pd.DataFrame, docs) -> None:
    assert sorted(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(pieces_of(docs))
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.length.sum() <= 2048 and s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and len(s) <= packing.MAX_DOCS
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) * 1.01 + 1


def test_op10(spark, docs):
    holds(run(spark, "op10_best_fit_packing"), docs)


def test_op10_takes_as_few_sequences_as_it_can(spark, tmp_path):
    """Through the registered query: 20,000 empty texts, and texts of log-normal lengths, take no sequence more than their tokens need (one for a group's rest)."""
    rng = np.random.default_rng(10)
    lengths = np.clip(np.exp(rng.normal(4.5, 1.2, 3000)), 1, 2047).astype(int)
    for name, texts in (("empty", [""] * 20_000), ("mixed", ["a " * n for n in lengths])):
        folder = tmp_path / name
        spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{folder}/documents.parquet")
        got = queries.QUERIES["op10_best_fit_packing"](spark, str(folder)).toPandas()
        assert got.length.sum() == sum(len(t) // 2 + 1 for t in texts) and got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 1
        if name == "empty":
            assert got.sequence_id.nunique() == 10


def test_pipeline_from_end_to_end(spark, docs):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    got = corpus_pipeline.run(spark, SF).toPandas()
    letters = language_id.letter_table()
    model = language_id.fit(spark.read.parquet(f"{SF}/documents.parquet"), F.lit(True))
    kept = docs[[not model.predict(t, letters)[2] for t in docs.text]]
    weights = quality_classifier.fit(spark.createDataFrame(kept[["doc_id", "text"]]), spark.read.parquet(f"{SF}/labels.parquet"), F.lit(True))
    codes = quality_classifier.code_memo()

    def good(text: str) -> bool:
        found, n = quality_classifier.features(text.encode(), codes)
        return quality_classifier.sigmoid(weights[-1] + (quality_classifier.SCALE * float(weights[found].sum()) / n if n else 0.0)) >= 0.5

    kept = kept[[good(t or "") for t in kept.text]].sort_values("doc_id")
    root = components([shingles(t, 5) for t in kept.text], alike(80))
    kept = kept[[i == r for i, r in enumerate(root)]]
    assert 0 < len(kept) < len(docs)
    holds(got, kept)


AWKWARD = [
    (1, "the cat sat on the mat and the dog lay by the door", "en", "a", 5), (1, "the cat sat on the mat and the dog lay by the door", "en", "a", 5), (1, "other words of the same number", "en", "a", 5), (2, None, None, None, None), (3, "", "de", "", 0),
    (None, "un deux trois", "fr", "b", 1), (None, None, None, None, None), (4, "word " * 30_000, "en", "c", 2), (5, "123 !!!", "en", "c", 2), (6, "é" * 4000, None, "c", 1),
]


def test_pipeline_stages_on_awkward_rows(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = spark.createDataFrame(AWKWARD, schema).withColumns({c: F.lit(c) for c in ("score", "rejected", "lang_pred", "component_id", "doc", "rank", "node", "n")})
    for docs in (rows, rows.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "best_fit_packing":
                assert out.columns == docs.columns, name
                assert out.exceptAll(docs).isEmpty(), name
            else:
                assert out.select("doc_id", "piece").exceptAll(out.select("doc_id", "piece").distinct()).count() <= 3
    kept = corpus_pipeline.one_of_each_group(spark, rows, SF)
    assert sorted(r["doc_id"] or 0 for r in kept.select("doc_id").collect()) == [0, 0, 1, 2, 3, 4, 5, 6]
