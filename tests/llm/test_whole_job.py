"""Cases in which an operator once did less than its whole job."""

import base64
import random
from pathlib import Path

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_llm import components

from framelake.llm import byte_bpe, html_text, language_id, licenses, metric_join, ngram_jaccard, packing, quality_classifier, quality_rules


def test_pipeline_near_duplicates(spark):
    import corpus_pipeline

    rng = random.Random(7)
    texts = []
    for _ in range(25):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 200))]
        cut = base[: int(len(base) * rng.uniform(0.78, 0.87))]
        appended = base + [f"w{rng.randrange(5000)}" for _ in range(int(len(base) * rng.uniform(0.17, 0.26)))]
        changed = [f"x{rng.randrange(5000)}" if i % 47 == 20 else w for i, w in enumerate(base)]
        texts += [" ".join(words) for words in (base, cut, appended, changed)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.one_of_each_group(spark, docs, "").toPandas()

    def linked(size, percent):
        sets = [{tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} for w in (t.lower().split() for t in texts)]
        return set(components(sets, lambda a, b: 100 * len(a & b) >= percent * len(a | b)))

    assert set(kept.doc_id) == linked(5, 80) < linked(4, 85)


def test_html_copied_pages(spark):
    rich = "<div class=body><h1>T{0}</h1><ul><li>one {0}</li><li>two {0}</li></ul><table><tr><td>cell {0}</td></tr></table><p>text {0}</p></div>"
    page = "<body><article>" + rich + "<div>Written for the site</div></article><div>Imprint</div>"
    plain = "<body>" + rich + "<div>Imprint</div>"
    rows = [(i, f"http://a.org/{i}", page.format(max(i, 40))) for i in range(46)] + [(100 + i, f"http://b.org/{i}", plain.format(max(i, 40))) for i in range(46)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).toPandas()
    want = {i + at: "T{0}\none {0}\ntwo {0}\ncell {0}\ntext {0}".format(max(i, 40)) for i in range(46) for at in (0, 100)}
    assert dict(zip(got.page_id, got.text, strict=True)) == want


@pytest.mark.parametrize("per_cell", [2500, 10])
def test_vectors_of_equal_direction_and_other_dimensions(spark, monkeypatch, per_cell):
    monkeypatch.setattr(metric_join, "PER_CELL", per_cell)
    rng = np.random.default_rng(4)
    vectors = []
    for size, n in ((8, 60), (5, 40), (3, 2)):
        centers = rng.normal(size=(6, size))
        vectors += [centers[i % 6] + rng.normal(size=size) * 0.15 for i in range(n)]
    vectors += [v * factor for v in vectors[:110:9] for factor in (1.0, 2.0, 0.25)]
    vectors += [np.array([1.0, 0.0, 1e-3]), np.array([1.0, -0.0, 1e-3]), np.array([3.0, -0.0, 0.0, 1.0]), np.array([1.0, 0.0]), np.array([1.0, -0.0])]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
    got = metric_join.near_duplicates(df).toPandas().sort_values("vec_id")
    near = lambda a, b: len(a) == len(b) and float(a @ b) >= 0.95 * np.sqrt((a @ a) * (b @ b))
    assert got.vec_id.tolist() == list(range(len(vectors)))
    assert got.component_id.tolist() == components(vectors, near)
    assert got.n_links.tolist() == [sum(near(a, b) for j, b in enumerate(vectors) if j != i) for i, a in enumerate(vectors)]


POLISH = """Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni
postępować wobec innych w duchu braterstwa. Każdy człowiek posiada wszystkie prawa i wolności zawarte w niniejszej deklaracji."""
FINNISH = """Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on
toimittava toisiaan kohtaan veljeyden hengessä. Jokainen on oikeutettu kaikkiin tässä julistuksessa esitettyihin oikeuksiin."""


def test_unknown_languages_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs, ~language_id.held_out())
    rng = random.Random(3)
    strange = [POLISH, FINNISH, base64.b64encode(rng.randbytes(600)).decode(), "".join(rng.choices("abcdefghijklmnopqrstuvwxyz    ", k=900)), Path(language_id.__file__).read_text()[2000:4000]]
    strange = spark.createDataFrame([(t[:n],) for t in strange for n in (100, 200, 2000)], "text string")
    assert {r["rejected"] for r in language_id.identify(strange, model).collect()} == {True}
    clean = docs.where(language_id.held_out())
    for text, least in ((F.col("text"), 0.97), (F.substring("text", 1, 60), 0.97), (F.substring("text", 1, 20), 0.95)):
        kept = language_id.identify(clean.select(text.alias("text")), model).where("not rejected").count()
        assert kept >= least * clean.count()


def test_doc_ids_with_several_texts(spark):
    rng = random.Random(1)
    text = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    t, u, v = text(80), text(80), text(80)
    rows = [(1, t), (2, u), (2, f"{t} more"), (3, f"{u} more"), (5, v), (6, v), (6, f"{u} less"), (7, ""), (7, f"{v} x"), (8, None), (9, text(80)), (9, text(80)), (None, t)]
    got = ngram_jaccard.join_components(spark.createDataFrame(rows, "doc_id bigint, text string"), 4, 85).toPandas()
    assert {(r.doc_id, r.component_id) for r in got.itertuples() if r.n_shingles and r.doc_id == r.doc_id} == {(i, 1) for i in (1, 2, 3, 5, 6, 7)} | {(9, 9)}
    assert set(got[got.n_shingles == 0].component_id) == {7, 8} and got.component_id.isna().sum() == 1 and len(got) == len(rows)


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    """A passage in all documents, of lengths that fit only in part: every linked pair meets."""
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 6)
    monkeypatch.setattr(ngram_jaccard, "LOCAL", 1)
    monkeypatch.setattr(ngram_jaccard, "FREQUENT", 10)
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(40)]
    texts = [" ".join(passage + [f"t{rng.randrange(30 if i % 3 else 10**6)}" for _ in range(rng.randrange(0, 40))]) for i in range(150)]
    got = ngram_jaccard.join_components(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), 4, 85).toPandas().sort_values("doc_id")
    sets = [{tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} for w in (t.split() for t in texts)]
    assert got.component_id.tolist() == components(sets, lambda a, b: 100 * len(a & b) >= 85 * len(a | b))


def test_windows_of_equal_hash(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefg") * rng.randrange(1, 3) for _ in range(rng.randrange(3, 60))) for _ in range(80)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, source string")
    for hashed in ("xxhash64({0}, {1}, {2})", "cast(length({0}) + length({1}) + length({2}) as bigint) * 65536"):
        got = {r["doc_id"]: r["n_repeat_words"] for r in quality_rules.measure(docs, hashed).collect()}
        for i, t in enumerate(texts):
            w = t.split()
            seen = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
            assert got[i] == len({k + j for k, x in enumerate(seen) if seen.count(x) > 1 for j in range(3)})


def test_parts_of_an_article(spark):
    page = """<body><div class="social">share</div><article><p>one</p><figure><img src=x><figcaption>caption</figcaption></figure><p>x is <math><mi>x</mi><mo>+</mo><mn>1</mn></math> <button>press</button></p>
<div class="related work">two</div><div class="alert">three</div><div class="comments">no</div><div class="newsletter-box">no</div><aside>no</aside></article><figcaption>no</figcaption></body>"""
    got = html_text.extract(spark.createDataFrame([(1, "http://a.org", page)], "page_id bigint, url string, html string")).first()
    assert got["text"] == "one\ncaption\nx is x+1 press\ntwo\nthree"


def test_blocks_of_words(spark, monkeypatch):
    import public_tokenizers as public
    import tiktoken

    monkeypatch.setattr(byte_bpe, "BLOCK_CHARS", 300)
    monkeypatch.setattr(byte_bpe, "BLOCK_DOCS", 7)
    rng = random.Random(2)
    texts = ["".join(rng.choice(["the ", "cat", " é", "日本", "\n\n ", "don't ", "12", " x", "²"]) for _ in range(rng.randrange(40))) for _ in range(90)] + [None, "", "日 \x85a"] * 6
    path = public.path(byte_bpe.RANKS)
    codec = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in byte_bpe.decode(byte_bpe.encode(docs, path), path).collect()}
    for i, t in enumerate(texts):
        ids = codec.encode_ordinary(t or "")
        assert bytes(got[i]["ids"]) == np.array(ids, "<u4").tobytes() and got[i]["n_tokens"] == len(ids) and bytes(got[i]["decoded"]) == (t or "").encode()


def test_ids_above_16_bits(spark, tmp_path):
    pairs = sorted({bytes([a, b]) for a in range(97, 123) for b in range(97, 123)})
    ranks = [bytes([i]) for i in range(256)] + pairs
    path = str(tmp_path / "wide.tiktoken")
    Path(path).write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % (i + 70_000 * (len(t) > 1)) for i, t in enumerate(ranks)))
    docs = spark.createDataFrame([(1, "abcd ef"), (2, "")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in byte_bpe.decode(byte_bpe.encode(docs, path), path).collect()}
    ids = np.frombuffer(bytes(got[1]["ids"]), "<u4")
    assert max(ids) > 70_000 and got[1]["n_tokens"] == len(ids) and bytes(got[1]["decoded"]) == b"abcd ef" and got[2]["n_tokens"] == 0


def test_best_fit_takes_the_least_norm():
    rng = np.random.default_rng(8)
    for trial in range(20):
        lengths, limits, w = rng.integers(1, 60, 120), (100, int(rng.integers(2, 9)), int(rng.integers(3600, 9000))), (1.0, 0.3, 0.2)
        bins, offsets = packing.best_fit(lengths, *limits, w)
        open_: list[list[int]] = []
        for i in np.argsort(-lengths, kind="stable"):
            best = None
            for k, held in enumerate(open_):
                own = [*held, int(lengths[i])]
                left = limits[0] - sum(own), limits[1] - len(own), limits[2] - sum(x * x for x in own)
                if min(left) >= 0 and (best is None or (norm := sum((a * b / c) ** 2 for a, b, c in zip(left, w, limits, strict=True))) < best[0] - 1e-15):
                    best = sum((a * b / c) ** 2 for a, b, c in zip(left, w, limits, strict=True)), k
            k = len(open_) if best is None else best[1]
            if best is None:
                open_.append([])
            assert bins[i] == k and offsets[i] == sum(open_[k])
            open_[k].append(int(lengths[i]))


def test_equal_rows_are_packed_in_several_groups(spark):
    rows = spark.createDataFrame([(1, 0, 0, 30, 5)] * 400, packing.PIECES).coalesce(1)
    got = packing.pack(rows, 100, max_docs=3, max_cost=2000, group=50).toPandas()
    assert len(got) == 400 and len(set(got.sequence_id.to_numpy() >> 32)) > 4
    assert got.groupby("sequence_id").size().max() == 2


NOTICES = [
    ("Distributed under Apache 2.0", "apache"), ("CC-BY-SA 4.0", "cc-by-sa"), ("GNU LGPL 2.1", "lgpl"), ("AGPLv3", "agpl"), ("MPL 2.0", "mpl"), ("Released under the MIT License.", "mit"), ("All rights reserved.", "proprietary"),
    ("SPDX-License-Identifier: BSD-3-Clause", "bsd"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
    ("the software is provided as is, without warranty of any\nkind, express or implied, including but not limited to the\nwarranties of merchantability", "mit"),
    ("To the extent possible under law, the author has waived all rights to this work", "cc0"), ("Redistribution and use in source and binary forms, with or\nwithout modification, are permitted provided that", "bsd"),
]


def test_licence_notices(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = licenses.fit(docs)
    plain = ["He went to the general store under the bridge.", "Das kind ging mit dem hund.", "The public library is free for all.", "", None, "license", "word " * 20_000, "the mit campus and the apache helicopter"]
    rows = [(i, f"Some words first\n\n{t}\n\nand then more of them") for i, (t, _) in enumerate(NOTICES)] + [(100 + i, t) for i, t in enumerate(plain)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("row", F.lit("x")), model=model).toPandas()
    found = {}
    for r in got.sort_values("likelihood").itertuples():
        found[r.doc_id] = r.family
    missed = {t: found.get(i) for i, (t, family) in enumerate(NOTICES) if found.get(i) != family}
    assert not missed and not [d for d in found if d >= 100]
    assert got.confirmed.mean() > 0.8


def test_licence_scores_by_hand(spark):
    """Every line that holds a leading word, and every run of such lines, scored without Spark."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = licenses.fit(docs)
    got = {(r["doc_id"], r["paragraph"], r["n_lines"]): (r["family"], r["confirmed"], r["likelihood"]) for r in licenses.scan(docs, model=model).collect()}
    want = {}

    phrases = {f: [licenses.n_grams(t) & model.weights.keys() for t in ts] for f, ts in licenses.phrases().items()}

    def judge(grams):
        p = model.likelihoods(grams)
        k = int(p.argmax())
        if k == len(p) - 1 or p[k] < licenses.LEAST:
            return None
        alike = max(len(grams & own) / max(1, len(own)) for own in phrases[model.families[k]])
        return model.families[k], alike >= licenses.SIMILAR, float(p[k])

    for doc, text in docs.toPandas().itertuples(index=False):
        run = []
        for n, line in enumerate([*(text or "").split("\n"), ""]):
            if set(licenses.words_of(line)) & set(model.leads):
                run.append((n, licenses.n_grams(line)))
                continue
            lines = {(doc, at, 1): found for at, grams in run if (found := judge(grams))}
            whole = judge(set().union(*(g for _, g in run))) if len(run) > 1 else None
            want |= {(doc, run[0][0], len(run)): whole} if whole and not any(f[1] for f in lines.values()) else lines
            run = []
    assert got.keys() == want.keys() and got
    assert all(got[k][:2] == want[k][:2] and abs(got[k][2] - want[k][2]) < 1e-5 for k in got)


def test_quality_scores_by_hand(spark):
    """Scores from plain integers, word by word."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    weights = quality_classifier.fit(docs, labels, F.lit(True))
    got = {r["doc_id"]: r["score"] for r in quality_classifier.score(docs.select("doc_id", "text"), weights).collect()}
    k1, k2, whole, drop = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 1 << 64, 64 - quality_classifier.BITS
    for doc, text in docs.select("doc_id", "text").limit(60).toPandas().itertuples(index=False):
        codes = [quality_classifier.word_codes(w) for w in text.encode().split()]
        total = 0.0
        for i, (raw, shape) in enumerate(codes):
            total += weights[(raw * k1 % whole) >> drop] + weights[(shape * k2 % whole) >> drop]
            if i + 1 < len(codes):
                raw2, shape2 = codes[i + 1]
                two = (shape * k1 % whole) ^ shape2
                total += weights[(((raw * k2 % whole) ^ raw2) * k1 % whole) >> drop] + weights[(two * k2 % whole) >> drop] + (weights[0] if raw == raw2 else 0.0)
                if i + 2 < len(codes):
                    total += weights[(((two * k1 % whole) ^ codes[i + 2][1]) * k2 % whole) >> drop]
        z = weights[-1] + (quality_classifier.SCALE * total / len(codes) if codes else 0.0)
        assert abs(got[doc] - 1 / (1 + np.exp(-z))) < 1e-6


def test_no_labelled_text_gives_the_share(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(5, 1), (6, 1), (7, 1), (8, 0)], "doc_id bigint, quality int")
    weights = quality_classifier.fit(docs, labels, F.lit(True))
    assert quality_classifier.score(docs, weights).first()["score"] == pytest.approx(0.75)


def test_n_grams_across_chunks(monkeypatch):
    letters = language_id.letter_table()
    text = "Straße, 12 élan!  ΣΑΣ b c\n\n" * 30 + "1234 " * 20 + "日本"
    whole = language_id.n_gram_counts(text, letters)
    for size in (1, 2, 3, 7, 64):
        monkeypatch.setattr(language_id, "CHUNK", size)
        assert (language_id.n_gram_counts(text, letters) == whole).all()


def test_languages_of_long_and_equal_texts(spark):
    rows = [(1, "ab cd ef " * 4000, "xx")] * 5 + [(i, "schön und gut " * 3, "de") for i in range(5)] + [(i, "le chat est là " * 3, "fr") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.fit(docs, F.lit(True))
    assert set(model.languages) == {"xx", "de", "fr"}
    assert max(len(t) for _, t in language_id.sample(docs, F.lit(True))) <= language_id.SAMPLE_CHARS
