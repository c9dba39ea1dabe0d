"""Operator 6 [native]: licence notices by a trained paragraph classifier.

A paragraph is a line, or a run of lines near each other that hold words of licences (a wrapped notice; one line between two of them may hold none). It is a sparse vector of word uni- and
bigrams over the vocabulary of the licence templates, each of the n that it holds weighing 1 / sqrt(n). A multinomial logistic
regression over the families and `unknown` is trained here on the templates and names of licences, against a bounded sample of ordinary lines.
A temperature and the bias of `unknown` are fitted on a third of these rows that the regression has not seen, so that likelihoods are
calibrated. A family is reported where its likelihood passes the threshold; a comparison with the family's templates (the largest share of a template's
n-grams that the paragraph holds) confirms it.

Scoring is built-in functions only. No paragraph can be a licence without an n-gram that speaks for a family, so only lines that hold the rarest
word of such an n-gram, learned as the weights are, go further; the others cannot pass. Those words and the weights are of fixed size. How often a word
stands in the corpus decides only which word of an n-gram leads to it, never whether it counts.

Returns a row for each licence paragraph: doc_id, paragraph (number of its first line, from 0), n_lines, family, likelihood, similarity,
confirmed. A run of lines is reported in place of its lines where none of these is confirmed. Documents without a notice, null and empty texts give no row; repeated rows
give a row each; equal likelihoods go to the first family in alphabetical order. N-grams do not span the lines of a run. Extra columns are dropped.
"""

from __future__ import annotations

import json
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

# Names of public licences, by family.
NAMES = {
    "agpl": ["gnu affero general public license", "affero general public license version 3", "gnu agpl", "agpl", "agplv3", "agpl v3", "agpl 3.0", "agpl-3.0", "agpl-3.0-or-later"],
    "apache": ["apache license version 2.0", "apache license 2.0", "apache 2.0 license", "apache 2.0", "apache-2.0", "apache license", "asl 2.0"],
    "bsd": ["bsd license", "2-clause bsd license", "3-clause bsd license", "new bsd license", "simplified bsd license", "bsd 3-clause", "bsd-2-clause", "bsd-3-clause"],
    "cc-by": ["creative commons attribution 4.0 international license", "creative commons attribution license", "cc by 4.0", "cc-by-4.0", "cc-by 4.0", "cc by", "cc-by"],
    "cc-by-nc": ["creative commons attribution-noncommercial 4.0 international license", "creative commons attribution noncommercial license", "cc by-nc 4.0", "cc-by-nc-4.0", "cc-by-nc 4.0", "cc by-nc", "cc-by-nc"],
    "cc-by-nc-sa": ["creative commons attribution-noncommercial-sharealike 4.0 international license", "cc by-nc-sa 4.0", "cc-by-nc-sa-4.0", "cc-by-nc-sa 4.0", "cc by-nc-sa", "cc-by-nc-sa"],
    "cc-by-nd": ["creative commons attribution-noderivatives 4.0 international license", "cc by-nd 4.0", "cc-by-nd-4.0", "cc-by-nd 4.0", "cc by-nd", "cc-by-nd"],
    "cc-by-sa": ["creative commons attribution-sharealike 4.0 international license", "creative commons attribution sharealike license", "cc by-sa 4.0", "cc-by-sa-4.0", "cc-by-sa 4.0", "cc by-sa", "cc-by-sa"],
    "cc0": ["cc0 1.0 universal", "cc0", "cc0 1.0", "cc0-1.0", "creative commons zero", "creative commons cc0 license"],
    "epl": ["eclipse public license", "eclipse public license version 2.0", "eclipse public license 2.0", "epl 2.0", "epl-2.0", "epl v1.0"],
    "gpl": ["gnu general public license", "gnu general public license version 3", "gnu general public license version 2", "gnu gpl", "gpl", "gplv2", "gplv3", "gpl v3", "gpl version 2", "gpl-2.0", "gpl-3.0", "gpl-3.0-or-later", "gpl 3.0"],
    "isc": ["isc license", "isc licence"],
    "lgpl": ["gnu lesser general public license", "gnu lesser general public license version 2.1", "gnu lgpl", "lgpl", "lgpl 2.1", "lgplv3", "lgpl v3", "lgpl-2.1", "lgpl-3.0"],
    "mit": ["mit license", "mit licence", "mit-license", "expat license"],
    "mpl": ["mozilla public license", "mozilla public license version 2.0", "mozilla public license 2.0", "mpl 2.0", "mpl-2.0", "mpl v2.0"],
    "unlicense": ["unlicense", "the unlicense"],
}
# Usual wordings of public licence notices, by family.
TEMPLATES = {
    "agpl": ["you should have received a copy of the gnu affero general public license along with this program"],
    "apache": [
        "licensed under the apache license version 2.0 the license",
        "you may not use this file except in compliance with the license",
        "you may obtain a copy of the license at http www.apache.org licenses license-2.0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
        "without warranties or conditions of any kind either express or implied",
        "see the license for the specific language governing permissions and limitations under the license",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties are disclaimed",
    ],
    "cc-by": ["this work is licensed under a creative commons attribution 4.0 international license"],
    "cc-by-nc": ["this work is licensed under a creative commons attribution-noncommercial 4.0 international license"],
    "cc-by-sa": ["this work is licensed under a creative commons attribution-sharealike 4.0 international license"],
    "cc0": [
        "released into the public domain under cc0 1.0 universal",
        "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    ],
    "epl": ["this program and the accompanying materials are made available under the terms of the eclipse public license"],
    "gpl": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "either version 3 of the license or at your option any later version",
        "this program is distributed in the hope that it will be useful but without any warranty",
        "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        "you should have received a copy of the gnu general public license along with this program",
    ],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "lgpl": [
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license",
        "you should have received a copy of the gnu lesser general public license along with this library",
    ],
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability",
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability",
    ],
    "mpl": ["this source code form is subject to the terms of the mozilla public license", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0"],
    "proprietary": [
        "all rights reserved", "copyright all rights reserved", "copyright by the author all rights reserved", "the publisher reserves all rights", "no part of this work may be reproduced without prior written permission of the publisher",
        "proprietary and confidential", "unauthorized copying of this file via any medium is strictly prohibited",
    ],
    "unlicense": [
        "this is free and unencumbered software released into the public domain",
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary",
    ],
}
CARRIERS = (
    "{}", "licensed under {}", "licensed under the {}", "released under the {}", "released under {}", "distributed under {}", "this work is licensed under the {}", "this project is licensed under the terms of the {}",
    "available under the {}", "the code is under {}", "see the license file for the {}", "spdx-license-identifier {}", "license {}", "this file is part of a library under the {}", "published under {}",
    "governed by the {}", "covered by the {}", "subject to the {}", "provided under the terms of {}", "may be used under the {}", "free under the {}", "{} or later", "{} copyright c", "{} see license.txt",
)
# Ordinary sentences with words of licences.
OTHER = (
    "the driver showed a license to the officer", "permission to park is given at the gate", "this version of the story is free of charge", "he may obtain a copy of the book at the library",
    "the software is distributed to schools", "the public library is open", "use this file to open the door", "conditions are met in the north", "a work of art in the public square",
    "copyright is a right", "the terms of the contract", "the general gave an order", "version 2.0 is out", "at the time of the event all seats were reserved", "the mit campus is large",
    "the apache are a people of the southwest", "the apache helicopter was released", "mozilla released a new version of the browser", "the eclipse was seen under a clear sky", "creative people share a common office",
    "he was licensed to sell wine", "a licence to fish in the river", "the new license plate", "the gnu is an antelope of the plains", "the common good of all", "under the bridge", "released under bail",
    "warranty claims must be made within a year", "no warranty is given on used cars", "the commons voted on the bill", "the house of commons", "public domain names are sold", "rights and duties of all citizens",
    "he reserved a table for two", "attribution of the painting is not clear", "software for any purpose", "the source of the river", "a person obtaining a visa", "she lost her library card and a copy of the form",
    "distributed in the hope of a reply", "lieber mit einem freund", "das kind mit dem hund", "zero degrees", "affero", "the expat community", "bsd", "isc", "mit", "apache", "license", "copyright",
    "the license", "see the license", "a license for the library", "license and registration", "the license holder", "licensed software", "copy of the license", "the terms of the license are set by the owner", "the license to use the land",
)
# Function words of English; n-grams of these alone are no features.
STOP = frozenset(
    "a above after all along also an and any are as at be been but by can do each either even for from had has have he her here his how i if in into is it its made may more most must my neither no nor not of on one or other"
    " our out shall she should so some such than that the their them then there these they this those to under up use used was we were what when where which who will with would you your".split()
)
WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
UNKNOWN = "unknown"
SAMPLE_DOCUMENTS, SAMPLE_LINES, LINE_CHARS = 1500, 3, 2000  # ordinary lines that take part in training: documents, lines of each, characters of a line
GAP = 2  # hit lines this far apart belong to one run: a wrapped notice may have a line without a leading word
LEAST, SIMILAR = 0.5, 0.5


def words_of(line: str) -> list[str]:
    return re.findall(WORD, line.lower())


def n_grams(line: str) -> set[str]:
    words = words_of(line)
    return set(words) | {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def phrases() -> dict[str, list[str]]:
    """Names and templates of each family."""
    return {f: [*NAMES.get(f, []), *TEMPLATES.get(f, [])] for f in sorted({*NAMES, *TEMPLATES})}


def similarity(grams: set[str], family: str) -> float:
    """Largest share of the n-grams of one of the family's phrases that `grams` holds."""
    return max(len(grams & own) / len(own) for own in map(n_grams, phrases()[family]))


def positives() -> list[tuple[str, str]]:
    """(family, text): names in sentences; templates, whole and in windows."""
    found = [(family, carrier.format(name)) for family, names in NAMES.items() for name in names for carrier in CARRIERS]
    for family, sentences in TEMPLATES.items():
        for t in sentences:
            words = t.split()
            found += [(family, pad + t) for pad in ("", "the code here is ", "note that this page was ")]
            found += [(family, " ".join(words[at : at + n])) for n in (7, 10) for at in range(0, max(0, len(words) - n + 1), 3)]
    return sorted(set(found))


class Model:
    """Weights of the n-grams by family (the last is `unknown`), biases, and the words that lead to lines."""

    def __init__(self, families: list[str], weights: dict[str, np.ndarray], bias: np.ndarray, line_share: dict[str, float]):
        self.families, self.weights, self.bias = families, weights, bias
        speaks = [g for g, w in weights.items() if (w[:-1] - w[-1]).max() > 0]
        self.leads = sorted({min(g.split(), key=lambda w: (w in STOP, line_share.get(w, 0.0), w)) for g in speaks})

    def likelihoods(self, grams: set[str]) -> np.ndarray:
        own = [self.weights[g] for g in sorted(grams) if g in self.weights]
        z = self.bias + (np.sum(own, axis=0) / np.sqrt(len(own)) if own else 0)
        p = np.exp(z - z.max())
        return p / p.sum()


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def train(ordinary: list[str], rounds: int = 200, rate: float = 4.0, decay: float = 3e-5) -> Model:
    """`ordinary` lines that are half a template or more teach nothing: they may be notices."""
    families = [*phrases(), UNKNOWN]
    lines = [n_grams(line) for line in ordinary]
    vocabulary = sorted(g for g in set().union(*(n_grams(t) for _, t in positives())) if not STOP.issuperset(g.split()))
    known = set(vocabulary)
    lines = [grams for grams in lines if not grams & known or max(similarity(grams, f) for f in families[:-1]) < SIMILAR]
    line_share: dict[str, float] = {}
    for grams in lines:
        for g in grams:
            line_share[g] = line_share.get(g, 0.0) + 1 / len(lines)
    short = {" ".join(w[i : i + n]) for ts in TEMPLATES.values() for t in ts for w in [t.split()] if len(w) > 6 for n in (1, 2) for i in range(len(w))} - {t for known_ in phrases().values() for t in known_}
    rows = [(families.index(f), n_grams(t) & known) for f, t in positives()] + [(len(families) - 1, grams & known) for grams in [*lines, *map(n_grams, OTHER), *map(n_grams, sorted(short))]]
    rows, told = [(k, tuple(sorted(grams))) for k, grams in rows], {tuple(sorted(n_grams(t) & known)) for t in OTHER}
    kinds = sorted(set(rows))  # thousands of lines without any n-gram are one case
    y = np.array([k for k, _ in kinds])
    share = 1 / np.maximum(np.bincount(y, minlength=len(families)), 1)
    share[-1] *= len(families) - 1  # licences and other lines weigh the same
    heavy = np.array([share[k] * (4 if grams in told else 1) for k, grams in kinds], np.float32)
    number = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(kinds), len(vocabulary) + 1), np.float32)
    x[:, -1] = 1
    for i, (_, grams) in enumerate(kinds):
        x[i, [number[g] for g in grams]] = 1 / np.sqrt(max(1, len(grams)))
    held = np.random.default_rng(6).random(len(kinds)) < 1 / 3
    own, weight, target = x[~held], heavy[~held] / heavy[~held].sum(), np.eye(len(families), dtype=np.float32)[y[~held]]
    w = ahead = np.zeros((x.shape[1], len(families)), np.float32)
    for turn in range(rounds):  # gradient descent with Nesterov's momentum
        after = ahead - rate * (own.T @ ((softmax(own @ ahead) - target) * weight[:, None]) + decay * ahead)
        w, ahead = after, after + turn / (turn + 3) * (after - w)

    def loss(temperature: float, shift: float) -> float:
        z = x[held] @ w / temperature
        z[:, -1] += shift
        return float(-(np.log(softmax(z)[np.arange(len(z)), y[held]] + 1e-12) * heavy[held]).sum())

    _, temperature, shift = min((loss(t, b), t, b) for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0) for b in (-1.0, -0.5, 0.0, 0.5, 1.0, 1.5, 2.0))
    w = (w / temperature).astype(np.float64).round(6)
    w[-1, -1] += shift
    # Without any n-gram a line is unknown: then no line that misses all the leading words can be a licence.
    w[-1, -1] = max(w[-1, -1], w[-1, :-1].max() + 1e-6)
    return Model(families, {g: w[i] for g, i in number.items()}, w[-1], line_share)


def local_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def ordinary_lines(documents: DataFrame) -> list[str]:
    """A bounded sample of lines: documents by a hash of the row, of each some lines, of a long one a piece."""
    total, hash_ = documents.count(), F.xxhash64("doc_id", "text", F.lit(6))
    share = min(1.0, 4 * SAMPLE_DOCUMENTS / max(total, 1))
    lines = F.expr(f"slice(shuffled, 1, {SAMPLE_LINES})")
    start = F.pmod(hash_, F.greatest(F.lit(1), F.length("text") - SAMPLE_LINES * LINE_CHARS)).cast("int") + 1
    first = documents.where("text is not null").where(F.pmod(hash_, F.lit(1_000_000)) < share * 1_000_000).select(hash_.alias("h"), F.col("text").substr(start, F.lit(2 * SAMPLE_LINES * LINE_CHARS)).alias("piece"))
    first = first.orderBy("h", "piece").limit(SAMPLE_DOCUMENTS).withColumn("shuffled", F.expr("array_sort(transform(split(piece, '\n'), x -> struct(xxhash64(x) as h, x as line)))"))
    return sorted(r["line"][:LINE_CHARS] for r in first.select(F.explode(lines).alias("l")).select("l.line").collect())


def fit(documents: DataFrame) -> Model:
    return train(ordinary_lines(documents))


def words_in(text: str) -> F.Column:
    return F.expr(f"regexp_extract_all(lower({text}), '({WORD})', 1)")


def pieces_of(documents: DataFrame, model: Model) -> DataFrame:
    """(row, doc_id, first, last, grams, words): lines that hold a leading word, and runs of such lines."""
    rows = documents.where("text is not null").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    lines = rows.select("row", "doc_id", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    words = lines.select("row", "doc_id", "line", words_in("content").alias("words"))
    hit = words.where(F.exists("words", lambda w: w.isin(model.leads)))  # a set of literals, of a size fixed by the templates
    here = Window.partitionBy("row").orderBy("line")
    starts = F.when(F.col("line") - F.lag("line").over(here) <= GAP, 0).otherwise(1)
    grams = F.expr("array_distinct(concat(words, zip_with(slice(words, 1, greatest(size(words) - 1, 0)), slice(words, 2, greatest(size(words) - 1, 0)), (a, b) -> concat(a, ' ', b))))")
    held = hit.withColumns({"starts": starts, "grams": grams}).withColumn("run", F.sum("starts").over(here))
    single = held.select("row", "doc_id", "run", F.col("line").alias("first"), F.col("line").alias("last"), "grams")
    several = held.groupBy("row", "doc_id", "run").agg(F.min("line").alias("first"), F.max("line").alias("last"), F.array_distinct(F.flatten(F.collect_list("grams"))).alias("grams")).where("last > first")
    return single.unionByName(several)


def scan(documents: DataFrame, least: float = LEAST, similar: float = SIMILAR, model: Model | None = None) -> DataFrame:
    """A row for each licence paragraph of (doc_id, text)."""
    spark, model = documents.sparkSession, model or fit(documents)
    k = len(model.families)
    weights = F.broadcast(local_table(spark, [{"gram": g, "w": w.tolist()} for g, w in model.weights.items()], "gram: string, w: array<double>"))  # size fixed by the templates
    pieces = pieces_of(documents, model)
    key = ["row", "doc_id", "run", "first", "last"]
    sums = pieces.select(*key, F.explode("grams").alias("gram")).join(weights, "gram").groupBy(*key).agg(F.count("*").alias("n"), F.collect_list("gram").alias("grams"), *[F.sum(F.col("w")[i]).alias(f"s{i}") for i in range(k)])
    logits = sums.select(*key, "grams", F.array(*[F.col(f"s{i}") / F.sqrt("n") + F.lit(float(model.bias[i])) for i in range(k)]).alias("z"))
    soft = logits.withColumn("top", F.array_max("z")).withColumn("likelihood", 1 / F.expr("aggregate(z, 0e0, (a, x) -> a + exp(x - top))"))
    named = soft.withColumn("family", F.array(*map(F.lit, model.families))[F.expr("cast(array_position(z, top) - 1 as int)")]).where((F.col("family") != UNKNOWN) & (F.col("likelihood") >= least))
    own = [{"family": f, "ts": [{"grams": sorted(n_grams(t) & model.weights.keys())} for t in ts]} for f, ts in phrases().items()]
    known = F.broadcast(local_table(spark, own, "family: string, ts: array<struct<grams: array<string>>>"))
    share = F.expr("round(array_max(transform(ts, t -> size(array_intersect(t.grams, grams)) / cast(greatest(1, size(t.grams)) as double))), 6)")
    found = named.join(known, "family").withColumn("similarity", share)
    # Of a run either lines or the run itself: the lines where one of them is confirmed.
    of_run, alone = Window.partitionBy("row", "run"), F.col("last") == F.col("first")
    found = found.withColumn("confirmed", F.col("similarity") >= similar)
    found = found.withColumns({"told": F.max(alone & F.col("confirmed")).over(of_run), "joined": F.max(~alone).over(of_run)})
    found = found.where(F.when(alone, F.col("told") | ~F.col("joined")).otherwise(~F.col("told")))
    return found.select("doc_id", F.col("first").alias("paragraph"), (F.col("last") - F.col("first") + 1).alias("n_lines"), "family", F.round("likelihood", 6).alias("likelihood"), "similarity", "confirmed")


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
