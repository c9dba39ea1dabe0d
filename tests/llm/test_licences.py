"""Licence notices: none lost however many there are, recall on wordings that are not in the training list, wrapped notices, awkward tables."""

import pandas as pd
import pytest
from conftest import SF
from pyspark.sql import functions as F

from framelake.llm import licenses

NOTICES = [("Released under the MIT License.", "mit"), ("Licensed under the Apache License, Version 2.0.", "apache"), ("All rights reserved.", "proprietary")]
HELD_OUT = [
    ("mit", "The sources in this folder come with an MIT license"), ("mit", "Terms: MIT License, no exceptions"), ("apache", "Reuse is allowed as the Apache License 2.0 says"), ("apache", "Code: Apache-2.0"),
    ("gpl", "Our fork stays with the GNU General Public License v3"), ("gpl", "GPLv2 only"), ("lgpl", "Linked parts: GNU Lesser General Public License"), ("lgpl", "LGPL-2.1 for the library"),
    ("agpl", "The server is AGPLv3 like its parent"), ("bsd", "Shipped with a 3-clause BSD license text"), ("bsd", "BSD-2-Clause everywhere"), ("cc-by", "Photos: CC BY 4.0"), ("cc-by-sa", "Share it as CC BY-SA 4.0 says"),
    ("cc-by-nc", "Maps are CC BY-NC 4.0"), ("cc0", "Data sets: CC0"), ("mpl", "Files keep the Mozilla Public License 2.0"), ("epl", "Plugins: Eclipse Public License"), ("isc", "Small tools, ISC license"),
    ("unlicense", "We chose the Unlicense"), ("proprietary", "2021 Example Ltd, all rights reserved worldwide"), ("proprietary", "Internal: proprietary and confidential"), ("mit", "MIT-license"), ("apache", "ASL 2.0"), ("gpl", "GNU GPL, any version"),
]


@pytest.fixture(scope="module")
def plain():
    """Texts of the given table without a line of a licence."""
    texts = pd.read_parquet(f"{SF}/documents.parquet").text.dropna()
    return ["\n".join(line for line in t.split("\n") if not any(w in line.lower() for w in ("licens", "reserved"))) for t in texts]


@pytest.mark.parametrize("share", [0.01, 0.1, 1.0])
def test_no_notice_is_lost(spark, plain, share):
    """Notices in this share of the lines: every one is found, and nothing else."""
    lines = [line for t in plain for line in t.split("\n")][:3000]
    step, rows, want, k = round(1 / share), [], set(), 0
    for doc in range(300):
        own = []
        for i in range(10):
            if (10 * doc + i) % step == 0:
                text, family = NOTICES[k % 3]
                want.add((doc, len(own), family))
                own.append(text)
                k += 1
            elif share < 1:
                own.append(lines[(10 * doc + i) % len(lines)])
        rows.append((doc, "\n".join(own)))
    got = licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = {(r.doc_id, r.paragraph, r.family) for r in got.toPandas().itertuples() if r.confirmed}
    assert got == want


def test_recall_on_other_wordings(spark, plain):
    rows = [(i, f"{plain[i]}\n{line}\n{plain[i + 1]}") for i, (_, line) in enumerate(HELD_OUT)] + [(100 + i, t) for i, t in enumerate(plain)]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).toPandas()
    want = {(i, plain[i].count("\n") + 1, family) for i, (family, _) in enumerate(HELD_OUT)}
    got = {(r.doc_id, r.paragraph, r.family) for r in found.itertuples()}
    assert len(want & got) >= 0.9 * len(want), want - got
    assert len(got - want) <= 0.1 * len(want), got - want


def test_wrapped_notice(spark):
    """A notice over lines of which one has no leading word is one paragraph."""
    text = "first words\nPermission is hereby granted, free of charge, to any person\nto\nobtaining a copy of this software and associated documentation files\nlast words"
    got = licenses.scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).toPandas()
    assert set(got.family) == {"mit"} and got.confirmed.all() and got.paragraph.min() == 1


def test_awkward_tables(spark):
    schema = "doc_id bigint, text string, row string, run string, family string"
    rows = [(1, None, "x", "x", "x"), (2, "", "x", "x", "x"), (None, "MIT License", "x", "x", "x"), (3, "MIT License", "x", "x", "x"), (3, "MIT License", "x", "x", "x"), (4, "word " * 50_000 + "\nall rights reserved", "x", "x", "x"), (5, "mit dem Hund", "x", "x", "x")]
    got = licenses.scan(spark.createDataFrame(rows, schema)).toPandas()
    assert sorted((-1 if pd.isna(r.doc_id) else int(r.doc_id), r.paragraph, r.family) for r in got.itertuples()) == [(-1, 0, "mit"), (3, 0, "mit"), (3, 0, "mit"), (4, 1, "proprietary")]
    assert licenses.scan(spark.createDataFrame(rows[:2], schema)).count() == licenses.scan(spark.createDataFrame([], schema)).count() == 0


def test_scores_by_hand(spark, plain):
    """The engine's likelihoods are the model's, n-gram by n-gram."""
    model = licenses.train(sorted(line for t in plain for line in t.split("\n"))[:2000])
    rows = [(i, line) for i, (_, line) in enumerate(HELD_OUT)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string"), model=model).withColumn("n", F.lit(1)).toPandas().itertuples()}
    for doc, line in rows:
        p = model.likelihoods(licenses.n_grams(line))
        family = model.families[int(p.argmax())]
        if family == licenses.UNKNOWN or p.max() < licenses.LEAST - 1e-6:
            assert doc not in got
        else:
            assert got[doc].family == family and abs(got[doc].likelihood - p.max()) < 1e-5
