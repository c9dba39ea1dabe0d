"""op8 on vectors without neighbourhoods: written tables stay in proportion to the input, and each linked pair counts once whichever block finds it."""

import subprocess

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.llm import common, metric_join


def disk(spark) -> int:
    return int(subprocess.run(["du", "-sb", common.shared_dir(spark).removeprefix("file:")], capture_output=True, check=True).stdout.split()[0])


@pytest.mark.parametrize("kind", ["float", "double"])
def test_written_vectors_grow_with_the_input(spark, monkeypatch, kind):
    monkeypatch.setattr(metric_join, "PER_CELL", 150)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6000, 64))
    x[5000:] = np.repeat(x[:200], 5, axis=0) + rng.normal(size=(1000, 64)) * np.tile([0.05, 0.2, 0.32, 0.33, 0.34], 200)[:, None]  # near copies, many of about 0.95
    x = x.astype("f4" if kind == "float" else "f8")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id bigint, embedding array<{kind}>")
    before, most, write = disk(spark), [0], metric_join.materialize

    def measured(*args):
        table = write(*args)
        most[0] = max(most[0], disk(spark) - before)
        return table

    monkeypatch.setattr(metric_join, "materialize", measured)
    got = metric_join.near_duplicates(df).orderBy("vec_id").toPandas()
    assert most[0] < 4 * x.nbytes
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    assert got.n_links.tolist() == (near.sum(axis=1) - 1).tolist() and got.n_links.max() > 2
    smallest, last = np.arange(len(x)), None
    while last is None or (smallest != last).any():
        last, smallest = smallest, np.where(near, smallest, len(x)).min(axis=1)
    assert got.component_id.tolist() == smallest.tolist()


def test_vectors_without_an_id_join_their_partners(spark):
    rows = [(None, [1.0, 0.0, 0.0]), (None, [1.0, 0.2, 0.0]), (7, [1.0, 0.4, 0.0]), (9, [1.0, -0.2, 0.0]), (11, [0.0, 0.0, 1.0])]
    got = metric_join.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).where(F.col("vec_id").isNotNull()).orderBy("vec_id").toPandas()
    assert got.n_links.tolist() == [1, 1, 0] and got.component_id.tolist() == [7, 7, 11]
