"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import functools
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 2000
ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir. Where that is unset, the context's checkpoint folder, or on one machine a temporary one."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return jsc.getCheckpointDir().get().rstrip("/")


def materialize(df: DataFrame, name: str, written: list[str] | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage and survives lost executors. `written` gets the path, for discard()."""
    spark, path, size = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}", "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(size)
    spark.conf.set(size, min(int(usual), BATCH_ROWS) if int(usual) > 0 else BATCH_ROWS)  # batches hold texts or sets: fewer rows at a time bound the workers' memory
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(size, usual)
    if written is not None:
        written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, written: list[str]) -> None:
    """Delete tables that materialize() wrote, once nothing reads them any more."""
    for path in written:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    written.clear()


def text_bytes(text: str = "text") -> Column:
    """UTF-8 bytes of a text column, empty for null."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


class Memo(dict):
    """A dictionary that fills itself by `make` and stays within about `limit` bytes.

    It holds two halves: when the newer one is full it becomes the older one, and what was not asked for meanwhile is forgotten. Entries
    that would take much of the limit are made anew each time.
    """

    def __init__(self, make: Callable, limit: int = 64 << 20):
        super().__init__()
        self.make, self.half, self.held, self.older = make, limit // 2, 0, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        size = sys.getsizeof(key) + sys.getsizeof(value) + 100
        if 16 * size < self.half:
            self.held += size
            if self.held > self.half:
                self.older, self.held = dict(self), size
                self.clear()
            self[key] = value
        return value


def in_worker(key: str, make: Callable):
    """What `make` gives, kept for the life of a Python worker: the functions of this package travel by value, so their globals do not last."""
    held = sys.modules.setdefault("_kept_in_worker", type(sys)("_kept_in_worker")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def tidied(batches: Callable) -> Callable:
    """The generator function `batches`, giving memory back to the system when a task ends: workers live on and serve other stages."""

    @functools.wraps(batches)
    def run(*args):
        import ctypes
        import gc

        import pyarrow

        try:
            yield from batches(*args)
        finally:
            gc.collect()
            pyarrow.default_memory_pool().release_unused()
            ctypes.CDLL(None).malloc_trim(0)

    return run


def from_text(documents: DataFrame, text: str, kind: str, make: Callable) -> DataFrame:
    """`documents` with the columns of the struct type `kind` that `make` gives for each batch of texts. Only texts travel to Python, only results
    back. Columns of the same names are replaced."""
    fields, made = [f.split()[0] for f in kind.split(", ")], f"_{uuid.uuid4().hex}"

    def batches(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from tidied(make)(parts)

    kept = [F.col(f"`{c}`") for c in documents.columns if c not in fields]
    told = documents.select(*kept, F.pandas_udf(batches, kind)(F.col(text).cast("string")).alias(made))
    return told.select(*kept, *[F.col(f"{made}.{f}").alias(f) for f in fields])


def crc_fold(column: str, folds: int) -> Column:
    """crc32 of an id written as text, modulo `folds`; null ids count as the empty string."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every node of `edges`; component is the smallest node reachable.

    Alternating large-star and small-star rounds: each one replaces a node's neighbours by the
    smallest it knows, so only minima are aggregated and no neighbourhood is gathered in a task.
    """
    a, b, written = F.col(u), F.col(v), []
    now = materialize(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges", written)
    sign = lambda d: d.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    mark = sign(now)
    while mark[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, written = written, []
        now = materialize(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges", written)
        discard(now.sparkSession, old)
        after = sign(now)
        if after == mark:
            break
        mark = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def roots(parent: np.ndarray, node: int) -> int:
    """Root of `node` in a union-find array, halving the path."""
    while parent[node] != node:
        parent[node] = parent[parent[node]]
        node = parent[node]
    return node


def runs(batches: Iterator, keys: list[str]) -> Iterator:
    """Frames of equal `keys` from batches that are sorted by them; a run may cross batches."""
    held = []
    for batch in batches:
        if not len(batch):
            continue
        k = batch[keys].to_numpy()
        cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        bounds = [0, *cuts.tolist(), len(batch)]
        if held and (held[-1][keys].to_numpy()[-1] != k[0]).any():
            yield pd.concat(held) if len(held) > 1 else held[0]
            held = []
        for i in range(len(bounds) - 2):
            part = batch.iloc[bounds[i] : bounds[i + 1]]
            if held:
                part, held = pd.concat([*held, part]), []
            yield part
        held.append(batch.iloc[bounds[-2] : bounds[-1]])
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]
