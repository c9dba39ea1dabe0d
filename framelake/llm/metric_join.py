"""Operator 8: exact near-duplicate vectors by a metric range join.

On the unit sphere cosine >= c is a squared distance of at most r^2 = 2 - 2c. TABLES blocks of orthonormal directions share that distance, so in
one block at least a linked pair is within r^2 / TABLES. Each block is searched by itself: a cut through the middle of its first directions deals vectors
into cells. Where two cells lie on different sides of cuts, a pair is apart by more than the squares of both vectors' distances from these cuts, so only
vectors near enough to them are compared at all, first by the block's few coordinates (single precision, with slack), then exactly. A pair counts
in the first block that holds it within its share, and there it meets once.

Vectors travel packed, thousands to a row, in order of their cells. All pairs of such rows meet in a product join that copies nothing to disk,
so disk grows with the input; the comparisons grow with its square, less what the cells save. Directions and cuts come
from a bounded sample; how they fall decides only the speed.

Vectors of equal direction (equal doubles after scaling, signed zeros as zero) are one class with a multiplicity. Two rows of packed vectors return
counts and spanning forests of their links, never their pairs.

Null and zero vectors, and such with null or non-finite components, link with nothing: 0 links, component themselves. Vectors of
different dimensions have no cosine and never link; each dimension has directions and cells of its own. Rows with a null vec_id are counted as partners but have a null component.
Rows of one vec_id are one node. Repeated rows are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, discard, materialize, table, tidied

THRESHOLD = 0.95
TABLES = 4  # blocks of directions that are searched
WIDTH = 16  # directions of a block
PER_CELL = 3000  # vectors to a cell
HOME_BLOCK, BLOCK, BLOCK_BYTES = 2000, 100_000, 8 << 20  # least and most vectors that travel in one row, and their bytes
SLICE = 1024  # rows compared at once, with a quarter as many columns: the products stay in the processor's cache
SAMPLE = 2000  # vectors of one dimension from which directions and cuts are taken
SLACK, SINGLE_SLACK = 1e-9, 1e-5  # of double and of single precision
# For the product: a record is two rows of thousands of vectors; whole files, as each task reads its share of both sides.
TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": True}  # a written table needs its shuffle no longer
PRODUCT = TIDY | {"spark.sql.execution.arrow.maxRecordsPerBatch": 1, "spark.sql.files.maxPartitionBytes": "1g", "spark.sql.files.openCostInBytes": "4m"}
UNNAMED = 1 << 62  # node of a class whose vec_ids are all null: this plus the class


def directions(x: np.ndarray) -> np.ndarray:
    """Rows as doubles of length one; -0.0 becomes 0.0, as equal vectors must have equal bytes."""
    v = np.asarray(x, np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(np.square(v).sum(axis=1, keepdims=True)) + 0.0


def keyed(vectors: DataFrame, kind: str) -> DataFrame:
    """(vec_id, digest, raw) of every row: digest of the direction and packed numbers of `kind`, both null where a vector links with nothing."""
    valid = F.expr("size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)")

    def pack(batches: Iterator):
        for batch in batches:
            digest, raw = np.full(len(batch), None, object), np.full(len(batch), None, object)
            sizes = np.array([-1 if x is None else len(x) for x in batch["embedding"]])
            for size in np.unique(sizes[sizes >= 0]).tolist():
                at = np.flatnonzero(sizes == size)
                x = np.stack(batch["embedding"].to_numpy()[at]).astype(kind)
                raw[at] = [v.tobytes() for v in x]
                digest[at] = [hashlib.sha256(v.tobytes()).digest() for v in directions(x)]
            yield pd.DataFrame({"vec_id": batch["vec_id"], "digest": digest, "raw": raw})

    return vectors.select("vec_id", F.when(valid, F.col("embedding")).alias("embedding")).mapInPandas(tidied(pack), "vec_id bigint, digest binary, raw binary")


class Space:
    """What vectors of one dimension are searched by: blocks of orthonormal directions, the middle of each, and the number of cuts in a block."""

    def __init__(self, dimension: int, total: int = 0, sample: np.ndarray | None = None):
        self.tables = min(TABLES, dimension) if total else 1
        width = max(1, min(WIDTH, dimension // self.tables))
        self.cuts = min(width, max(0, int(np.log2(max(1, total / PER_CELL)))))
        count = self.tables * width
        basis, middle = np.eye(dimension, dtype=np.float64)[:count] if dimension <= count else np.eye(count, dimension), np.zeros(count)
        if total and len(sample):
            noise = np.random.default_rng(1).normal(size=(count, dimension))  # where the sample spans too few directions
            main = np.linalg.svd(sample - sample.mean(axis=0), full_matrices=False)[2][:count]
            basis = np.linalg.qr(np.concatenate([main, noise]).T)[0].T[:count]
            middle = np.median(sample @ basis.T, axis=0)
        order = np.arange(count).reshape(width, self.tables).T  # the directions of most spread go to all blocks in turn
        self.basis, self.middle = basis[order], middle[order].astype(np.float32)

    def coordinates(self, x: np.ndarray, block: int) -> np.ndarray:
        return (directions(x) @ self.basis[block].T).astype(np.float32) - self.middle[block]

    def codes(self, coordinates: np.ndarray) -> np.ndarray:
        return ((coordinates[:, : self.cuts] > 0).astype(np.float32) @ (2.0 ** np.arange(self.cuts)[::-1]).astype(np.float32)).astype(np.int64)


def space_of(shipped, size: int, kind: str) -> Space:
    """The space of a dimension; those with few vectors have one block and one cell."""
    return shipped.value.get(size) or Space(size // np.dtype(kind).itemsize)


def spaces(units: DataFrame, sizes: dict[int, int], kind: str) -> dict[int, Space]:
    """By bytes of a vector, the spaces of the dimensions that have vectors for several cells."""
    found = {}
    for size, n in sizes.items():
        if n >= 2 * PER_CELL:
            share = min(1.0, 4 * SAMPLE / n)
            picked = units.where((F.octet_length("raw") == size) & (F.pmod(F.xxhash64("digest"), F.lit(1_000_000)) < share * 1_000_000)).select("raw").limit(SAMPLE).collect()
            sample = [np.frombuffer(bytes(r["raw"]), kind) for r in picked]
            if sample:
                found[size] = Space(len(sample[0]), n, directions(np.stack(sample)))
    return found


def packed(units: DataFrame, block: int, shipped, kind: str, files: int, most: int) -> DataFrame:
    """(id, size, cls, node, many, x, raw): vectors of one dimension in rows of at most `most`, in order of the cells of a block of directions, with
    their coordinates in it."""

    def code(batches: Iterator):
        for batch in batches:
            sizes, codes, x = batch["raw"].map(len).to_numpy(), np.zeros(len(batch), np.int64), np.full(len(batch), None, object)
            for size in np.unique(sizes).tolist():
                space, at = space_of(shipped, size, kind), np.flatnonzero(sizes == size)
                own = space.coordinates(np.frombuffer(b"".join(batch["raw"].to_numpy()[at]), kind).reshape(len(at), -1), block)
                codes[at], x[at] = space.codes(own), [v.tobytes() for v in own]
            yield batch.assign(size=sizes, code=codes, x=x)[["size", "code", "cls", "node", "many", "x", "raw"]]

    def pack(batches: Iterator):
        from pyspark import TaskContext

        name, held, n = TaskContext.get().partitionId() * ((1 << 20) + 1), [], 0

        def row(parts):
            whole = pd.concat(parts)
            numbers = [whole[c].to_numpy(np.int64).tobytes() for c in ("cls", "node", "many")]
            return pd.DataFrame([[name, int(whole["size"].iloc[0]), *numbers, b"".join(whole["x"]), b"".join(whole["raw"])]], columns=["id", "size", "cls", "node", "many", "x", "raw"])

        for batch in batches:
            while len(batch):
                size = batch["size"].iloc[0]
                same = int((batch["size"] == size).sum())  # sorted by size
                if held and (held[0]["size"].iloc[0] != size or n >= max(1, min(most, BLOCK_BYTES // size))):
                    yield row(held)
                    name, held, n = name + 1, [], 0
                part = batch.iloc[: min(same, max(1, min(most, BLOCK_BYTES // size)) - n)]
                held.append(part)
                batch, n = batch.iloc[len(part) :], n + len(part)
        if held:
            yield row(held)

    coded = units.select("cls", "node", "many", "raw").mapInPandas(tidied(code), "size int, code bigint, cls bigint, node bigint, many bigint, x binary, raw binary")
    order = ["size", "code", "cls"]
    return coded.repartitionByRange(files, *order).sortWithinPartitions(*order).mapInPandas(tidied(pack), "id bigint, size int, cls binary, node binary, many binary, x binary, raw binary")


def stars(hit: np.ndarray, ids: np.ndarray, other: np.ndarray):
    """Edges (u, v) that join what a block's links join: of each component of the matrix a star on its smallest id."""
    found, row_seen = [], np.zeros(len(ids), np.bool_)
    for i in np.flatnonzero(hit.any(axis=1)).tolist():
        if row_seen[i]:
            continue
        rows = np.arange(len(ids)) == i
        all_rows, all_columns = rows.copy(), np.zeros(len(other), np.bool_)
        while rows.any():
            columns = hit[rows].any(axis=0) & ~all_columns
            all_columns |= columns
            rows = hit[:, columns].any(axis=1) & ~all_rows
            all_rows |= rows
        row_seen |= all_rows
        if all_columns.any():
            nodes = np.unique(np.concatenate([ids[all_rows], other[all_columns]]))
            found.append(pd.DataFrame({"u": nodes[1:], "v": nodes[0]}))
    return pd.concat(found) if found else pd.DataFrame({"u": [], "v": []})


class Cells:
    """A row of packed vectors, ready to be compared: coordinates in a block, squares of those that are cut, and the bounds of its cells."""

    def __init__(self, batch: pa.RecordBatch, side: str, space: Space, kind: str):
        column = lambda c, t: np.frombuffer(batch.column(f"{side}_{c}")[0].as_buffer(), t)
        self.cls, self.node, self.many = (column(c, np.int64) for c in ("cls", "node", "many"))
        self.raw = column("raw", kind).reshape(len(self.cls), -1)
        x = column("x", np.float32).reshape(len(self.cls), -1)
        codes = space.codes(x)
        self.starts = np.flatnonzero(np.diff(codes, prepend=-1))
        self.ends = np.append(self.starts[1:], len(codes))
        self.bits = (codes[self.starts][:, None] >> np.arange(space.cuts)[::-1]) & 1
        self.square = np.square(x[:, : space.cuts])
        half, one = np.square(x).sum(axis=1, keepdims=True) / 2, np.ones((len(x), 1), np.float32)
        self.x, self.y = np.hstack([x, -half, -one]), np.hstack([x, one, half])  # their product is half the negative squared distance
        self.counts = np.zeros(len(x), np.int64)


def near_cells(a: Cells, b: Cells, same: bool, most: float) -> Iterator:
    """Pairs of sets of places whose vectors may be within the squared distance `most`: every such pair of a and b is in one of them."""
    apart = (a.bits[:, None] != b.bits).astype(np.float32)
    from_b = [apart[:, j] @ b.square[lo:hi].T for j, (lo, hi) in enumerate(zip(b.starts, b.ends, strict=True))]
    least_b = np.stack([d.min(axis=1) for d in from_b], axis=1)
    for i, (at, end) in enumerate(zip(a.starts, a.ends, strict=True)):
        from_a = apart[i] @ a.square[at:end].T
        least_a = from_a.min(axis=1)
        near = least_a + least_b[i] <= most
        if same:
            near[:i] = False
        for j in np.flatnonzero(near).tolist():
            lo, left, right = b.starts[j], from_a[j], from_b[j][i]
            room, other_room = most - least_b[i, j], most - least_a[j]
            if room >= most and other_room >= most and not apart[i, j].any():
                yield np.arange(at, end), np.arange(lo, b.ends[j])
                continue
            low = at + np.flatnonzero(left <= min(room, most / 2))
            if len(low):
                yield low, lo + np.flatnonzero(right <= other_room)
            if room > most / 2:
                high = at + np.flatnonzero((left > most / 2) & (left <= room))
                if len(high):
                    yield high, lo + np.flatnonzero(right <= most / 2)


def within(a: Cells, left: np.ndarray, b: Cells, right: np.ndarray, most: float, itself: bool) -> Iterator:
    """Places of a and b whose rows and columns have all pairs of `left` and `right` within the squared distance `most`; of a cell with itself those in order."""
    for at in range(0, len(left), SLICE):
        rows = left[at : at + SLICE]
        x = a.x[rows]
        for to in range(0, len(right), max(1, SLICE // 4)):
            columns = right[to : to + max(1, SLICE // 4)]
            half = x @ b.y[columns].T
            if half.max() < -most / 2:
                continue
            hit = half >= -most / 2
            if itself:
                hit &= rows[:, None] < columns
            if hit.any():
                yield rows[hit.any(axis=1)], columns[hit.any(axis=0)]


def exact_links(x: np.ndarray, y: np.ndarray, space: Space, block: int, threshold: float) -> np.ndarray:
    """Which pairs of the directions x and y link and count in this block."""
    share = (2 - 2 * threshold) / space.tables
    cosine = x @ y.T
    ok = cosine >= threshold
    for i, j in zip(*np.nonzero(np.abs(cosine - threshold) < SLACK), strict=True):
        ok[i, j] = float(np.dot(x[i], y[j])) >= threshold
    for b in range(min(block + 1, space.tables - 1)):  # the last block takes what no other one holds
        p, q = x @ space.basis[b].T, y @ space.basis[b].T
        apart = np.square(p).sum(axis=1)[:, None] + np.square(q).sum(axis=1) - 2 * p @ q.T
        within = apart <= share
        for i, j in zip(*np.nonzero(ok & (np.abs(apart - share) < SLACK)), strict=True):  # one verdict in all blocks
            within[i, j] = float(np.square(space.basis[b] @ (x[i] - y[j])).sum()) <= share
        ok &= within if b == block else ~within
    return ok


def link_rows(pairs: DataFrame, block: int, shipped, kind: str, threshold: float) -> DataFrame:
    """(u, v, n): counts of classes (v null) and forest edges of nodes (n null) of each two rows of packed vectors."""

    def compare(a: Cells, b: Cells, same: bool, space: Space):
        most = (2 - 2 * threshold) / space.tables + SINGLE_SLACK
        for left, right in near_cells(a, b, same, most):
            for i, j in within(a, left, b, right, most, same and left[0] == right[0]):
                yield from exact(a, b, i, j, same, space)

    def exact(a: Cells, b: Cells, i, j, same: bool, space: Space):
        link = exact_links(directions(a.raw[i]), directions(b.raw[j]), space, block, threshold)
        if same:
            link &= i[:, None] < j
        if link.any():
            a.counts[i] += (link @ b.many[j].astype(np.float64)).astype(np.int64)
            b.counts[j] += (a.many[i].astype(np.float64) @ link).astype(np.int64)
            yield stars(link, a.node[i], b.node[j])

    def links(batches: Iterator):
        kept, a = None, None
        for batch in batches:
            name, other, size = (batch.column(c)[0].as_py() for c in ("a_id", "b_id", "a_size"))
            space = space_of(shipped, size, kind)
            if kept != name:
                kept, a = name, Cells(batch, "a", space, kind)
            b = a if name == other else Cells(batch, "b", space, kind)
            edges = list(compare(a, b, name == other, space))
            for side in (a,) if a is b else (a, b):
                at = np.flatnonzero(side.counts)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(side.cls[at]), pa.nulls(len(at), pa.int64()), pa.array(side.counts[at])], ["u", "v", "n"])
                side.counts[:] = 0
            if edges:
                forest = pd.concat(edges).drop_duplicates()
                yield pa.RecordBatch.from_arrays([pa.array(forest["u"].to_numpy(np.int64)), pa.array(forest["v"].to_numpy(np.int64)), pa.nulls(len(forest), pa.int64())], ["u", "v", "n"])

    return pairs.mapInArrow(tidied(links), "u bigint, v bigint, n bigint")


@contextmanager
def settings(spark: SparkSession, values: dict):
    """The session with other settings for a while."""
    usual = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, str(value))
    try:
        yield
    finally:
        for name, value in usual.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding)."""
    spark, single = vectors.sparkSession, vectors.schema["embedding"].dataType.elementType.typeName() == "float"
    kind = "<f4" if single else "<f8"
    rows = keyed(vectors.select("vec_id", F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding")), kind)
    kept, written = [], []
    units = rows.where("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("many"), F.first("raw").alias("raw"))
    units = units.withColumn("cls", F.monotonically_increasing_id()).withColumn("node", F.coalesce("rep", F.col("cls") + UNNAMED)).drop("rep")
    with settings(spark, TIDY):
        units = materialize(units, "units", kept)
    size = F.octet_length("raw")
    sizes = {r["size"]: r["n"] for r in units.groupBy(size.alias("size")).agg(F.count("*").alias("n")).collect()}
    known, total = spaces(units, sizes, kind), sum(sizes.values())
    shipped = spark.sparkContext.broadcast(known)
    most = max(1, min(BLOCK, max(HOME_BLOCK, total // 16), BLOCK_BYTES // max(sizes, default=1)))
    count = total // most + 1
    files = max(count // 4, min(count, 12))
    found = None
    for block in range(max((s.tables for s in known.values()), default=1)):
        searched = units.where(size.isin([s for s in known if block < known[s].tables])) if block else units
        with settings(spark, TIDY):
            cells = materialize(packed(searched, block, shipped, kind, files, most * 3 // 2), "cells", written)
        a, b = (cells.select([F.col(c).alias(f"{side}_{c}") for c in cells.columns]) for side in "ab")
        turn = F.when(F.pmod(F.col("a_id") + F.col("b_id"), F.lit(2)) == 0, F.col("a_id") < F.col("b_id")).otherwise(F.col("a_id") > F.col("b_id"))  # one of the two orders, evenly
        pairs = a.join(b.hint("shuffle_replicate_nl"), (F.col("a_size") == F.col("b_size")) & (turn | (F.col("a_id") == F.col("b_id"))))
        with settings(spark, PRODUCT | {"spark.sql.files.minPartitionNum": max(1, files * 2 // 3)}):
            links = materialize(link_rows(pairs, block, shipped, kind, threshold), "links", kept)
        found = links if found is None else found.union(links)
        discard(spark, written)
    counts = found.where("v is null").groupBy(F.col("u").alias("cls")).agg(F.sum("n").alias("n"))
    components = materialize(connected_components(found.where("v is not null").select("u", "v")), "components", kept)
    named = units.select("digest", "cls", "node", "many").join(counts, "cls", "left").join(components, "node", "left")
    named = named.select("digest", (F.col("many") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    out = rows.select("vec_id", "digest").join(named, "digest", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
