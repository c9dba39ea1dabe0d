"""Operator 3: n-gram Jaccard join by token-combination prefixes.

Documents are sets of word shingles; two link when their Jaccard similarity reaches a threshold t.

1. Equal sets are one class, a node of its own; only classes go on. Classes that share a doc_id are joined by it.
2. Tokens (shingles) fall in two classes by their counts over all documents: rare and frequent. A set is ordered rare
   tokens first, each class by hash. Two linked sets share at least three tokens in the first n - ceil(t n) + 3 of each (the
   prefix, extended by two). The rare tokens of the prefix are indexed one by one and its frequent ones by pairs, so linked sets share
   at least two keys, and sets that share only a common passage mostly share none. For sets of more than LONG tokens pairs
   would grow too many: frequent tokens are indexed one by one there (sets near LONG do both, so that lengths on
   either side meet).
3. Keys with the same members are one bucket. Buckets of two yield a pair if two of their keys agree; larger ones are cut into blocks of
   bounded size in order of length, and each block meets those whose lengths can fit. Members are compared by length and by a parity signature, whose Hamming distance is a lower bound of the symmetric difference: no
   linked pair is refused. A block returns a spanning forest of what is left, not all its pairs: at first for some
   keys of each document, then between the components for all keys.
4. Pairs are verified on the full sets. Linked ones make components; at last, buckets that still span several components return
   their remaining pairs between components, which are verified as well, so no link between components is lost.

Null texts and texts without words have an empty set and link with nothing; their component is themselves. Rows with a null doc_id
link with nothing and have a null component. A doc_id with several texts links with what any of them links with, and its rows with words share a
component. Repeated rows are kept, extra columns dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, connected_components, discard, materialize, roots, table, text_bytes, tidied

FREQUENT = 64  # a token in at least so many documents is frequent, if not more are needed to bound their number
MOST_FREQUENT = 1 << 20  # frequent tokens, at most: 8 MB sent to the executors
LOCAL = 3  # a token counts in a batch of documents from so many on
LONG = 300
FIRST_KEYS = 3  # of its keys in large buckets, that a document takes part in at first
SLOTS = 1 << 22  # bits of the filter of documents that a verification needs: 512 KB
BLOCK = 1000  # members of a block, about; two blocks meet in one comparison
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return (x ^ (x >> np.uint64(29))) * MIX


class WordHashes:
    """64-bit hashes of the words of a text, all at once: differences of the running sums of a polynomial of its bytes, divided by where a word starts."""

    def __init__(self, piece: int = 1 << 18):
        base, self.piece = 0x9E3779B97F4A7C15, piece
        self.power, self.inverse = (np.concatenate([np.ones(1, np.uint64), np.full(piece, f, np.uint64)]).cumprod() for f in (base, pow(base, -1, 1 << 64)))
        self.space = np.zeros(256, np.bool_)
        self.space[[9, 10, 11, 12, 13, 32]] = True

    def __call__(self, text: bytes) -> np.ndarray:
        text, found, at = text.translate(ASCII_LOWER), [], 0
        while at < len(text):
            end = min(len(text), at + self.piece)
            if end < len(text):
                cut = max(text.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
                if cut < 0:  # a word longer than a piece
                    end = next((i for i in range(end, len(text)) if self.space[text[i]]), len(text))
                    found.append(np.array([xxhash.xxh3_64_intdigest(text[at:end])], np.uint64))
                    at = end
                    continue
                end = cut + 1
            found.append(self.words(np.frombuffer(text, np.uint8, end - at, at)))
            at = end
        return np.concatenate(found) if found else np.zeros(0, np.uint64)

    def words(self, raw: np.ndarray) -> np.ndarray:
        edge = np.diff(np.concatenate([[True], self.space[raw], [True]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.power[: len(raw)])])
        return mixed((sums[ends] - sums[starts]) * self.inverse[starts])


def shingle_set(text: bytes, size: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text; one of the whole text if it has fewer words."""
    h = words(text)
    if not len(h):
        return h
    k = min(size, len(h))
    g = h[: len(h) - k + 1] + np.uint64(k)
    for i in range(1, k):
        g = (g ^ (g >> np.uint64(29))) * MIX + h[i : len(h) - k + 1 + i]
    g = (g ^ (g >> np.uint64(32))) * MIX
    return np.unique(g ^ (g >> np.uint64(29)))


def signature(tokens: np.ndarray) -> bytes:
    """Parity of the tokens that fall on each of at least 2n bits in short sets and n / 2 in long ones; the width never falls with n."""
    n = len(tokens)
    bits = 1 << max(7, int(n // 2).bit_length(), min(10, int(2 * n - 1).bit_length()))
    parity = (np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(parity, bitorder="little").tobytes()


def profile(documents: DataFrame, size: int) -> DataFrame:
    """A row for each document (doc_id, n, digest of its set) and one for each block: the tokens that stand in several of its documents."""

    def profiles(batches: Iterator):
        codes = WordHashes()
        for batch in batches:
            sets = [shingle_set(t, size, codes) for t in batch["text"]]
            out = batch[["doc_id"]].assign(n=[len(s) for s in sets], digest=[digest(s) for s in sets], tokens=None, counts=None)
            values, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
            many = counts >= LOCAL
            block = pd.DataFrame([(None, int(sum(map(len, sets))), None, values[many].view(np.int64), counts[many].astype(np.int64))], columns=out.columns)
            yield pd.concat([out.astype({"doc_id": "Int64"}), block.astype({"doc_id": "Int64"})])

    rows = documents.select("doc_id", text_bytes().alias("text"))
    return materialize(rows.mapInPandas(tidied(profiles), "doc_id bigint, n bigint, digest binary, tokens array<bigint>, counts array<bigint>"), "profiles")


def frequent_tokens(profiles: DataFrame) -> np.ndarray:
    """Sorted tokens of at least FREQUENT documents; at most MOST_FREQUENT, as the least count grows with the number of all tokens."""
    blocks = profiles.where("tokens is not null")
    least = max(FREQUENT, -(-(blocks.agg(F.sum("n")).first()[0] or 0) // MOST_FREQUENT))
    counted = blocks.select(F.explode(F.arrays_zip("tokens", "counts")).alias("x")).groupBy("x.tokens").agg(F.sum("x.counts").alias("n"))
    found = [r[0] for r in counted.where(F.col("n") >= least).select("tokens").collect()]
    return np.sort(np.array(found, np.int64).view(np.uint64))


def required(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def prefix_keys(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """Index keys of a set: rare tokens of its prefix, and pairs (or, in long sets, single ones) of the frequent."""
    n = len(tokens)
    length = min(n, n - required(n, percent) + 3)
    is_frequent = np.zeros(n, np.bool_)
    if len(frequent):
        at = np.searchsorted(frequent, tokens)
        is_frequent = frequent[np.minimum(at, len(frequent) - 1)] == tokens
    keys = [tokens[~is_frequent][:length]]
    rest = tokens[is_frequent][: length - len(keys[0])]
    if len(rest) and n <= LONG:
        i, j = np.triu_indices(len(rest), 1)
        keys.append((rest[i] * MIX ^ (rest[j] >> np.uint64(7))) * MIX + rest[j])
    if len(rest) and 100 * n > percent * LONG:
        keys.append(rest ^ MIX)
    return np.unique(np.concatenate(keys)).view(np.int64)


def digest(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def index(documents: DataFrame, classes: DataFrame, size: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """(node, n, sig, keys) of the classes whose set may link with another one."""
    shipped = documents.sparkSession.sparkContext.broadcast(frequent)
    least = next(n for n in range(1, 1000) if 100 * n >= percent * (n + 1))  # smaller sets link only with equal ones

    def keys(batches: Iterator):
        codes, frequent = WordHashes(), shipped.value
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                s = shingle_set(text, size, codes)
                if len(s) >= least:
                    rows.append((doc, digest(s), len(s), signature(s), prefix_keys(s, frequent, percent)))
            yield pd.DataFrame(rows, columns=["rep", "digest", "n", "sig", "keys"])

    rows = documents.where("doc_id is not null").select("doc_id", text_bytes().alias("text"))
    found = rows.mapInPandas(tidied(keys), "rep bigint, digest binary, n bigint, sig binary, keys array<bigint>")
    return found.join(classes.select("rep", "digest", "node"), ["rep", "digest"]).drop("rep", "digest").dropDuplicates(["node"])


def near(n: np.ndarray, sigs: list[bytes], percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, others j > i, Hamming distances) for members of a block, sorted by n, that sizes and signatures leave."""
    width = np.fromiter(map(len, sigs), np.int64, len(sigs))
    same, halved, first = {}, {}, {}
    tops = np.searchsorted(n, n * 100 // percent, side="right")
    for i in np.flatnonzero(tops > np.arange(1, len(n) + 1)).tolist():
        w, top = int(width[i]), int(tops[i])
        for x in (w, 2 * w):
            if x not in same:
                first[x] = int(np.searchsorted(width, x))
                m = np.frombuffer(b"".join(sigs[first[x] : int(np.searchsorted(width, x, side="right"))]), np.uint8).reshape(-1, x)
                same[x], halved[x // 2] = m.view(np.uint64), (m[:, : x // 2] ^ m[:, x // 2 :]).view(np.uint64)
        own, found, apart = same[w][i - first[w]], [], []
        stop = min(top, first[w] + len(same[w]))
        if stop > i + 1:
            found.append(np.arange(i + 1, stop))
            apart.append(np.bitwise_count(same[w][i + 1 - first[w] : stop - first[w]] ^ own).sum(axis=1, dtype=np.int64))
        if top > first[2 * w]:
            found.append(np.arange(first[2 * w], top))
            apart.append(np.bitwise_count(halved[w][: top - first[2 * w]] ^ own).sum(axis=1, dtype=np.int64))
        j, d = np.concatenate(found), np.concatenate(apart)
        ok = (100 + percent) * d <= (100 - percent) * (n[i] + n[j])
        if ok.any():
            yield i, j[ok], d[ok]


def whole_blocks(batches: Iterator, percent: int) -> Iterator[tuple]:
    """(frame, starts, ends, fits) of batches sorted by block, size and document; the last block of a batch waits for the next one.

    starts and ends bound the blocks (equal key, bi, bj); fits marks rows whose successor in the block has a fitting size.
    """
    def bounded(frame, cuts: np.ndarray) -> tuple:
        starts, ends, n = np.append(0, cuts), np.append(cuts, len(frame)), frame["n"].to_numpy()
        fits = np.append(n[1:] * percent <= n[:-1] * 100, False)
        fits[ends - 1] = False
        return frame, starts, ends, fits

    held = None
    for batch in batches:
        if not len(batch):
            continue
        frame = batch if held is None else pd.concat([held, batch], ignore_index=True)
        k = frame[["key", "bi", "bj"]].to_numpy()
        cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        if len(cuts):
            yield bounded(frame.iloc[: cuts[-1]], cuts[:-1])
            frame = frame.iloc[cuts[-1] :]
        held = frame
    if held is not None:
        yield bounded(held, np.zeros(0, np.int64))


def placed(members: DataFrame, percent: int) -> DataFrame:
    """Rows (key, m, node, n) as (key, node, n, b, lo, hi): block b of the bucket, and the blocks that may hold partners by their size.

    Blocks are ranges of the places in order of n; places come from counts by (key, n), so no bucket is sorted in a task.
    """
    by_size = Window.partitionBy("key").orderBy("n")
    reach = int(np.ceil(1e6 * np.log(100 / percent))) + 2
    around = Window.partitionBy("key").orderBy("size").rangeBetween(-reach, reach)
    counts = members.where(F.col("m") > BLOCK).groupBy("key", "n").agg(F.count("*").alias("here"))
    counts = counts.withColumn("before", F.sum("here").over(by_size.rowsBetween(Window.unboundedPreceding, 0)) - F.col("here"))
    counts = counts.withColumn("size", F.floor(1e6 * F.ln("n")).cast("bigint"))
    counts = counts.withColumns({"first": F.min("before").over(around), "end": F.max(F.col("before") + F.col("here")).over(around)}).drop("size")
    block = lambda place: F.coalesce(F.floor(place / BLOCK), F.lit(0)).cast("int")
    place = F.col("before") + F.pmod(F.xxhash64("node", "key"), F.col("here"))
    return members.join(counts, ["key", "n"], "left").select("key", "node", "n", block(place).alias("b"), block(F.col("first")).alias("lo"), block(F.col("end") - 1).alias("hi"))


def deal(rows: DataFrame) -> DataFrame:
    """Rows (key, node, n, b, lo, hi, ...) copied to the pairs of blocks (bi, bj) in which they may have partners."""
    rest = [c for c in rows.columns if c not in ("lo", "hi")]
    dealt = rows.select(*rest, F.explode(F.sequence("lo", "hi")).alias("o"))
    return dealt.select(*rest, F.least("b", "o").alias("bi"), F.greatest("b", "o").alias("bj"))


def with_partner(members: DataFrame, percent: int) -> DataFrame:
    """Rows that have a member of fitting size in one of their blocks: one of the two next to them in order of size."""
    block = Window.partitionBy("key", "bi", "bj").orderBy("n", "node")  # of about 2 BLOCK rows at most
    both = deal(members.withColumns({"lo0": F.col("lo"), "hi0": F.col("hi")}))
    beside = both.withColumns({"less": F.lag("n").over(block), "more": F.lead("n").over(block)})
    return beside.where(f"n * {percent} <= less * 100 or more * {percent} <= n * 100").select("key", "node", "n", "b", F.col("lo0").alias("lo"), F.col("hi0").alias("hi")).distinct()


def compare(members: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Pairs (u, v) between components that sizes and signatures leave, from rows (key, node, n, b, lo, hi, sig, component).

    forest: of each block a spanning forest of them by distance; else all.
    """

    def block_pairs(block: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray] | None:
        node, side, component = block["node"], block["b"], block["component"]
        across = block["bi"][0] != block["bj"][0]
        u, v, apart = [], [], []
        for i, j, d in near(block["n"], block["sig"].tolist(), percent):
            ok = component[j] != component[i]
            if across:
                ok &= side[j] != side[i]
            if ok.any():
                j, d = j[ok], d[ok]
                u.append(np.full(len(j), i))
                v.append(j)
                apart.append(d)
        if not u:
            return None
        u, v, apart = np.concatenate(u), np.concatenate(v), np.concatenate(apart)
        if forest and len(u) > 1:
            _, group = np.unique(component, return_inverse=True)
            parent, kept = np.arange(len(node)), []
            for k in np.lexsort((node[v], node[u], apart)).tolist():
                a, b = roots(parent, int(group[u[k]])), roots(parent, int(group[v[k]]))
                if a != b:
                    parent[a] = b
                    kept.append(k)
            u, v = u[kept], v[kept]
        return node[u], node[v]

    def pairs(batches: Iterator):
        for frame, starts, ends, fits in whole_blocks(batches, percent):
            columns = {c: frame[c].to_numpy() for c in ("node", "b", "bi", "bj", "n", "sig", "component")}
            component = columns["component"]
            several = np.minimum.reduceat(component, starts) < np.maximum.reduceat(component, starts)
            wanted = np.flatnonzero(several & np.logical_or.reduceat(fits, starts)).tolist()
            found = [x for i in wanted if (x := block_pairs({c: a[starts[i] : ends[i]] for c, a in columns.items()})) is not None]
            if found:
                a, b = (np.concatenate(side) for side in zip(*found, strict=True))
                yield pd.DataFrame({"u": np.maximum(a, b), "v": np.minimum(a, b)})

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = deal(members).repartition(parts, "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "n", "node")
    return dealt.mapInPandas(tidied(pairs), "u bigint, v bigint").distinct()


def verify(pairs: DataFrame, documents: DataFrame, classes: DataFrame, size: int, percent: int, written: list[str]) -> DataFrame:
    """(u, v, linked) of `pairs` of nodes, compared on their full sets."""
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    needed = classes.join(nodes, "node", "left_semi").select(F.col("rep").alias("doc_id"), "digest", "node")
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS))
    words = needed.select(slot.alias("s")).groupBy(F.floor(F.col("s") / 32).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s % 32 as int)))").alias("bits")).collect()
    wanted = np.zeros(SLOTS // 32, np.uint32)  # of fixed size; documents outside it need not be hashed or shuffled
    wanted[[r["w"] for r in words]] = [r["bits"] for r in words]
    shipped = documents.sparkSession.sparkContext.broadcast(wanted)

    def sets(batches: Iterator):
        codes, wanted = WordHashes(), shipped.value
        for batch in batches:
            s = batch["slot"].to_numpy()
            batch = batch[(wanted[s // 32] >> (s % 32).astype(np.uint32)) & np.uint32(1) > 0]
            found = [shingle_set(t, size, codes) for t in batch["text"]]
            yield batch[["doc_id"]].assign(digest=[digest(x) for x in found], tokens=[x.tobytes() for x in found])

    texts = documents.where("doc_id is not null").select("doc_id", text_bytes().alias("text"), slot.alias("slot"))
    found = texts.mapInPandas(tidied(sets), "doc_id bigint, digest binary, tokens binary").join(needed, ["doc_id", "digest"])
    held = materialize(found.groupBy("node").agg(F.min("tokens").alias("tokens")), "sets", written)
    both = pairs.join(held.select(F.col("node").alias("u"), F.col("tokens").alias("x")), "u").join(held.select(F.col("node").alias("v"), F.col("tokens").alias("y")), "v")

    def decide(batches: Iterator):
        for batch in batches:
            linked = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch[["u", "v"]].assign(linked=linked)

    return materialize(both.mapInPandas(tidied(decide), "u bigint, v bigint, linked boolean"), "verified", written)


def set_classes(rows: DataFrame, written: list[str]) -> tuple[DataFrame, DataFrame]:
    """(n, digest, rep, node) of every class of equal sets among rows (doc_id, n, digest), and edges (u, v) between the classes of a doc_id.

    A class is named by its smallest doc_id. Where that has several sets, the others get numbers above every doc_id; they are joined with the first.
    """
    full = rows.where("n > 0 and doc_id is not null")
    classes = materialize(full.groupBy("n", "digest").agg(F.min("doc_id").alias("rep")), "classes", written)
    several = full.groupBy("doc_id").agg(F.min("digest").alias("first"), F.max("digest").alias("last")).where("first < last").select("doc_id", "first")
    several = materialize(full.join(several, "doc_id").select("doc_id", "first", "digest", "n").distinct(), "several", written)
    if several.isEmpty():
        return classes.withColumn("node", F.col("rep")), several.select(F.col("doc_id").alias("u"), F.col("doc_id").alias("v"))
    above = rows.agg(F.max("doc_id")).first()[0] + 1
    place = F.row_number().over(Window.partitionBy("rep").orderBy("digest", "n"))
    node = F.when(F.col("place") == 1, F.col("rep")).otherwise(F.lit(above) + F.monotonically_increasing_id())
    classes = materialize(classes.withColumn("place", place).select("n", "digest", "rep", node.alias("node")), "classes", written)
    named = several.join(classes, ["n", "digest"]).select("doc_id", "node")
    low = named.groupBy("doc_id").agg(F.min("node").alias("v"))
    return classes, materialize(named.join(low, "doc_id").where("node > v").select(F.col("node").alias("u"), "v").distinct(), "several", written)


def join_components(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of (doc_id, text)."""
    spark, kept, written = documents.sparkSession, [], []
    profiles = profile(documents, size)
    rows = profiles.where("tokens is null").select("doc_id", "n", "digest")
    classes, same = set_classes(rows, kept)
    held = materialize(index(documents, classes, size, percent, frequent_tokens(profiles)), "index", written)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = held.select(F.explode("keys").alias("key"), "node").repartition(parts, "key")
    buckets = keyed.groupBy("key").agg(F.count("*").alias("m"), F.min("node").alias("v"), F.max("node").alias("u"), F.sum(F.shiftright(F.xxhash64("node"), 20)).alias("fp")).where("m > 1")
    buckets = buckets.groupBy("m", "v", "u", "fp").agg(F.min("key").alias("key"), F.count("*").alias("keys"))
    buckets = materialize(buckets, "buckets", written)
    sizes = held.select("node", "n")
    twos = buckets.where("m = 2 and keys > 1").select("u", "v")
    twos = twos.join(sizes.select(F.col("node").alias("u"), F.col("n").alias("nu")), "u").join(sizes.select(F.col("node").alias("v"), F.col("n").alias("nv")), "v")
    twos = twos.where(F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * percent).select("u", "v")
    slim = keyed.join(buckets.where("m > 2").select("key", "m"), "key").join(sizes, "node").select("key", "m", "node", "n")
    slim = materialize(with_partner(placed(materialize(slim, "members", written), percent), percent), "members", written)
    sigs = held.select("node", "sig")

    # A document's first keys join most of a large group; what they leave is few.
    some = slim.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("key")))).where((F.col("r") <= FIRST_KEYS)).drop("r")
    checked = components = None
    for members, forest in ((some, True), (slim, True), (slim, False)):
        if components is None:
            members = members.withColumn("component", F.col("node"))
        else:
            of = components.withColumnRenamed("node", "of")
            members = members.join(of, members["node"] == of["of"], "left").select(*members.columns, F.coalesce("component", "node").alias("component"))
            spread = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
            members = members.join(spread, "key")
        found = compare(members.join(sigs, "node"), percent, forest)
        found = found.union(twos).distinct() if checked is None else found.join(checked, ["u", "v"], "left_anti")
        found = materialize(found, "pairs", written)
        if checked is not None and found.isEmpty():
            continue
        now = verify(found, documents, classes, size, percent, written)
        checked = now if checked is None else checked.union(now)
        components = materialize(connected_components(checked.where("linked").select("u", "v").union(same)), "components", kept)
    discard(spark, written)
    named = classes.join(components, classes["node"] == components["node"], "left").select("n", "digest", F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(named, ["n", "digest"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents"), 4, 85)
