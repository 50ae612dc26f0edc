"""SimHash near-duplicates by vantage-point trees.

Fingerprints that differ in at most ``distance`` bits are linked, and a document's
class is the smallest id that links reach.

Distances between unrelated 64-bit fingerprints crowd around 32, so a tree over the
whole width prunes next to nothing.  Here the width is cut into ``PARTS`` masks:
a pair within ``distance`` bits lies within ``distance // PARTS`` bits under one of
them, and every mask has a tree of its own with that smaller radius.  The upper
levels of each tree come from a bounded sample and are the partitioning: a
fingerprint lives in one shard, and is sent as a query to those other shards whose
side of a boundary the triangle inequality can't rule out.  Below, each shard builds
its own tree and prunes alike; leaves compare the full width.

Copies are collapsed before anything is paired, and a shard returns a star for each
group that it has linked rather than its pairs; components of the stars are found by
alternating large and small stars over DataFrames.

Defined cases: null and empty texts, and texts without words, have fingerprint zero
and are linked like any other; equal ids each keep their row; a null id counts as the
largest and shows as null only where no other id is in the class; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronbase.llm.common import NULL_ID, doc_key, materialize, pick, small_batches

PARTS = 2
#: Distinct fingerprints that a shard should hold, and the most shards of a tree.
SHARD, MOST_SHARDS = 20_000, 65_536
#: Sampled fingerprints for each shard of the upper tree.
SAMPLE = 16
LEAF = 64


def fingerprint(text: bytes, n: int = 3, seed: int = 42) -> int:
    """Majority bits over the XXH64 of ``n``-word shingles, A-Z lower-cased."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= n:
        return xxh64_intdigest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    counts = np.zeros(64, np.int64)
    total = len(words) - n + 1
    for lo in range(0, total, 65536):
        hi = min(total, lo + 65536)
        h = np.array([xxh64_intdigest(line[a:b], seed) for a, b in zip(starts[lo:hi].tolist(), ends[lo + n - 1 : hi + n - 1].tolist(), strict=True)], np.uint64)
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << int(i) for i in np.flatnonzero(2 * counts > total)))


def fingerprints(docs: DataFrame, n: int = 3, carry: Sequence[str] = ()) -> DataFrame:
    """``doc_id, doc, fp`` and the columns of ``carry`` for every row; ``fp`` holds the 64 bits as a long."""
    small_batches(docs.sparkSession)
    own = pick(docs, "doc_id", "text", *carry).select("doc_id", doc_key().alias("doc"), F.lit(0).cast("long").alias("fp"), *carry, F.col("text").cast("string").alias("text"))
    out = own.drop("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t or b"", n) for t in b.column(b.num_columns - 1).cast(pa.binary()).to_pylist()]
            columns = b.columns[:-1]
            columns[2] = pa.array(np.array(fps, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-1])

    return own.mapInArrow(run, out.schema)


# -- trees ---------------------------------------------------------------------


def masks(parts: int) -> list[int]:
    step = 64 // parts
    return [((1 << (64 if i == parts - 1 else (i + 1) * step)) - (1 << (i * step))) & (2**64 - 1) for i in range(parts)]


def apart(points: np.ndarray, vantage: int, mask: int) -> np.ndarray:
    return np.bitwise_count((points ^ np.uint64(vantage)) & np.uint64(mask))


def split(points: np.ndarray, mask: int) -> tuple[int, int] | None:
    """A vantage point and a radius that halve ``points``, the most evenly of a few tried; None if they all stand alike."""
    best, found = 0, None
    for i in np.linspace(0, len(points) - 1, 5).astype(int):
        d = apart(points, int(points[i]), mask)
        mu = int(np.median(d))
        for m in (mu, mu - 1):
            near = int((d <= m).sum())
            if min(near, len(points) - near) > best:
                best, found = min(near, len(points) - near), (int(points[i]), m)
    return found


def upper_tree(sample: np.ndarray, mask: int, depth: int) -> list:
    """Nested ``[vantage, radius, near, far]`` with shard numbers as leaves."""
    count = iter(range(1 << 30))

    def grow(points: np.ndarray, left: int):
        cut = split(points, mask) if left and len(points) >= 2 else None
        if not cut:
            return next(count)
        near = apart(points, cut[0], mask) <= cut[1]
        return [*cut, grow(points[near], left - 1), grow(points[~near], left - 1)]

    return grow(sample, depth)


def route(tree, points: np.ndarray, mask: int, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per shard: indexes of the points that live there or must be asked there, and which of them live there."""
    todo = [(tree, np.arange(len(points)), np.ones(len(points), bool))]
    while todo:
        node, at, home = todo.pop()
        if not len(at):
            continue
        if isinstance(node, int):
            yield node, at, home
            continue
        vantage, mu, near, far = node
        d = apart(points[at], vantage, mask).astype(np.int64)
        # whatever lies in the near side is at most mu away from the vantage point, in the far side more
        a, b = d <= mu + radius, d > mu - radius
        todo += [(near, at[a], (home & (d <= mu))[a]), (far, at[b], (home & (d > mu))[b])]


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        if (la == lb).all():
            return label
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while (label[label] != label).any():
            label = label[label]


def linked(points: np.ndarray, lives: np.ndarray, mask: int, radius: int, distance: int) -> np.ndarray:
    """Component labels of ``points`` by all links between a point that lives here and any other."""
    label = np.arange(len(points))
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    held = 0

    def settle():
        nonlocal label, held
        if a:
            label = components(len(points), np.concatenate([*a, label]), np.concatenate([*b, np.arange(len(points))]))
            a.clear(), b.clear()
            held = 0

    todo = [(np.flatnonzero(lives), np.arange(len(points)))]
    while todo:
        own, asked = todo.pop()
        if not len(own) or not len(asked):
            continue
        cut = split(points[own], mask) if len(own) > LEAF else None
        if not cut:
            for lo in range(0, len(own), 256):
                some = own[lo : lo + 256]
                for k in range(0, len(asked), 8192):
                    i, j = np.nonzero(np.bitwise_count(points[asked[k : k + 8192], None] ^ points[None, some]) <= distance)
                    i, j = asked[k : k + 8192][i], some[j]
                    new = label[i] != label[j]
                    if new.any():
                        a.append(i[new])
                        b.append(j[new])
                        held += int(new.sum())
                if held > 1_000_000:
                    settle()
            continue
        vantage, mu = cut
        d, e = apart(points[own], vantage, mask), apart(points[asked], vantage, mask).astype(np.int64)
        todo += [(own[d <= mu], asked[e <= mu + radius]), (own[d > mu], asked[e > mu - radius])]
    settle()
    return label


def links(fps: DataFrame, distance: int = 3, parts: int = PARTS, shard: int = SHARD) -> DataFrame:
    """Distinct ``fp`` -> ``u, v``: stars that connect exactly what links within ``distance`` connect, shard by shard."""
    spark = fps.sparkSession
    small_batches(spark)
    total = fps.count()
    shards = min(MOST_SHARDS, max(1, total // shard))
    depth = max(0, int(np.ceil(np.log2(shards))))
    # a bounded sample: at most SAMPLE * MOST_SHARDS fingerprints, whatever the input
    drawn = fps.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE << depth).collect()
    sample = np.array([r.fp for r in drawn], np.int64).view(np.uint64)
    radius, trees = distance // parts, [(m, upper_tree(sample, m, depth)) for m in masks(parts)]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k, (mask, tree) in enumerate(trees):
                for leaf, at, home in route(tree, points, mask, radius):
                    n = len(at)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k, np.int32)), pa.array(np.full(n, leaf, np.int32)), pa.array(points[at].view(np.int64)), pa.array(home)], names=["tree", "shard", "fp", "home"])

    def join(got: pa.Table) -> pa.Table:
        points = got.column("fp").to_numpy().view(np.uint64)
        mask = trees[got.column("tree")[0].as_py()][0]
        label = linked(points, got.column("home").to_numpy(), mask, radius, distance)
        other = np.flatnonzero(label != np.arange(len(points)))
        return pa.table({"u": points[other].view(np.int64), "v": points[label[other]].view(np.int64)})

    sent = fps.select("fp").mapInArrow(send, "tree int, shard int, fp long, home boolean")
    return sent.groupBy("tree", "shard").applyInArrow(join, "u long, v long")


def connected(edges: DataFrame) -> DataFrame:
    """``u, v`` -> ``node, root`` with the component's smallest node, for all nodes of edges."""
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
        before = tuple(now)
        # large star: neighbours above a node go to the smallest of its neighbourhood
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written first: a node with very many neighbours is then a skewed join, which Spark splits
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "lowest")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its neighbours below go to the smallest of these
        large = materialize(large, "large-stars")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "stars")


def classes(fps: DataFrame, distance: int = 3) -> DataFrame:
    """``fp, root, least``: for each distinct fingerprint its class and the smallest ``doc`` that links reach; classes may share a ``least``, but no ``root``."""
    # copies collapse to one row for each fingerprint and task before they are shuffled
    firsts = materialize(fps.groupBy("fp").agg(F.min("doc").alias("first")), "distinct")
    roots = connected(links(firsts.select("fp"), distance))
    of = firsts.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("first").alias("least"))
    return of.join(least, "root").select("fp", "root", "least")


def near_duplicates(docs: DataFrame, distance: int = 3, n: int = 3) -> DataFrame:
    """Per row ``doc_id, fingerprint, component_id``."""
    fps = materialize(fingerprints(docs, n), "fingerprints")
    shown = F.when(F.col("least") != NULL_ID, F.col("least"))
    return fps.join(classes(fps, distance), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), shown.alias("component_id"))


def representatives(docs: DataFrame, row: str, distance: int = 3, n: int = 3) -> DataFrame:
    """The column ``row`` of one document of each class, that with the smallest id; of rows that share this id, one."""
    fps = materialize(fingerprints(docs, n, [row]), "fingerprints")
    first = fps.join(classes(fps.select("doc", "fp"), distance), "fp").where("doc = least")
    # a class has several such rows only where its smallest id is repeated; other classes may have that id too
    one = Window.partitionBy("root").orderBy("fp", F.xxhash64(row))
    return first.withColumn("nth", F.row_number().over(one)).where("nth = 1").select(row)
