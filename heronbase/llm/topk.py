"""Exact top-k search with block-at-a-time pruning.

Vectors become integers, ``floor(scale * x)``; a dimension is a term and a component its
weight.  Vectors are numbered anew so that like ones stand together: the cells of a tree
over a bounded sample (cut at the median of the dimension that varies most) come first,
and within a shard the same cuts go on down to blocks.  A block is a range of those
numbers with a forward index (the block's integers) and the largest and smallest weight of
each term.  A query's bound for a block is the sum over its terms of the weight that helps
it most.  Blocks are scored in descending order of that bound, query by query, until the
bound falls below the query's k-th best score.

Cells have bounds too (``CELLS`` at most, broadcast).  A query first searches the cell with the
largest bound; the k-th score found there goes with it, and of the other cells it asks
only those whose bound reaches that score, block by block likewise.

Queries travel in chunks of a bounded size, those of like cells together; every pair of a
chunk and a shard is a group of its own, so no task holds more than one shard and one
chunk, and a shard goes only to chunks that ask its cell.

What this saves depends on the data: ``scored`` tells.  Where vectors are clustered few
blocks are scored; where they point anywhere in many dimensions (as in the tables given
here), no bound of this kind is below the k-th score and all are.

Defined cases: vectors that are null, empty, or hold null or non-finite components
neither ask nor answer; shorter vectors count as padded with zeros; a query leaves out
every row with its own id; equal rows with another id all answer, equal ids too; ties go
to the smaller id; a null id neither asks nor answers.  Integers beyond 2**62 are cut
there; ranks follow exact scores, and a score that a long can't hold shows as the nearest
long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronbase.llm.common import materialize, pick, small_batches

#: Vectors of a shard, of a block, queries of a chunk.
SHARD, BLOCK, CHUNK = 16_384, 64, 2048
#: Cells at most, and sampled vectors for each.
CELLS, SAMPLE = 1024, 16
EXACT = 2.0**52
FOUND = "query_id long, vec_id long, score long, scored long"


def matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Lists of integers as rows, padded with zeros."""
    lists = column.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if (size == dims).all():
        return flat.reshape(len(size), dims)
    out = np.zeros((len(size), dims), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def halves(v: np.ndarray, at: np.ndarray) -> tuple[int, float, np.ndarray, np.ndarray] | None:
    """``at`` cut at the median of the dimension in which these rows vary most: dimension, value, the rows up to it, the others."""
    own = v[at].astype(np.float64)
    d = int(np.argmax(own.var(axis=0)))
    x = own[:, d]
    cut = float(np.median(x))
    low = x <= cut
    if low.all():
        cut = float(x[x < cut].max()) if (x < cut).any() else cut
        low = x <= cut
    return None if low.all() else (d, cut, at[low], at[~low])


def coherent(v: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows in an order that puts like ones together, and the edges of their blocks."""
    order, edges, todo = [], [0], [np.arange(len(v))]
    while todo:
        at = todo.pop()
        cut = halves(v, at) if len(at) > block else None
        if cut:
            todo += [cut[3], cut[2]]
            continue
        for lo in range(0, len(at), block):
            order.append(at[lo : lo + block])
            edges.append(edges[-1] + len(order[-1]))
    return np.concatenate(order) if order else np.empty(0, np.int64), np.array(edges)


def tree(sample: np.ndarray, depth: int) -> list | int:
    """Nested ``[dimension, value, low, high]`` with cell numbers as leaves."""
    count = iter(range(1 << 30))

    def grow(at: np.ndarray, left: int):
        cut = halves(sample, at) if left and len(at) > 1 else None
        return [cut[0], cut[1], grow(cut[2], left - 1), grow(cut[3], left - 1)] if cut else next(count)

    return grow(np.arange(len(sample)), depth)


def cells_of(node: list | int, v: np.ndarray) -> np.ndarray:
    out, todo = np.zeros(len(v), np.int32), [(node, np.arange(len(v)))]
    while todo:
        node, at = todo.pop()
        if isinstance(node, int):
            out[at] = node
        else:
            low = v[at, node[0]] <= node[1]
            todo += [(node[2], at[low]), (node[3], at[~low])]
    return out


def exact_kind(queries: np.ndarray, vectors: np.ndarray):
    """A kind of number in which no score is rounded."""
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * vectors.shape[1]
    return np.float64 if largest < EXACT else object if largest >= 2.0**63 else np.int64


def as_long(x) -> int:
    return min(max(int(x), -(2**63)), 2**63 - 1)


def best(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, block: int = BLOCK, least: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row of the query, id and score of the ``k`` best per query, of those that reach ``least`` (None: any), and the number of vectors scored for each query."""
    kind = exact_kind(queries, vectors)
    order, edges = coherent(vectors, block)
    vectors, ids = vectors[order], ids[order]
    n, nq = len(ids), len(query_ids)
    q, v = queries.astype(kind), vectors.astype(kind)
    up, down = (np.stack([f(v[a:b], axis=0) for a, b in zip(edges[:-1], edges[1:], strict=True)]) for f in (np.max, np.min))
    bound = np.maximum(q, 0) @ up.T + np.minimum(q, 0) @ down.T
    turns = np.argsort(-bound, axis=1, kind="stable")
    least = least or [None] * nq
    floor, floored = np.array([0 if x is None else x for x in least], kind), np.array([x is not None for x in least])
    # the k best so far, in order; a place without row has the number n
    scores = np.full((nq, k), 0, kind)
    rows = np.full((nq, k), n, np.int64)
    known = np.append(ids, np.iinfo(np.int64).max)
    live, scored = np.arange(nq), np.zeros(nq, np.int64)
    for turn in range(len(edges) - 1):
        b = turns[live, turn]
        # a block whose bound equals the k-th score may still hold a smaller id
        open_ = ((rows[live, -1] == n) | (bound[live, b] >= scores[live, -1])) & (~floored[live] | (bound[live, b] >= floor[live]))
        live, b = live[open_], b[open_]
        if not len(live):
            break
        by = np.argsort(b, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(b[by])) + 1):
            at = live[part]
            lo, hi = edges[b[part[0]]], edges[b[part[0]] + 1]
            got = q[at] @ v[lo:hi].T
            scored[at] += hi - lo
            some = np.broadcast_to(np.arange(lo, hi), got.shape).copy()
            some[ids[some] == query_ids[at, None]] = n
            if hi - lo > 4 * k and kind is np.float64:
                # rows below the k-th best of the block can't be among the k best; equal ones stay
                masked = np.where(some == n, -np.inf, got)
                kth = np.partition(masked, hi - lo - k, axis=1)[:, hi - lo - k]
                most = int((masked >= kth[:, None]).sum(1).max())
                pos = np.argsort(-masked, axis=1, kind="stable")[:, :most]
                got, some = np.take_along_axis(got, pos, 1), np.take_along_axis(some, pos, 1)
            every = np.concatenate((scores[at], got), axis=1)
            where = np.concatenate((rows[at], some), axis=1)
            rank = np.lexsort((known[where], -every, where == n), axis=1)[:, :k]
            scores[at], rows[at] = np.take_along_axis(every, rank, 1), np.take_along_axis(where, rank, 1)
    there = rows < n
    return np.nonzero(there)[0], ids[rows[there]], np.array([as_long(x) for x in scores[there]], np.int64), scored


def usable(vec: Column) -> Column:
    return vec.isNotNull() & (F.size(vec) > 0) & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def asked_pairs(vectors: DataFrame, is_query: Column, k: int, scale: float, shard: int) -> tuple[DataFrame, int, int]:
    """``query_id, vec_id, score, scored`` of every pair of a query and a shard that it asks (``scored``, in rows without ``vec_id``: vectors scored for the query there); the numbers of queries and vectors."""
    spark = vectors.sparkSession
    small_batches(spark)
    whole = F.transform("embedding", lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(2.0**62)), F.lit(-(2.0**62)))))
    base = pick(vectors, "vec_id", "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    base = base.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    n, dims = (plain := materialize(base, "vectors")).agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    depth = int(np.log2(max(1, min(CELLS, n // shard))))
    # a bounded sample: at most SAMPLE * CELLS vectors
    drawn = plain.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE << depth).select("v").collect() if depth else []
    root = tree(matrix(pa.chunked_array([pa.array([r.v for r in drawn], pa.list_(pa.int64()))]), dims), depth) if drawn else 0

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = cells_of(root, matrix(pa.chunked_array([b.column(1)]), dims)) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32())], names=["vec_id", "v", "asks", "cell"])

    held = materialize(plain.mapInArrow(place, "vec_id long, v array<long>, asks boolean, cell int"), "cells")
    # a row a cell: its size, and the largest and smallest weight of each term
    each = held.select("cell", F.posexplode("v").alias("term", "w")).groupBy("cell", "term").agg(F.max("w").alias("up"), F.min("w").alias("down"), F.count(F.lit(1)).alias("n"))
    up, down, sizes, full = np.zeros((CELLS, dims), np.int64), np.zeros((CELLS, dims), np.int64), np.zeros(CELLS, np.int64), np.zeros((CELLS, dims), np.int64)
    for r in each.collect():
        up[r.cell, r.term], down[r.cell, r.term], full[r.cell, r.term] = r.up, r.down, r.n
    for r in held.groupBy("cell").count().collect():
        sizes[r.cell] = r["count"]
    short = full < sizes[:, None]  # vectors that end before a term weigh 0 there
    up, down = np.where(short, np.maximum(up, 0), up), np.where(short, np.minimum(down, 0), down)
    live = np.flatnonzero(sizes)
    up, down, parts = up[live], down[live], -(-sizes[live] // shard)
    shared = spark.sparkContext.broadcast((live, up, down))

    def bounds(v: np.ndarray) -> np.ndarray:
        live, up, down = shared.value
        kind = exact_kind(v, np.concatenate((up, down)))
        q = v.astype(kind)
        return np.maximum(q, 0) @ up.astype(kind).T + np.minimum(q, 0) @ down.astype(kind).T

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live = shared.value[0]
        for b in batches:
            if b.num_rows:
                home = live[np.argmax(bounds(matrix(pa.chunked_array([b.column(1)]), dims)), axis=1)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(home.astype(np.int32))], names=["vec_id", "v", "home"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live = shared.value[0]
        for b in batches:
            if b.num_rows:
                bound, least, home = bounds(matrix(pa.chunked_array([b.column(1)]), dims)), b.column(4).to_pylist(), b.column(2).to_pylist()
                ask = [[int(c) for c, x in zip(live, bound[i], strict=True) if c != home[i] and (least[i] is None or x >= least[i])] for i in range(b.num_rows)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), b.column(4), pa.array(ask, pa.list_(pa.int32()))], names=["vec_id", "v", "chunk", "least", "cells"])

    asking = materialize(held.where("asks").select("vec_id", "v").mapInArrow(first, "vec_id long, v array<long>, home int"), "queries")
    per_home = {r.home: -(-r["count"] // CHUNK) for r in asking.groupBy("home").count().collect()}
    split = lambda counts, key, mark: F.pmod(F.xxhash64("vec_id", "v", F.lit(mark)), F.element_at(F.create_map(*[F.lit(int(x)) for kv in counts.items() for x in kv]), F.col(key)).cast("long")).cast("int")
    of_cell = dict(zip(live.tolist(), parts.tolist(), strict=True))
    if not per_home:
        return spark.createDataFrame([], FOUND), 0, n
    asking = asking.withColumn("chunk", F.concat_ws("-", "home", split(per_home, "home", "q")))
    stored = held.select("vec_id", "v", "cell", split(of_cell, "cell", "v").alias("shard"))
    shards = F.explode(F.sequence(F.lit(0), F.element_at(F.create_map(*[F.lit(int(x)) for kv in of_cell.items() for x in kv]), F.col("cell")).cast("int") - 1))

    def one(queries: pa.Table, rows: pa.Table) -> pa.Table:
        none = pa.array([], pa.int64())
        if not queries.num_rows or not rows.num_rows:
            return pa.table({"query_id": none, "vec_id": none, "score": none, "scored": none})
        ids, query_ids = rows.column("vec_id").to_numpy(), queries.column("vec_id").to_numpy()
        q, found, scores, scored = best(matrix(queries.column("v"), dims), query_ids, matrix(rows.column("v"), dims), ids, k, least=queries.column("least").to_pylist())
        nulls = pa.nulls(len(query_ids), pa.int64())
        hits = {"query_id": query_ids[q], "vec_id": found, "score": scores, "scored": pa.nulls(len(found), pa.int64())}
        return pa.concat_tables([pa.table(hits), pa.table({"query_id": query_ids, "vec_id": nulls, "score": nulls, "scored": scored})])

    def searched(asked: DataFrame) -> DataFrame:
        """``asked``: vec_id, v, chunk, least, cell."""
        chunks = asked.select(F.col("chunk").alias("to"), F.col("cell").alias("asked")).distinct()
        sent = stored.join(chunks, F.col("cell") == F.col("asked"))
        return asked.withColumn("part", shards).groupBy("cell", "part", "chunk").cogroup(sent.groupBy("asked", "shard", "to")).applyInArrow(one, FOUND)

    near = materialize(searched(asking.select("vec_id", "v", "chunk", F.lit(None).cast("long").alias("least"), F.col("home").alias("cell"))), "home-cells")
    if len(live) > 1:
        kth = near.where("vec_id IS NOT NULL").withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc()))).where(F.col("nth") == k)
        # equal ids: the least of their k-th scores holds for all; beyond longs no bound is known
        kth = kth.where(F.abs("score") < 2**62).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
        far = asking.join(kth, "vec_id", "left").select("vec_id", "v", "home", "chunk", "least")
        far = materialize(far.mapInArrow(others, "vec_id long, v array<long>, chunk string, least long, cells array<int>").select("vec_id", "v", "chunk", "least", F.explode("cells").alias("cell")), "other-cells")
        near = near.unionByName(searched(far))
    return near, asking.count(), n


def search(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, shard: int = SHARD) -> DataFrame:
    """``vec_id, embedding`` -> ``query_id, rank, vec_id, score`` for the rows where ``is_query`` (of ``vec_id``) holds, against all others."""
    near, _, _ = asked_pairs(vectors, is_query, k, scale, shard)
    by_score = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = near.where("vec_id IS NOT NULL").withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def scored(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, shard: int = SHARD) -> float:
    """The share of all pairs of a query and a vector that the search scores."""
    near, queries, n = asked_pairs(vectors, is_query, k, scale, shard)
    return (near.agg(F.sum("scored")).first()[0] or 0) / max(1, queries * n)
