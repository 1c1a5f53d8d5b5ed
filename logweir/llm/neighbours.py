"""Approximate nearest neighbours: stable projections, kd-trees, a chi-square stop.

Vectors are projected by ``M`` Gaussian (2-stable) directions: the squared projected
distance of two vectors over their squared distance is chi-square with ``M`` degrees of
freedom, whatever the vectors. A search takes projected neighbours from near to far and
verifies them on the original vectors. It stops when a vector as near as the k-th found
would have been projected nearer than the next one with probability ``SURE``: then each
true neighbour has been seen with at least that probability.

The index: a kd-tree over a bounded sample (``SAMPLE`` vectors by hash of their id, at
most ``MOST_CELLS`` cells) cuts the projected space into cells, and every vector of the
table goes to its cell; a cell with more than ``BLOCK`` vectors is dealt into blocks by
hash, so vectors that lie together are no hot spot. Each block holds a kd-tree of its own.
More than ``QUERY_BLOCK`` queries are dealt into blocks too, each of which meets the index.
Queries first search one block of their own cell for a bound, then all blocks whose cell
the bound's projected radius reaches; the best of all blocks are merged.

Vectors that are null, zero or hold null or non-finite components, that have a null id,
or another length than most, take no part. Distances are Euclidean, in double precision;
ties go to the smaller id. Rows that share the query's id are its own. Rows equal in id
and vector are one row; rows that share an id with different vectors are rows of their
own, and a pair of ids at one distance is returned once. An empty table gives no rows;
extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written_table
from .common import hash_sample

M = 12
SURE = 0.98
SAMPLE = 16_384
MOST_CELLS = 512
BLOCK = 8_192
QUERY_BLOCK = 8_192
LEAF = 256


def chi_square_cdf(x: float, m: int) -> float:
    """Of an even number of degrees of freedom."""
    half, term, total = x / 2, 1.0, 0.0
    for i in range(m // 2):
        total += term
        term *= half / (i + 1)
    return 1 - math.exp(-half) * total


def chi_square_point(p: float, m: int) -> float:
    low, high = 0.0, 40.0 * m
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, m) < p else (low, mid)
    return high


def directions(dim: int, m: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, m))


class CellTree:
    """Median splits of a sample of projected vectors, widest side first."""

    def __init__(self, points: np.ndarray, cells: int) -> None:
        self.axis, self.cut = [], []
        parts = [np.arange(len(points))]
        depth = max(0, cells.bit_length() - 1)
        for _ in range(depth):
            axes, cuts, halves = [], [], []
            for rows in parts:
                own = points[rows]
                axis = int(np.ptp(own, axis=0).argmax()) if len(rows) else 0
                cut = float(np.median(own[:, axis])) if len(rows) else 0.0
                axes.append(axis)
                cuts.append(cut)
                right = own[:, axis] > cut if len(rows) else np.zeros(0, bool)
                halves += [rows[~right], rows[right]]
            self.axis.append(np.array(axes))
            self.cut.append(np.array(cuts))
            parts = halves
        self.cells = 1 << depth
        m = points.shape[1]
        low, high = np.full((1, m), -np.inf), np.full((1, m), np.inf)
        for axes, cuts in zip(self.axis, self.cut):
            low, high = np.repeat(low, 2, 0), np.repeat(high, 2, 0)
            left, right = np.arange(0, len(low), 2), np.arange(1, len(low), 2)
            high[left, axes], low[right, axes] = cuts, cuts
        self.low, self.high = low, high

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for axes, cuts in zip(self.axis, self.cut):
            node = 2 * node + (points[np.arange(len(points)), axes[node]] > cuts[node])
        return node

    def reached(self, point: np.ndarray, radius: float) -> np.ndarray:
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0.0)
        return np.flatnonzero((gap**2).sum(1) <= radius * radius + _slack(point))


def _slack(point: np.ndarray) -> float:
    """Room for rounding: equal vectors may be projected a little apart."""
    return 1e-9 * (1.0 + float((point**2).sum()))


class BlockTree:
    """A kd-tree of one block: leaves of projected vectors with their boxes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projected: np.ndarray) -> None:
        parts, leaves = [np.arange(len(ids))], []
        while parts:
            rows = parts.pop()
            if len(rows) <= LEAF:
                leaves.append(rows)
                continue
            own = projected[rows]
            axis = int(np.ptp(own, axis=0).argmax())
            order = rows[np.argsort(own[:, axis], kind="stable")]
            parts += [order[: len(order) // 2], order[len(order) // 2 :]]
        self.leaves = [(ids[r], vectors[r], projected[r]) for r in leaves if len(r)]
        self.low = np.array([p.min(0) for _, _, p in self.leaves])
        self.high = np.array([p.max(0) for _, _, p in self.leaves])

    def nearest(self, own: int, vector: np.ndarray, point: np.ndarray, k: int, bound: float, stop: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the best ``k``; ``bound``: the k-th distance known so far;
        ``stop``: the chi-square point of the stopping test."""
        gap = (np.maximum(np.maximum(self.low - point, point - self.high), 0.0) ** 2).sum(1)
        slack = _slack(point)
        ids, dist = np.zeros(0, np.int64), np.zeros(0)
        for leaf in np.argsort(gap, kind="stable"):
            if gap[leaf] > stop * bound * bound + slack:
                break
            names, vectors, projected = self.leaves[leaf]
            near = (((projected - point) ** 2).sum(1) <= stop * bound * bound + slack) & (names != own)
            d = np.sqrt(((vectors[near] - vector) ** 2).sum(1))
            ids, dist = np.concatenate([ids, names[near]]), np.concatenate([dist, d])
            if len(ids) > k:
                best = np.lexsort((ids, dist))[:k]
                ids, dist = ids[best], dist[best]
            if len(ids) == k:
                bound = min(bound, float(dist.max()))
        return ids, dist


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), -1) if rows else np.zeros((0, 0))


def taking_part(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id and components (doubles) of the vectors that take part."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0.0))
    usual = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").take(1)
    return rows.where(F.size("v") == (usual[0]["n"] if usual else 0))


def search(
    vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", m: int = M,
    sure: float = SURE, seed: int = 11,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each query row."""
    if m % 2:
        raise ValueError("the number of projections is even")
    rows = taking_part(vectors, vec_id, embedding)
    sample = [r["v"] for r in hash_sample(rows, F.col("vec_id"), SAMPLE).select("v").collect()]
    stop = chi_square_point(sure, m)
    dim = len(sample[0]) if sample else 1
    base = directions(dim, m, seed)
    points = np.array(sample, float).reshape(-1, dim) @ base
    cells = 1
    while cells * 2 * 32 <= len(points) and cells < MOST_CELLS:
        cells *= 2
    tree = CellTree(points, cells)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)
                data = np.ascontiguousarray(flat, "<f8")
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), pa.array([r.tobytes() for r in data], pa.binary()), pa.array(tree.of(data @ base), pa.int32())],
                    names=["vec_id", "v", "cell"],
                )

    index = written_table(rows.mapInArrow(place, "vec_id bigint, v binary, cell int").distinct(), "vector-cells")
    # bound: one count per cell
    blocks = {r["cell"]: -(-r["n"] // BLOCK) for r in index.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    per_cell = F.create_map(*[x for c, n in blocks.items() for x in (F.lit(c), F.lit(n))]) if blocks else F.create_map().cast("map<int,int>")
    block = F.pmod(F.xxhash64("vec_id", "v"), F.element_at(per_cell, F.col("cell"))).cast("int")
    indexed = index.withColumn("block", block).groupBy("cell", "block")
    queries = written_table(index.where(is_query), "queries")  # a table of its own: cogroup cannot tell two uses of one apart

    def found(table: pa.Table, asked: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        out = [[], [], []]
        if table.num_rows and asked.num_rows:
            data = _matrix(table.column("v"))
            held = BlockTree(table.column("vec_id").to_numpy(), data, data @ base)
            wanted = _matrix(asked.column("v"))
            for q, v, p, b in zip(asked.column("vec_id").to_pylist(), wanted, wanted @ base, asked.column("bound").to_pylist()):
                ids, dist = held.nearest(q, v, p, k, math.inf if b is None else b, stop)
                out[0].append(np.full(len(ids), q, np.int64))
                out[1].append(ids)
                out[2].append(dist)
        types = [np.int64, np.int64, np.float64]
        return pa.table([pa.array(np.concatenate(c) if c else np.zeros(0, t)) for c, t in zip(out, types)], names=names)

    result = "query_id bigint, vec_id bigint, score double"
    own = queries.withColumn("block", block).withColumn("bound", F.lit(None).cast("double"))
    first = indexed.cogroup(own.groupBy("cell", "block")).applyInArrow(lambda t, a: found(t, a), result)
    bounds = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("score")).alias("bound"))
    bounded = written_table(queries.join(bounds, queries["vec_id"] == bounds["query_id"], "left").select("vec_id", "v", "bound"), "bounded-queries")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, cell, part = [], [], []
            data = _matrix(batch.column("v"))
            for i, b in enumerate(batch.column("bound").to_pylist()):
                near = range(tree.cells) if b is None else tree.reached(data[i] @ base, b * math.sqrt(stop)).tolist()
                for c in near:
                    for j in range(blocks.get(c, 0)):
                        take.append(i)
                        cell.append(c)
                        part.append(j)
            for at in range(0, len(take), 20_000):
                cut = batch.take(pa.array(take[at : at + 20_000], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*cut.columns, pa.array(cell[at : at + 20_000], pa.int32()), pa.array(part[at : at + 20_000], pa.int32())],
                    names=["vec_id", "v", "bound", "cell", "block"],
                )

    asked = bounded.mapInArrow(spread, "vec_id bigint, v binary, bound double, cell int, block int")
    shares = max(1, -(-queries.count() // QUERY_BLOCK))
    repeated = index.withColumn("block", block).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    asked = asked.withColumn("share", F.pmod(F.xxhash64("v", "vec_id"), F.lit(shares)).cast("int")).groupBy("cell", "block", "share")
    everywhere = repeated.groupBy("cell", "block", "share").cogroup(asked).applyInArrow(lambda t, a: found(t, a), result)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = everywhere.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
