"""Hard-negative mining by inner product, with bounds along spanning trees of anchors.

The score of a candidate at a child anchor differs from that at its parent by at most the
distance of the two anchors times the candidate's norm. So anchors are dealt into blocks
of neighbours (by signs of fixed projections), each block gets a minimum spanning tree,
and a candidate block walks each tree from its root, where all its scores are worked out.
At a child, bounds follow from the parent's; only candidates whose bounds overlap what
the anchor looks for are scored again, and their bounds become that score. Two passes:

1. positives: the best ``POSITIVES`` rows of the anchor's label; bounds are compared with
   the worst of the best found so far;
2. negatives: per positive, the best ``NEGATIVES`` rows of other labels between ``LOW``
   and ``HIGH`` hundredths of the positive's score; bounds are compared with the windows.

Both keep the best of each candidate block, then the best over all blocks. Anchors are a
stated query set held against all rows in blocks, so the work is anchors times rows;
blocks of either side are bounded, travel packed, and no label or copy group decides where
a row goes. Children with the most anchors below them are walked last, after their
parent's bounds are dropped, so that a walk holds few bounds whatever the tree.

Rows with a null id, label or vector, null or non-finite components, or another length
than most, take no part; zero vectors do. Components are ``floor(256 * x)``; scores are
exact integers (those beyond a long become the nearest long). Rows that share an anchor's
id are its own: neither positives nor negatives. A repeated row is a row of its own, so
repeated anchors and positives give repeated results. A negative positive score has an
empty window. An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written_table
from .common import digits_for, ranked_within

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's hundredths of its positive's score.
LOW, HIGH = 50, 95
CANDIDATES = 8_192
ANCHORS = 512
SIGNS = 32

_LEAST, _MOST = -(2**63), 2**63 - 1


# ------------------------------------------------------------------- rows that take part


def rated(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: Column | str = "label") -> DataFrame:
    """row (a number of its own), vec_id, label, v (whole-number components) of the rows
    that take part, written once."""
    label = F.col(label) if isinstance(label, str) else label
    rows = vectors.select(
        F.col(vec_id).cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), F.col(embedding).cast("array<double>").alias("v")
    )
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
    usual = whole.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").take(1)
    scaled = F.transform("v", lambda x: x * SCALE)
    numbered = whole.where(F.size("v") == (usual[0]["n"] if usual else 0)).select(
        F.monotonically_increasing_id().alias("row"), "vec_id", "label", scaled.alias("v")
    )

    def floored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat = np.clip(np.floor(batch.column("v").flatten().to_numpy(zero_copy_only=False)), -1e300, 1e300)
                data = _packed(flat).reshape(batch.num_rows, -1) if len(flat) else np.zeros((batch.num_rows, 0), "<f8")
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array([r.tobytes() for r in data], pa.binary()), pa.array([data.dtype.str] * len(data))],
                    names=["row", "vec_id", "label", "v", "kind"],
                )

    return written_table(numbered.mapInArrow(floored, "row bigint, vec_id bigint, label bigint, v binary, kind string"), "rated-vectors")


def _packed(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest of three types that holds them."""
    most = float(np.abs(values).max(initial=0.0))
    return values.astype("<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8")


def _unpacked(data: list[bytes], kinds: list[str]) -> np.ndarray:
    rows = [np.frombuffer(x, k).astype(np.float64) for x, k in zip(data, kinds)]
    return np.stack(rows) if rows else np.zeros((0, 0))


def products(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows with one; in doubles where they hold
    every partial sum, else in integers of any size."""
    most = float(np.abs(rows).max(initial=0.0)) * float(np.abs(one).max(initial=0.0)) * max(1, rows.shape[1])
    if most < 2**53:
        return (rows @ one).astype(np.int64)
    other = [int(x) for x in one]
    exact = (sum(int(x) * y for x, y in zip(row, other)) for row in rows)
    return np.array([min(max(x, _LEAST), _MOST) for x in exact], np.int64)


# ------------------------------------------------------------------------ spanning trees


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum spanning tree from point 0: the order of a walk in which parents come first
    and the child with the most points below comes last, each point's parent (-1 for the
    root), and its distance to it."""
    n = len(points)
    parent, edge = np.full(n, -1), np.zeros(n)
    near, gap, open_ = np.zeros(n, np.int64), np.full(n, np.inf), np.ones(n, bool)
    now, joined = 0, []
    for _ in range(n):
        open_[now] = False
        joined.append(now)
        d = np.sqrt(((points - points[now]) ** 2).sum(1))
        closer = open_ & (d < gap)
        gap[closer], near[closer] = d[closer], now
        if len(joined) < n:
            now = int(np.where(open_, gap, np.inf).argmin()) if np.isfinite(gap[open_]).any() else int(np.flatnonzero(open_)[0])
            parent[now], edge[now] = near[now], gap[now]
    below = np.ones(n, np.int64)
    for k in reversed(joined[1:]):
        below[parent[k]] += below[k]
    children: list[list[int]] = [[] for _ in range(n)]
    for k in joined[1:]:
        children[parent[k]].append(k)
    order, stack = [], [0] if n else []
    while stack:
        k = stack.pop()
        order.append(k)
        stack += sorted(children[k], key=lambda c: -below[c])
    return np.array(order, np.int64), parent, edge


class CandidateBlock:
    """Rows of one block, with the walk of a tree of anchors over their scores."""

    def __init__(self, vec_id: np.ndarray, label: np.ndarray, vectors: np.ndarray) -> None:
        self.vec_id, self.label, self.vectors = vec_id, label, vectors
        self.norms = np.sqrt((vectors**2).sum(1)) * (1 + 1e-9)
        self.classes = {int(k): np.flatnonzero(label == k) for k in np.unique(label)}

    def walk(self, tree: list[tuple[int, int, float]], anchors: np.ndarray, score_at) -> None:
        """Visit the anchors in order. ``tree``: place, parent's place, distance.
        ``score_at(place, low, high, score)`` calls ``score(rows)`` for the rows that it
        wants scored, which also narrows their bounds."""
        left: dict[int, int] = {}
        for _, parent, _ in tree:
            left[parent] = left.get(parent, 0) + 1
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for place, parent, gap in tree:
            if parent < 0:
                low, high = np.full(len(self.vec_id), -np.inf), np.full(len(self.vec_id), np.inf)
            else:
                room = gap * (1 + 1e-9) * self.norms + 0.5
                low, high = held[parent][0] - room, held[parent][1] + room
                left[parent] -= 1
                if not left[parent]:
                    del held[parent]

            def score(rows: np.ndarray) -> np.ndarray:
                got = products(self.vectors[rows], anchors[place])
                low[rows] = high[rows] = got
                return got

            if parent < 0:
                score(np.arange(len(self.vec_id)))
            score_at(place, low, high, score)
            if left.get(place):
                held[place] = (low, high)

    def best(self, rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """Places among ``rows`` of the ``k`` best: high scores first, then small ids."""
        if len(rows) > 4 * k:
            edge = np.partition(scores, len(scores) - k)[len(scores) - k]
            kept = np.flatnonzero(scores >= edge)
            return kept[np.lexsort((self.vec_id[rows[kept]], -scores[kept]))[:k]]
        return np.lexsort((self.vec_id[rows], -scores))[:k]


# --------------------------------------------------------------------------------- search


def _grouped(rows: DataFrame, block: str) -> DataFrame:
    """One packed row for each block of at most some thousand rows."""
    names = ["row", "vec_id", "label", "v", "kind"]
    lists = [F.col("all").getField(c).alias(c) for c in names]
    return rows.groupBy(block).agg(F.sort_array(F.collect_list(F.struct(*names))).alias("all")).select(block, *lists)


def mined(
    vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    vec_id: str = "vec_id", embedding: str = "embedding", label: Column | str = "label", seed: int = 5,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    ``is_anchor`` is over vec_id; ``label`` may be any expression over the table."""
    rows = rated(vectors, vec_id, embedding, label)
    total = rows.count()
    anchors = rows.where(is_anchor)
    blocks = -(-total // CANDIDATES)
    candidates = written_table(_grouped(rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(max(1, blocks)))), "block"), "candidate-blocks")

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                data = _unpacked(batch.column("v").to_pylist(), batch.column("kind").to_pylist())
                base = np.random.default_rng(seed).standard_normal((data.shape[1], SIGNS))
                code = ((data @ base > 0) << np.arange(SIGNS - 1, -1, -1)).sum(1)
                hexed = pa.array([f"{c:0{SIGNS // 4}x}" for c in code.tolist()])
                yield pa.RecordBatch.from_arrays([*batch.columns, hexed], names=[*batch.schema.names, "code"])

    ddl = "row bigint, vec_id bigint, label bigint, v binary, kind string"
    coded = written_table(anchors.mapInArrow(signs, f"{ddl}, code string").withColumn("__all", F.lit(0)), "coded-anchors")
    count = coded.count()
    digits = min(SIGNS // 4, digits_for(count))
    placed = ranked_within(coded.withColumn("__part", F.substring("code", 1, digits) if digits else F.lit("")), ["__all"], "__part", ["code", "row"], rank="rank")
    blocked = _grouped(placed.withColumn("tree", F.floor(F.col("rank") / ANCHORS)), "tree")

    def planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            orders, parents, edges = [], [], []
            for v, kind in zip(batch.column("v").to_pylist(), batch.column("kind").to_pylist()):
                order, parent, edge = spanning_tree(_unpacked(v, kind))
                orders.append(order)
                parents.append(parent[order])
                edges.append(edge[order])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(orders, pa.list_(pa.int64())), pa.array(parents, pa.list_(pa.int64())), pa.array(edges, pa.list_(pa.float64()))],
                names=[*batch.schema.names, "place", "parent", "edge"],
            )

    packed = "row array<bigint>, vec_id array<bigint>, label array<bigint>, v array<binary>, kind array<string>"
    forest = written_table(blocked.mapInArrow(planted, f"tree bigint, {packed}, place array<bigint>, parent array<bigint>, edge array<double>"), "anchor-trees")
    trees = -(-count // ANCHORS)
    # every block of candidates meets every tree
    left = _to_each(candidates, "tree", trees)

    def met(table: pa.Table) -> tuple[CandidateBlock, np.ndarray]:
        held = [table.column(c)[0].as_py() for c in ("vec_id", "label", "v", "kind")]
        vectors = _unpacked(held[2], held[3])
        return CandidateBlock(np.array(held[0], np.int64), np.array(held[1], np.int64), vectors), vectors

    def walked(table: pa.Table, asked: pa.Table) -> tuple:
        block, _ = met(table)
        others, points = met(asked)
        tree = list(zip(*(asked.column(c)[0].as_py() for c in ("place", "parent", "edge"))))
        return block, others, points, tree

    def alike(table: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if table.num_rows and asked.num_rows:
            block, others, points, tree = walked(table, asked)
            names = np.array(asked.column("row")[0].as_py(), np.int64)

            def score_at(place, low_bounds, high_bounds, score) -> None:
                own = block.classes.get(int(others.label[place]), np.zeros(0, np.int64))
                own = own[block.vec_id[own] != others.vec_id[place]]
                if len(own) > positives:  # the likeliest first; their worst says who can still come in
                    likely = own[np.argpartition(-high_bounds[own], positives - 1)[:positives]]
                    worst = score(likely).min()
                    own = own[high_bounds[own] >= worst]
                if len(own):
                    got = score(own)
                    best = block.best(own, got, positives)
                    for column, part in zip(out, (np.full(len(best), names[place]), np.full(len(best), others.vec_id[place]), block.vec_id[own[best]], got[best])):
                        column.append(part)

            block.walk(tree, points, score_at)
        return pa.table([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for c in out], names=["row", "anchor_id", "positive_id", "positive_score"])

    around = left.cogroup(_to_each(forest, "block", blocks)).applyInArrow(lambda t, a: alike(t, a), "row bigint, anchor_id bigint, positive_id bigint, positive_score bigint")
    order = Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id")
    found = around.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= positives)
    found = written_table(found, "positives")
    windows = found.where("positive_score >= 0").groupBy("row").agg(F.sort_array(F.collect_set("positive_score")).alias("sought"))  # at most ``positives``
    one = forest.select("tree", F.explode(F.arrays_zip("row")).alias("r")).select("tree", "r.row")
    sought = one.join(windows, "row").groupBy("tree").agg(F.map_from_entries(F.collect_list(F.struct("row", "sought"))).alias("sought"))
    asked = written_table(forest.join(sought, "tree"), "anchor-windows")

    def between(table: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if table.num_rows and asked.num_rows:
            block, others, points, tree = walked(table, asked)
            names = np.array(asked.column("row")[0].as_py(), np.int64)
            wanted = dict(asked.column("sought")[0].as_py())

            def score_at(place, low_bounds, high_bounds, score) -> None:
                scores = wanted.get(int(names[place]))
                if not scores:
                    return
                spans = [(p, -(-low * p // 100), high * p // 100) for p in scores]
                overlap = np.zeros(len(block.vec_id), bool)
                for _, least, most in spans:
                    overlap |= (high_bounds >= least) & (low_bounds <= most)
                overlap &= (block.label != others.label[place]) & (block.vec_id != others.vec_id[place])
                near = np.flatnonzero(overlap)
                if not len(near):
                    return
                got = score(near)
                for p, least, most in spans:
                    inside = np.flatnonzero((got >= least) & (got <= most))
                    best = inside[block.best(near[inside], got[inside], negatives)] if len(inside) else inside
                    for column, part in zip(out, (np.full(len(best), names[place]), np.full(len(best), p), block.vec_id[near[best]], got[best])):
                        column.append(part)

            block.walk(tree, points, score_at)
        return pa.table([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for c in out], names=["row", "positive_score", "negative_id", "negative_score"])

    hard = _to_each(candidates, "tree", trees).cogroup(_to_each(asked, "block", blocks)).applyInArrow(lambda t, a: between(t, a), "row bigint, positive_score bigint, negative_id bigint, negative_score bigint")
    inside = Window.partitionBy("row", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    ranked = hard.withColumn("rank", F.row_number().over(inside)).where(F.col("rank") <= negatives)
    return found.join(ranked, ["row", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def _to_each(rows: DataFrame, other: str, count: int):
    """Blocks sent to every tree, or trees to every block. Keys are longs on either side:
    cogroup does not align types, and an int is dealt to another partition than its long."""
    spread = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max(1, count) - 1).cast("bigint")))
    keys = [F.col(c).cast("bigint") for c in ("block", "tree")]
    return rows.withColumn(other, spread).groupBy(*keys)
