from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweir.llm.negatives import CandidateBlock, mined, products, spanning_tree

SCHEMA = "vec_id bigint, embedding array<double>, label int, place string, tree string, block int"


def brute(rows, divisor=10, positives=5, negatives=3):
    part = []
    for vec_id, vector, label, *_ in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        part.append((vec_id, [math.floor(256 * x) for x in vector], label))
    lengths = [len(v) for _, v, _ in part]
    usual = min(set(lengths), key=lambda n: (-lengths.count(n), n)) if lengths else 0
    part = [p for p in part if len(p[1]) == usual]
    out = []
    for a, v, own in part:
        if a % divisor:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), b, label) for b, w, label in part if b != a)
        for p, b, _ in [s for s in scored if s[2] == own][:positives]:
            hard = [(n, c) for n, c, label in scored if label != own and 50 * -p <= 100 * -n <= 95 * -p][:negatives]
            out += [(a, b, k + 1, c, -p, -n) for k, (n, c) in enumerate(hard)]
    return sorted(out)


def vectors(n, dim, seed, labels=4, spread=0.4):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((labels, dim))
    return [(k, (centres[k % labels] * spread + r.standard_normal(dim) * 0.3).tolist(), int(r.integers(labels)), "x", "y", 1) for k in range(n)]


def found(spark, rows, **options):
    frame = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in mined(frame, F.col("vec_id") % 10 == 0, **options).collect())


def test_against_brute_force_over_several_blocks(spark, monkeypatch):
    from logweir.llm import negatives

    monkeypatch.setattr(negatives, "CANDIDATES", 90)
    monkeypatch.setattr(negatives, "ANCHORS", 16)
    rows = vectors(600, 8, 1)
    rows += [(700 + k, rows[20][1], rows[20][2] if k % 2 else 3, "x", "y", 1) for k in range(120)]  # a group of copies, ties
    rows += [(901, None, 1, "x", "y", 1), (902, [math.nan] * 8, 1, "x", "y", 1), (903, [1.0] * 7 + [None], 1, "x", "y", 1), (904, [math.inf] * 8, 1, "x", "y", 1)]
    rows += [(None, [1.0] * 8, 1, "x", "y", 1), (910, [1.0] * 8, None, "x", "y", 1), (920, [0.0] * 8, 1, "x", "y", 1), (930, [1.0], 1, "x", "y", 1), (940, [], 1, "x", "y", 1)]
    rows += [rows[30], rows[31]]  # repeated rows
    assert found(spark, rows) == brute(rows)


def test_blocks_meet_trees_over_several_partitions(spark, monkeypatch):
    from logweir.llm import negatives

    monkeypatch.setattr(negatives, "CANDIDATES", 90)
    monkeypatch.setattr(negatives, "ANCHORS", 16)
    rows = vectors(400, 8, 2)
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else small tables are joined to one partition
    try:
        assert found(spark, rows) == brute(rows) != []
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)


@pytest.mark.parametrize("rows", [[], [(10, [1.0, 2.0], 1, "x", "y", 1)], [(10, None, None, None, None, None)], [(k, [0.0], 1, "x", "y", 1) for k in range(12)]])
def test_small_tables(spark, rows):
    assert found(spark, rows) == brute(rows) == []


def test_large_components_are_exact(spark):
    r = random.Random(3)
    rows = [(k, [r.uniform(-1e5, 1e5) for _ in range(4)], k % 3, "x", "y", 1) for k in range(60)]
    assert found(spark, rows) == brute(rows)
    big = np.array([[2.0**40, 3.0], [-(2.0**40), 1.0]])
    assert products(big, np.array([2.0**20 + 1, 7.0])).tolist() == [2**60 + 2**40 + 21, -(2**60) - 2**40 + 7]
    assert products(big * 2.0**30, big[0]).tolist() == [2**63 - 1, -(2**63)]


def test_tree_spans_and_bounds_hold():
    r = np.random.default_rng(4)
    points = np.floor(r.standard_normal((40, 5)) * 60)
    order, parent, edge = spanning_tree(points)
    assert sorted(order.tolist()) == list(range(40)) and parent[0] == -1
    at = {k: i for i, k in enumerate(order.tolist())}
    assert all(at[int(parent[k])] < at[k] for k in range(1, 40))
    full = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    assert np.allclose(edge[1:], [full[k, parent[k]] for k in range(1, 40)])
    rows = np.floor(r.standard_normal((300, 5)) * 60)
    block = CandidateBlock(np.arange(300), np.zeros(300, int), rows)
    scored = []

    def score_at(place, low, high, score):
        exact = rows @ points[place]
        assert (low <= exact).all() and (exact <= high).all()
        some = np.flatnonzero(high > np.sort(exact)[-20])
        score(some)
        scored.append(len(some))

    block.walk([(int(k), int(parent[k]), float(edge[k])) for k in order], points, score_at)
    assert len(scored) == 40 and sum(scored) < 40 * 300
