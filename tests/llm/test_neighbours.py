from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from logweir.llm import neighbours
from logweir.llm.neighbours import chi_square_cdf, chi_square_point, search

SCHEMA = "vec_id bigint, embedding array<float>, label int, rank int"


def brute(rows, k):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    out = {}
    for i in np.flatnonzero(ids % 10 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def vectors(n, dim, seed=0):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(5, dim))
    return [(int(i), [float(v) for v in (centers[i % 5] + 0.4 * r.normal(size=dim)).astype(np.float32)], 0, 1) for i in range(n)]


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 100)
    rows = vectors(1500, 24) + [(5000 + i, vectors(1, 24)[0][1], 0, 1) for i in range(150)]  # one vector many times
    got = {}
    for r in search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    expected = brute(rows, 10)
    assert set(got) == set(expected)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
        known = dict(expected[q])
        hits += sum(v in known for _, v, _ in found)
        for _, v, s in found:
            if v in known:
                assert abs(known[v] - s) < 1e-12
    assert hits >= 0.95 * 10 * len(expected)


def test_rows_that_take_no_part(spark):
    odd = [
        (10, None, 0, 1), (20, [0.0, 0.0], 0, 1), (30, [1.0, None], 0, 1), (40, [float("nan"), 1.0], 0, 1), (50, [float("inf"), 1.0], 0, 1),
        (None, [1.0, 1.0], 0, 1), (60, [1.0], 0, 1), (0, [1.0, 0.0], 0, 1), (1, [1.0, 0.0], 0, 1), (2, [0.0, 1.0], 0, 1), (0, [1.0, 0.0], 0, 1),
    ]
    got = search(spark.createDataFrame(odd, SCHEMA), F.col("vec_id") % 10 == 0).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 1, 0.0), (0, 2, 2, 2**0.5)]
    assert search(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 10 == 0).collect() == []


def test_chi_square():
    assert abs(chi_square_cdf(18.307, 10) - 0.95) < 1e-4
    assert abs(chi_square_point(0.95, 10) - 18.307) < 1e-2


def test_repeated_rows_take_no_places(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 7)
    rows = vectors(300, 8)
    plain = spark.createDataFrame(rows, SCHEMA)
    hot = plain.where("vec_id in (1, 2, 3, 10)").withColumn("__n", F.explode(F.sequence(F.lit(1), F.lit(3000)))).drop("__n")
    expected = sorted((r[0], r[1], r[2]) for r in search(plain, F.col("vec_id") % 10 == 0).collect())
    got = sorted((r[0], r[1], r[2]) for r in search(plain.unionByName(hot), F.col("vec_id") % 10 == 0).collect())
    assert got == expected and len(got) == 300


def test_one_id_with_many_vectors(spark):
    rows = [(0, [0.0, 1.0], 0, 1), *[(1, [float(k), 2.0], 0, 1) for k in range(4)], (2, [0.0, 9.0], 0, 1)]
    got = search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 2)]
