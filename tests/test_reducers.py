from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from checks.pane_queries import RunnersUp
from logweir.operators import reducers
from logweir.operators.reducers import Reducer, reduced_by, reduced_in_time_windows


def _bits() -> Reducer:
    # a class of a function travels to the workers with its code
    class Bits(Reducer):
        """The exclusive or of all numbers, and how many distinct last digits there are."""

        def init(self):
            return 0, frozenset()

        def add(self, state, rows):
            for x in rows.column("x").to_pylist():
                if x is not None:
                    state = state[0] ^ x, state[1] | {x % 10}
            return state

        def merge(self, left, right):
            return left[0] ^ right[0], left[1] | right[1]

        def finish(self, state):
            return state[0], len(state[1]), ",".join(map(str, sorted(state[1]))) or None

    return Bits()


OUT = "bits bigint, n_digits int, digits string"


def _rows(n=3000):
    r = random.Random(5)
    return [(r.choice(["a", "b", None, "hot", "hot", "hot"]), r.randrange(4), r.randrange(10**6) if r.random() > 0.1 else None, r.randrange(-500, 4000)) for _ in range(n)]


def _brute(values):
    state = _bits().init()
    for x in values:
        if x is not None:
            state = state[0] ^ x, state[1] | {x % 10}
    return _bits().finish(state)


@pytest.mark.parametrize("held", [10_000, 2])
def test_groups_against_a_loop(spark, monkeypatch, held):
    monkeypatch.setattr(reducers, "MOST_HELD", held)
    rows = _rows()
    df = spark.createDataFrame(rows, "k string, j int, x bigint, s bigint").repartition(6)
    got = {(r["k"], r["j"]): (r["bits"], r["n_digits"], r["digits"]) for r in reduced_by(df, ["k", "j"], _bits(), OUT).collect()}
    groups = {}
    for k, j, x, _ in rows:
        groups.setdefault((k, j), []).append(x)
    assert got == {g: _brute(v) for g, v in groups.items()}


@pytest.mark.parametrize("length, slide, offset", [(60, None, 0), (90, 40, 7), (60, 1, 0), (20, 50, 3)])
def test_windows_against_a_loop(spark, length, slide, offset):
    rows = _rows(400)
    df = spark.createDataFrame(rows, "k string, j int, x bigint, s bigint").repartition(4).withColumn("ts", F.timestamp_seconds("s"))
    df = df.unionByName(df.limit(3).withColumn("ts", F.lit(None).cast("timestamp")))
    out = reduced_in_time_windows(df, "ts", length, slide, _bits(), OUT, ["k"], offset)
    got = {(r["w"], r["e"] - r["w"], r["k"]): (r["bits"], r["n_digits"], r["digits"]) for r in
           out.withColumns({"w": F.unix_seconds("window_start"), "e": F.unix_seconds("window_end")}).collect()}
    step, groups = slide or length, {}
    for k, _, x, s in rows:
        for w in range((s - offset - length) // step, (s - offset) // step + 1):
            if w * step + offset <= s < w * step + offset + length:
                groups.setdefault((w * step + offset, length, k), []).append(x)
    assert got == {g: _brute(v) for g, v in groups.items()}


def test_one_row_per_task_and_group_is_shuffled(spark):
    df = spark.range(0, 40_000, 1, 4).select(F.lit("hot").alias("k"), F.col("id").alias("x"))
    assert reducers._states(df, ["k"], _bits()).count() == 4
    assert reduced_by(df.where("x < 0"), ["k"], _bits(), OUT).collect() == []


def test_runners_up(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 5.0), ("a", 5.0), ("a", None), ("b", 2.0), ("c", None)], "k string, value double")
    got = {tuple(r) for r in reduced_by(df, ["k"], RunnersUp(), "n bigint, second double").collect()}
    assert got == {("a", 4, 5.0), ("b", 1, None), ("c", 1, None)}
