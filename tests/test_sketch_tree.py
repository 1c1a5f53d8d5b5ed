"""Few distinct values are counted exactly by a sketch, so windows can be compared one by one."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from logweir.operators import sketch_tree as T, windows as W
from test_windows import model_count_windows


@pytest.mark.parametrize("length,slide,offset", [(10, 3, 0), (16, 4, 1), (7, 7, 0), (37, 1, 5), (4, 10, 2), (1, 1, 0)])
def test_time_windows(spark, length, slide, offset):
    r = random.Random(length)
    points = [(r.choice([-40, 0, 3, 90]) + r.randrange(20), r.choice(["a", "b"]), f"u{r.randrange(6)}") for _ in range(150)]
    want = defaultdict(set)
    for s, k, u in points:
        for i in range(-200, 300):
            if i * slide + offset <= s < i * slide + offset + length:
                want[i * slide + offset, k].add(u)
    frame = spark.createDataFrame([*points, (None, "a", "u1"), (5, "a", None)], "s bigint, k string, unit string").withColumn("ts", F.timestamp_seconds("s"))
    got = T.sketched_in_time_windows(frame, "ts", length, slide, keys=["k"], offset=offset).select(F.unix_seconds("window_start"), F.unix_seconds("window_end"), "k", "approx_distinct").collect()
    assert sorted(tuple(x) for x in got) == sorted((s, s + length, k, len(v)) for (s, k), v in want.items())


@pytest.mark.parametrize("length,slide,emit", [(20, 6, "full"), (64, 1, "next_record"), (30, 30, "full"), (10, 25, "next_record")])
def test_count_windows(spark, length, slide, emit):
    r = random.Random(2)
    items = [f"u{r.randrange(40)}" for _ in range(200)]
    frame = spark.createDataFrame(list(enumerate(items)), "at bigint, unit string")
    got = T.sketched_in_count_windows(W.indexed(frame, ["at"]), length, slide, emit=emit).collect()
    assert sorted(tuple(x) for x in got) == sorted((k, len(set(v))) for k, v in model_count_windows(items, length, slide, emit).items())


@pytest.mark.parametrize("length,slide", [(1000, 1), (1000, 8), (777, 5), (512, 64)])
def test_a_window_is_few_nodes_without_overlap(spark, length, slide):
    """With panes as levels of sums in place of sketches: each window's nodes cover it once."""
    covered = []
    for level in range(length.bit_length()):
        size = 1 << level
        covered += [(level, node) for node in range(-(-4000 // size))]
    nodes = spark.createDataFrame(covered, "level int, node bigint").withColumn("sketch", F.lit(None).cast("binary"))
    size = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("level"))
    keyed = T.windows_of_nodes(nodes.withColumn("panes", size), length, slide, ["panes", "level", "node"])
    found = keyed.groupBy("window_id").agg(F.sum("panes").alias("n"), F.count("*").alias("parts"), F.max(F.col("node") * F.col("panes")).alias("last"))
    whole = found.where((F.col("window_id") >= 0) & (F.col("window_id") * slide + length <= 4000))
    low, high, parts, windows = whole.agg(F.min("n"), F.max("n"), F.max("parts"), F.count("*")).first()
    assert low == high == length and parts <= 2 * length.bit_length() and windows == (4000 - length) // slide + 1


def test_empty(spark):
    none = spark.createDataFrame([], "ts timestamp, unit string")
    assert T.sketched_in_time_windows(none, "ts", 10, 2).collect() == []
