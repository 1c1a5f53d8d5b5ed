"""Pane windows against a model that copies every row into its windows."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from logweir.operators import panes as P

SCHEMA = "at bigint, k string, x int, name string"


def items(n: int, seed: int = 1) -> list[tuple]:
    r = random.Random(seed)
    keys = ["hot"] * 6 + ["a", None]
    return [(i, r.choice(keys), r.choice([None, *range(-5, 50)]), f"n{r.randrange(9)}") for i in range(n)]


def aggs() -> dict[str, P.Mergeable]:
    return {
        "n": P.counted(), "held": P.counted("x"), "total": P.total("x"), "low": P.least("x"), "top": P.most("x"), "mean": P.mean("x"),
        "dev": P.spread("x"), "last": P.last_of("name", "at"), "any": P.either(F.col("x") > 45), "units": P.sketched("name"),
    }


NAMES = ["n", "held", "total", "low", "top", "mean", "dev", "last", "any", "units"]


def summary(rows: list[tuple]) -> tuple:
    xs = [x for _, _, x, _ in rows if x is not None]
    mean = sum(xs) / len(xs) if xs else None
    dev = (sum(x * x for x in xs) / len(xs) - mean * mean) ** 0.5 if xs else None
    anyone = any(x > 45 for x in xs) if xs else None
    return (
        len(rows), len(xs), sum(xs) if xs else None, min(xs, default=None), max(xs, default=None), mean, dev and round(dev, 6), rows[-1][3], anyone,
        len({n for *_, n in rows}),
    )


def plain(row, head):
    values = [row[c] for c in head] + [row[c] for c in NAMES]
    at = len(head) + NAMES.index("dev")
    values[at] = values[at] and round(values[at], 6)
    return tuple(values)


@pytest.mark.parametrize("length,slide,emit", [(10, 3, "next_record"), (10, 10, "full"), (12, 1, "full"), (8, 6, "next_record"), (5, 20, "full"), (400, 7, "full"), (7, 400, "full")])
def test_count_windows(spark, length, slide, emit):
    rows = items(300)
    frame = spark.createDataFrame(rows, SCHEMA)
    want = []
    for k in range(300):
        held = rows[k * slide : k * slide + length]
        if len(held) == length and (emit == "full" or k * slide + length < 300):
            want.append((k, *summary(held)))
    got = P.sliding_count_window(frame, ["at"], length, slide, aggs(), emit=emit).collect()
    assert sorted(plain(r, ["window_id"]) for r in got) == want


def test_keyed_count_windows(spark):
    rows = items(400, 2)
    mine = defaultdict(list)
    for r in rows:
        mine[r[1]].append(r)
    want = [(k, key, *summary(held[k * 4 : k * 4 + 20])) for key, held in mine.items() for k in range(100) if len(held[k * 4 : k * 4 + 20]) == 20 and k * 4 + 20 < len(held)]
    got = P.sliding_count_window(spark.createDataFrame(rows, SCHEMA), ["at"], 20, 4, aggs(), ["k"]).collect()
    assert sorted((plain(r, ["window_id", "k"]) for r in got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("length,slide,offset", [(10, 2, 0), (10, 3, 1), (6, 6, 0), (4, 10, 2), (9, 1, 0), (50, 20, 5)])
def test_time_windows_with_gaps(spark, length, slide, offset):
    r = random.Random(3)
    seconds = sorted({r.choice([0, 40, 200, -90]) + r.randrange(25) for _ in range(60)})
    rows = [(s, "k", r.choice([None, 1, 2, 47]), f"n{r.randrange(5)}") for s in seconds]
    frame = spark.createDataFrame([*rows, (None, "k", 1, "x")], SCHEMA).withColumn("ts", F.timestamp_seconds("at"))
    want = []
    for k in range(-200, 400):
        start = k * slide + offset
        held = [row for row in rows if start <= row[0] < start + length]
        if held:
            want.append((start, start + length, *summary(held)))
    got = P.sliding_time_window(frame, "ts", length, slide, aggs(), offset=offset)
    got = got.withColumn("s", F.unix_seconds("window_start")).withColumn("e", F.unix_seconds("window_end")).collect()
    assert sorted(plain(row, ["s", "e"]) for row in got) == want


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA).withColumn("ts", F.timestamp_seconds("at"))
    assert P.sliding_time_window(none, "ts", 10, 2).collect() == [] == P.sliding_count_window(none, ["at"], 10, 2).collect()


@pytest.mark.parametrize("length,slide", [(1_000_000, 100_000), (1_000_000, 1)])
def test_rows_are_not_copied(spark, length, slide):
    """What is unrolled is panes that running aggregates have merged, never rows; at a slide
    of one too, a window takes at most two of them."""
    rows = spark.range(3000).select(F.col("id").alias("at"), (F.col("id") % 7).alias("x"))
    out = P.sliding_count_window(rows, ["at"], length, slide, {"n": P.counted(), "t": P.total("x")}, emit="full")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    generate, window = plan.index("Generate explode"), plan.index("Window [")
    assert generate < window < plan.rindex("Relation [")  # the plan reads from the top down
    assert out.collect() == []
    small = P.over_panes(rows.withColumn("row_idx", F.col("at")), F.col("at"), 1000, 1, {"n": P.counted()}, first_id=0)
    assert small.agg(F.min("n"), F.max("n"), F.count("*")).first() == (1, 1000, 3000)
