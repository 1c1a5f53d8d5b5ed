"""Windows against models that walk the rows one by one."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from logweir.operators import windows as W
from logweir.operators.ordering import with_given_index, with_row_index


def model_count_windows(items, length, slide, emit):
    """Open a window at every slide-th row; report a full one when the next row comes."""
    done, live = {}, []
    for i, item in enumerate(items):
        if emit == "next_record":
            for k, held in [w for w in live if len(w[1]) >= length]:
                done[k] = held
            live = [w for w in live if len(w[1]) < length]
        if i % slide == 0:
            live.append((i // slide, []))
        for w in live:
            w[1].append(item)
        if emit == "full":
            for k, held in [w for w in live if len(w[1]) >= length]:
                done[k] = held
            live = [w for w in live if len(w[1]) < length]
    return done


CASES = [
    (0, 3, 3, "next_record"), (1, 1, 1, "next_record"), (1, 1, 1, "full"), (6, 3, 3, "next_record"), (6, 3, 3, "full"),
    (50, 10, 3, "next_record"), (61, 12, 4, "full"), (200, 5, 9, "next_record"), (200, 5, 9, "full"),
    (101, 100, 1, "next_record"), (101, 100, 1, "full"), (333, 40, 15, "next_record"), (500, 2, 1, "full"),
]


def values(n, seed):
    draw = random.Random(seed)
    # a third of the rows share one value
    return ["hot" if draw.random() < 1 / 3 else f"v{draw.randrange(12)}" for _ in range(n)]


def frame_of(spark, items, partitions=5):
    rows = list(enumerate(items))
    random.Random(1).shuffle(rows)
    schema = "at bigint, unit string"
    return spark.createDataFrame(rows, schema).repartition(partitions) if rows else spark.createDataFrame([], schema)


@pytest.mark.parametrize("n,length,slide,emit", CASES)
def test_count_windows(spark, rows, monkeypatch, n, length, slide, emit):
    monkeypatch.setattr(W, "_CHUNK_WINDOWS", 2)  # so that small inputs span chunks
    items = values(n, n * 7 + length)
    model = model_count_windows(items, length, slide, emit)
    frame = frame_of(spark, items)
    placed = with_row_index(frame, ["at"])
    out = W.distinct_in_count_windows(placed, length, slide, emit=emit, count="rows")
    assert rows(out, "window_id", "n_distinct", "rows") == sorted(
        ((k, len(set(v)), len(v)) for k, v in model.items()), key=repr)
    bare = W.distinct_in_count_windows(placed, length, slide, emit=emit)
    assert rows(bare, "window_id", "n_distinct") == sorted(((k, len(set(v))) for k, v in model.items()), key=repr)
    inside = W.in_count_windows(placed, length, slide, emit)
    agg = inside.groupBy("window_id").agg(F.min("unit").alias("low"), F.count("*").alias("n"))
    assert rows(agg, "window_id", "low", "n") == sorted(((k, min(v), len(v)) for k, v in model.items()), key=repr)


def test_keyed_count_windows(spark, rows):
    items = values(400, 5)
    draw = random.Random(9)
    keys = [draw.choice(["a", "b", None]) for _ in items]
    frame = spark.createDataFrame(list(zip(range(400), keys, items)), "at bigint, k string, unit string").repartition(6)
    want = []
    for key in ("a", "b", None):
        mine = [v for k, v in zip(keys, items) if k == key]
        want += [(k, key, len(set(v))) for k, v in model_count_windows(mine, 20, 8, "next_record").items()]
    placed = with_row_index(frame, ["at"], ["k"])
    out = W.distinct_in_count_windows(placed, 20, 8, keys=["k"])
    assert rows(out, "window_id", "k", "n_distinct") == sorted(want, key=repr)
    agg = W.count_window(frame, ["at"], 20, 8, {"n": F.count_distinct("unit")}, ["k"])
    assert rows(agg, "window_id", "k", "n") == sorted(want, key=repr)


def test_python_reducer(spark, rows):
    """A reducer of one's own: a grouped pandas aggregate."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def longest(v: pd.Series) -> str:
        return sorted(v, key=lambda s: (-len(s), s))[0]

    items = values(40, 3)
    out = W.count_window(frame_of(spark, items), ["at"], 10, 10, {"w": longest(F.col("unit"))}, emit="full")
    model = model_count_windows(items, 10, 10, "full")
    assert rows(out, "window_id", "w") == [(k, sorted(v, key=lambda s: (-len(s), s))[0]) for k, v in model.items()]


def test_row_index_splits_hot_keys(spark):
    """A key that holds most rows is numbered by many tasks."""
    rows = spark.range(20000).select(
        "id", F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"))
    placed = with_row_index(rows, ["id"], ["k"]).withColumn("task", F.spark_partition_id())
    plan = rows.repartitionByRange(8, "k", "id").groupBy(F.spark_partition_id().alias("p")).count()
    sizes = [r["count"] for r in plan.collect()]
    assert len(sizes) > 4 and max(sizes) < 20000 / 3
    bad = placed.groupBy("k").agg(
        F.min("row_idx").alias("lo"), F.max("row_idx").alias("hi"), F.count_distinct("row_idx").alias("d"),
        F.count("*").alias("n"), F.max("row_total").alias("t"))
    assert bad.where("lo <> 0 or hi <> n - 1 or d <> n or t <> n").count() == 0


def test_row_index_follows_several_columns(spark, rows):
    data = [(i % 3, -i, f"x{i}") for i in range(50)]
    placed = with_row_index(spark.createDataFrame(data, "a int, b int, c string").repartition(4), ["a", "b"])
    assert [r.c for r in placed.orderBy("row_idx").collect()] == [c for _, _, c in sorted(data)]


def test_given_index_checks_the_offsets(spark):
    good = spark.range(10, 30).withColumnRenamed("id", "offset")
    assert with_given_index(good, "offset").agg(F.max("row_idx"), F.max("row_total")).head() == (19, 20)
    with pytest.raises(Exception, match="gaps or repeats"):
        with_given_index(good.where("offset <> 15"), "offset").collect()
    parts = spark.range(40).select((F.col("id") % 3).alias("p"), (F.col("id") / 3).cast("bigint").alias("offset"))
    placed = with_given_index(parts, "offset", ["p"])
    assert placed.where("row_idx <> offset").count() == 0
    assert {(r.p, r.row_total) for r in placed.collect()} == {(0, 14), (1, 13), (2, 13)}
    with pytest.raises(Exception, match="gaps or repeats"):
        with_given_index(parts.where("p <> 1 or offset <> 5"), "offset", ["p"]).collect()


# ------------------------------------------------------------------ time windows


def model_time_windows(points, length, slide, offset=0):
    out = {}
    for t, v in points:
        k = (t - offset - length) // slide + 1
        while k * slide + offset <= t:
            if k * slide + offset + length > t:
                out.setdefault(k * slide + offset, []).append(v)
            k += 1
    return out


def timed(spark, points):
    frame = spark.createDataFrame(points, "s bigint, unit string")
    return frame.select(F.timestamp_seconds("s").alias("ts"), "unit").repartition(4)


@pytest.mark.parametrize("length,slide,offset", [(10, 10, 0), (10, 1, 0), (10, 4, 3), (1, 2, 0), (3, 10, 2), (7, 7, 5)])
def test_time_windows(spark, rows, monkeypatch, length, slide, offset):
    monkeypatch.setattr(W, "_CHUNK_WINDOWS", 2)
    draw = random.Random(length * 31 + slide)
    points = [(draw.randrange(-60, 200), v) for v in values(300, slide)] + [(0, "edge"), (10, "edge"), (-10, "edge")]
    model = model_time_windows(points, length, slide, offset)
    frame = timed(spark, points)
    out = W.distinct_in_time_windows(frame, "ts", length, slide, offset=offset, rows="n")
    got = rows(out.select(F.unix_seconds("window_start"), F.unix_seconds("window_end"), "n_distinct", "n"))
    assert got == sorted(((s, s + length, len(set(v)), len(v)) for s, v in model.items()), key=repr)
    agg = W.time_window(frame, "ts", length, slide, {"n": F.count("*")}, offset=offset)
    got = rows(agg.select(F.unix_seconds("window_start"), F.unix_seconds("window_end"), "n"))
    assert got == sorted(((s, s + length, len(v)) for s, v in model.items()), key=repr)


@pytest.mark.parametrize("length,slide", [(10, 10), (10, 5), (5, 10)])
def test_empty_windows(spark, rows, length, slide):
    points = [(3, "a"), (4, "b"), (61, "c"), (102, "d")]
    model = model_time_windows(points, length, slide)
    out = W.time_window(timed(spark, points), "ts", length, slide, emit_empty=True)
    got = rows(out.select(F.unix_seconds("window_start"), F.coalesce("n", F.lit(0))))
    every = range(min(model), max(model) + 1, slide)
    assert got == sorted(((s, len(model.get(s, []))) for s in every), key=repr)


def test_empty_windows_span_blocks(spark):
    points = [(0, "a"), (25_000, "b")]
    out = W.time_window(timed(spark, points), "ts", 1, 1, emit_empty=True)
    assert (out.count(), out.where("n is null").count()) == (25_001, 24_999)


def test_window_messages(spark, rows):
    windows = spark.createDataFrame([(3, "a", 2)], "window_id bigint, k string, n bigint")
    assert rows(W.emit_windows(windows, "window_id", ["k"])) == [("3/a", '{"k":"a","n":2}')]
    custom = W.emit_windows(windows, "window_id", value=F.concat("k", F.lit("="), "n"))
    assert rows(custom) == [("3", "a=2")]


def _shuffles_the_log(df) -> bool:
    """Whether the final plan shuffles rows that carry the line."""
    import re

    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    return bool(re.search(r"Exchange hashpartitioning", final))


def test_row_index_leaves_the_rows_where_they_are(spark):
    from logweir.operators.ordering import with_given_index, with_row_index

    rows = spark.range(20_000).select("id", (F.col("id") % 7).alias("part"), F.expr("id div 7").alias("off"), F.repeat(F.lit("x"), 50).alias("line"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        for df in (with_row_index(rows, ["id"]), with_row_index(rows, ["id"], ["part"]), with_given_index(rows, "off", ["part"])):
            assert not _shuffles_the_log(df)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_given_numbers_do_not_go_with_filtered_windows(spark):
    from logweir.plans import jobs

    with pytest.raises(ValueError):
        jobs.bucket_match(spark.range(1).select("id", F.lit("x").alias("line")), ["id"], filter_first=True, given=True)
