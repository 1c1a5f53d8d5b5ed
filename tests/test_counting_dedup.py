from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from logweir.operators import counting as ct, dedup as dd
from logweir.plans import jobs
from logweir.sinks.keyed import KeyedTable
from logweir.session import fresh_folder


def line(second, payload, user="u@n1", month=1):
    return f"- {1000000 + second} 2004.{month:02d}.05 node Jan 05 10:00:00 {user} {payload}"


@pytest.fixture(scope="module")
def log():
    draw = random.Random(4)
    out = []
    for i in range(300):
        payload = "hot payload" if draw.random() < 0.4 else f"kernel: IRQ {draw.randrange(30)}  end"
        out.append((i, "bad" if i % 11 == 0 else line(draw.randrange(50), payload, month=1 + i % 3)))
    return out


@pytest.fixture(scope="module")
def frame(spark, log):
    rows = log[:]
    random.Random(2).shuffle(rows)
    return spark.createDataFrame(rows, "at bigint, line string").repartition(5)


def fields(text):
    parts = text.split(" ", 8)
    return int(parts[1]), int(parts[2].split(".")[1]), parts[8]


def first_by(log, key):
    seen = {}
    for at, text in log:
        if text != "bad":
            seen.setdefault(key(text), (at, text))
    return seen.values()


@pytest.mark.parametrize("mode,key", [("entire_msg", lambda t: t), ("payload_only", lambda t: fields(t)[2])])
@pytest.mark.parametrize("exact", [True, False])
def test_dedup(frame, log, mode, key, exact):
    want = sorted((fields(t)[0] * 1000, at, t) for at, t in first_by(log, key))
    got = [(int(r.key), r.value) for r in jobs.dedup(frame, ["at"], mode, exact).collect()]
    assert got == [(ms, t) for ms, _, t in want]  # in time order, ties by arrival


def test_dedup_by_several_columns(frame, log):
    """The same result when arrival is (part, offset)."""
    split = frame.select((F.col("at") / 100).cast("int").alias("part"), (F.col("at") % 100).alias("off"), "line")
    for mode in ("entire_msg", "payload_only"):
        a = [tuple(r) for r in jobs.dedup(split, ["part", "off"], mode).collect()]
        assert a == [tuple(r) for r in jobs.dedup(frame, ["at"], mode).collect()]


def test_dedup_rejects_unknown_mode(frame):
    with pytest.raises(ValueError):
        jobs.dedup(frame, ["at"], "some")


@pytest.mark.parametrize("unit", ["token", "payload", "line", "key"])
def test_count(frame, log, rows, unit):
    model = {}
    for _, text in log:
        if text == "bad":
            continue
        _, month, payload = fields(text)
        things = {"token": [t for t in payload.split(" ") if t], "payload": [payload], "line": [text],
                  "key": [text[:24]]}[unit]
        model.setdefault((2004, month), set()).update(things)
    got = rows(jobs.count(frame.select("line"), unit))
    assert got == sorted(((y, m, len(s)) for (y, m), s in model.items()), key=repr)
    as_coded = jobs.count(frame.select("line"), unit, date_parts="as_coded")
    assert [(r.year, r.month) for r in as_coded.collect()] == [(2004, 5)]


def test_sketches_stay_within_their_error(spark):
    ids = spark.range(60000).select((F.col("id") % 3).alias("g"), F.col("id").cast("string").alias("unit"))
    sketches = ct.sketch_by(ids, ["g"])
    for row in sketches.select(ct.estimate().alias("e")).collect():
        assert abs(row.e - 20000) <= 3 * ct.SKETCH_ERROR * 20000
    merged = ct.merge_sketches(sketches).select(ct.estimate().alias("e")).head().e
    assert abs(merged - 60000) <= 3 * ct.SKETCH_ERROR * 60000
    again = ct.merge_sketches(sketches.unionByName(sketches)).select(ct.estimate().alias("e")).head().e
    assert again == merged


def test_distinct_overall(frame, log):
    batches = frame.withColumn("batch", (F.col("at") / 100).cast("int"))
    per_batch, overall = jobs.distinct_overall(batches, "batch")
    good = [t for _, t in log if t != "bad"]
    row = overall.head()
    assert (row.attempted, row.parsed) == (300, len(good))
    assert row.approx_distinct == len({fields(t)[2] for t in good})
    assert sum(r.parsed for r in per_batch.collect()) == len(good)


def test_statistics(frame, log):
    good = [t for _, t in log if t != "bad"]
    assert ct.dedup_stats(frame).head() == (300, len({fields(t)[2] for t in good}))


def test_word_conservation(spark):
    words = spark.createDataFrame([(w,) for w in ["a", "b", "a", "", "c"] * 20], "word string")
    counts = jobs.word_count(words)
    assert ct.conservation(counts, words).head() == (100, 100, 0)
    assert ct.conservation(counts.where("word <> 'a'"), words).head() == (100, 60, 40)
    assert ct.conservation(counts.where("false"), words).head() == (100, 0, 100)


def test_random_rows(spark):
    picked = ct.random_rows(spark.range(1000), 5, seed=3).collect()
    assert len({r.id for r in picked}) == 5
    assert picked == ct.random_rows(spark.range(1000), 5, seed=3).collect()


def test_per_batch_distinct(spark, rows):
    data = [(0, "a"), (0, "a"), (1, "a"), (1, "b")]
    out = dd.distinct_per_batch(spark.createDataFrame(data, "batch int, v string"), "batch", ["v"])
    assert rows(out) == [(0, "a"), (1, "a"), (1, "b")]


# ------------------------------------------------------------------ keyed tables


def pairs(spark, *data):
    return spark.createDataFrame(list(data), "at bigint, key string, value string")


def test_keyed_table(spark, rows):
    schema = pairs(spark, (0, "", "")).select("key", "value").schema
    table = KeyedTable(spark, fresh_folder(spark, "t"), schema, "key")
    assert table.current().count() == 0
    first = pairs(spark, (1, "a", "old"), (2, "a", "new"), (3, "b", "b0"), (0, "n", None))
    assert rows(table.with_created(first), "key", "created") == sorted(
        [("a", True), ("a", True), ("b", True), ("n", True)], key=repr)
    table.upsert(first, 0, ["at"])
    table.upsert(pairs(spark, (1, "b", "b1"), (2, "c", "c1")), 1, ["at"])
    want = [("a", "new"), ("b", "b1"), ("c", "c1"), ("n", None)]
    assert rows(table.current()) == want
    # a replayed batch changes nothing, even if an older one comes again
    table.upsert(pairs(spark, (1, "b", "b1"), (2, "c", "c1")), 1, ["at"])
    table.upsert(first, 0, ["at"])
    assert rows(table.current()) == want
    created = table.with_created(pairs(spark, (0, "a", ""), (0, "c", ""), (0, "d", "")), before=1)
    assert rows(created, "key", "created") == [("a", False), ("c", True), ("d", True)]
    small = table.compacted(fresh_folder(spark, "t"))
    assert rows(small.current()) == want and small.history().count() == 4
    small.upsert(pairs(spark, (0, "a", "newest")), 2, ["at"])
    assert rows(small.current().where("key = 'a'")) == [("a", "newest")]
