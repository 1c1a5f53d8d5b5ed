from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from logweir.operators.parsing import parse_event
from logweir.session import fresh_folder
from logweir.streaming.counters import StreamCounters, observed

LINE = "- {s} 2004.01.05 node Jan 05 10:00:00 u@n1 kernel: é{s}"


@pytest.fixture
def counters(spark):
    made = StreamCounters("lines")
    spark.streams.addListener(made)
    yield made
    spark.streams.removeListener(made)


def batches(spark, *parts):
    """A stream with one micro-batch for each list of (offset, line)."""
    folder = fresh_folder(spark, "lines")
    for rows in parts:
        spark.createDataFrame(rows, "offset bigint, line string").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema("offset bigint, line string").option("maxFilesPerTrigger", 1).parquet(folder)


def run(stream, out, checkpoint):
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def test_counts_of_each_batch(spark, counters, tmp_path, rows):
    """Two queries of one listener are kept apart; a restart goes on with the next batch."""
    parts = [[(5, LINE.format(s=1)), (6, "torn"), (7, None)], [(8, "")]]
    stream = batches(spark, *parts)
    first = run(observed(stream, "lines", parse_event).select("offset"), str(tmp_path / "a"), str(tmp_path / "ca"))
    again = run(observed(stream, "lines", parse_event).select("offset"), str(tmp_path / "b"), str(tmp_path / "cb"))
    run(stream, str(tmp_path / "c"), str(tmp_path / "cc"))
    for query in (first, again):
        counters.wait(query.runId)
        size = len(LINE.format(s=1).encode()) + 4
        assert rows(counters.table(spark, query.id)) == [(0, 3, size, 5, 7, 1, 0), (1, 1, 0, 8, 8, 0, 0)]
    assert {q for q, _ in counters.batches} == {str(first.id), str(again.id)}
    assert spark.read.parquet(str(tmp_path / "a")).count() == 1


def test_one_pass(spark):
    """The metrics add no scan and no second parser to the plan."""
    stream = spark.createDataFrame([(1, LINE.format(s=1))], "offset bigint, line string")
    plan = observed(stream, "lines", parse_event).select("offset")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("CollectMetrics") == 2 and plan.count("Generate explode") == 1 and "Exchange" not in plan


def test_late_rows_are_counted(spark, counters, tmp_path):
    parts = [[(i, LINE.format(s=s))] for i, s in enumerate((1000, 5000, 6000, 1001))]
    timed = observed(batches(spark, *parts), "lines", parse_event).withColumn("at", F.timestamp_seconds(F.regexp_extract("line", r"^- (\d+)", 1).cast("bigint")))
    once = timed.withWatermark("at", "10 seconds").dropDuplicatesWithinWatermark(["line"]).select("offset")
    query = run(once, str(tmp_path / "out"), str(tmp_path / "check"))
    counters.wait(query.runId)
    table = counters.table(spark, query.id)
    assert table.agg(F.sum("parsed"), F.sum("late")).first() == (4, 1)
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2]


def test_an_end_that_never_comes(counters):
    with pytest.raises(TimeoutError):
        counters.wait("unknown", seconds=0.01)
