"""Streams give what the batch jobs give, over several micro-batches, restarts and replays."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from logweir.operators.counting import with_unit
from logweir.operators.parsing import parse_date
from logweir.plans import jobs
from logweir.session import fresh_folder
from logweir.sources.files import read_words
from logweir.streaming import jobs as st
from logweir.streaming.count_windows import DistinctPerCountWindow, MatchesPerCountWindow

from test_windows import model_count_windows

N = 600


def text(i, draw):
    if i % 13 == 0:
        return f"broken {i}"
    word = "hot" if draw.random() < 1 / 3 else f"w{draw.randrange(20)}"
    irq = "IRQ " if draw.random() < 0.3 else ""
    return f"- {1_000_000 + i * 2} 2004.{1 + i // 300:02d}.05 node Jan 05 10:00:00 u@n1 kernel: {irq}{word}"


@pytest.fixture(scope="module")
def log():
    draw = random.Random(8)
    return [(i, text(i, draw)) for i in range(N)]


@pytest.fixture(scope="module")
def batch(spark, log):
    return spark.createDataFrame(log, "at bigint, line string")


@pytest.fixture
def parts(spark, log, tmp_path):
    """The log as a folder of files that a stream reads one per micro-batch, in order."""
    import os
    import time

    cuts = [0, 70, 71, 300, 450, N]

    class Parts:
        folder = str(tmp_path / "in")
        count = 0

        def add(self, upto=len(cuts) - 1):
            os.makedirs(self.folder, exist_ok=True)
            for i in range(self.count, upto):
                path = f"{self.folder}/part{i}.json"
                frame = spark.createDataFrame(log[cuts[i]:cuts[i + 1]], "at bigint, line string")
                frame.toPandas().to_json(path, orient="records", lines=True)
                os.utime(path, (time.time() - 100 + i, time.time() - 100 + i))
            self.count = upto
            return self

        def stream(self):
            reader = spark.readStream.schema("at bigint, line string").option("maxFilesPerTrigger", 1)
            return reader.json(self.folder)

    return Parts()


def drain(spark, stream, mode="append"):
    folder = fresh_folder(spark, "stream-test")
    query = st.append_to(stream, f"{folder}/out", f"{folder}/check", mode)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out"), query


def test_match(spark, parts, batch, rows):
    stream = jobs.match(parts.add().stream().select("line"), processed=F.lit("P"))
    out, _ = drain(spark, stream)
    assert rows(out) == rows(jobs.match(batch.select("line"), processed=F.lit("P")))


@pytest.mark.parametrize("mode,exact", [("entire_msg", True), ("payload_only", False)])
def test_dedup(spark, parts, batch, rows, mode, exact):
    out, _ = drain(spark, st.dedup(parts.add().stream(), mode, exact))
    want = jobs.dedup(batch, ["at"], mode)
    if mode == "entire_msg":
        assert rows(out) == rows(want)
    else:  # which of the equal payloads of one micro-batch is kept is open
        payload = F.substring_index("value", "kernel: ", -1)
        assert rows(out.select(payload)) == rows(want.select(payload))


def test_dedup_within_forgets(spark, parts, rows):
    out, query = drain(spark, st.dedup(parts.add().stream(), "payload_only", within="100 seconds"))
    kept, _ = drain(spark, st.dedup(parts.stream(), "payload_only"))
    assert kept.count() < out.count() < N


def test_per_batch_dedup(spark, parts, log):
    folder = fresh_folder(spark, "per-batch")
    seen = []
    sink = st.per_batch(lambda df, i: seen.append([r.tail for r in df.collect()]), ["tail"])
    tails = parts.add().stream().select(F.substring_index("line", " ", -1).alias("tail"))
    st.each_batch(tails, sink, folder).awaitTermination()
    cuts = [0, 70, 71, 300, 450, N]
    want = [{t.rsplit(" ", 1)[-1] for _, t in log[a:b]} for a, b in zip(cuts, cuts[1:])]
    assert [set(s) for s in seen] == want and all(len(s) == len(set(s)) for s in seen)


def test_time_ordered_batches(spark, parts):
    folder = fresh_folder(spark, "ordered")
    seen = []
    deduped = st.dedup(parts.add().stream(), "entire_msg")
    sink = st.time_ordered(lambda df, i: seen.append([int(r.key) for r in df.collect()]))
    st.each_batch(deduped, sink, folder).awaitTermination()
    assert sum(map(len, seen)) > 500 and all(s == sorted(s) for s in seen)


@pytest.mark.parametrize("unit", ["token", "payload"])
def test_count(spark, parts, batch, rows, unit):
    out, _ = drain(spark, st.first_seen_units(parts.add().stream(), unit))
    assert rows(st.counts_of_first_seen(out)) == rows(jobs.count(batch, unit))


def test_sketches_and_replay(spark, parts, batch):
    folder = fresh_folder(spark, "sketches")
    sink = st.sketch_sink(f"{folder}/out")

    def twice(df, i):  # as after a failure behind the write
        sink(df, i)
        sink(df, i)

    st.each_batch(parts.add().stream(), twice, f"{folder}/check").awaitTermination()
    sketches = spark.read.parquet(f"{folder}/out")
    assert sketches.count() == 5
    _, overall = jobs.distinct_overall(batch.withColumn("b", F.lit(1)), "b")
    totals = st.sketch_totals(sketches)
    assert totals.select("approx_distinct", "parsed", "attempted").head() == overall.select(
        "approx_distinct", "parsed", "attempted").head()


def test_time_match(spark, parts, batch, rows):
    out, _ = drain(spark, st.time_match(parts.add().stream(), "10 minutes", processed=F.lit("P")))
    assert rows(out) == rows(jobs.time_match(batch, processed=F.lit("P")))


@pytest.mark.parametrize("length,slide", [(60, 20)])
def test_time_count(spark, parts, batch, rows, length, slide):
    out, _ = drain(spark, st.time_count(parts.add().stream(), "30 seconds", length, slide))
    newest = 1_000_000 + (N - 1) * 2
    closed = jobs.time_count(batch, length, slide).where(F.unix_seconds("window_end") <= newest - 30)
    assert closed.count() > 5 and rows(out) == rows(closed)


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    import os
    import time

    os.makedirs(tmp_path / "in")
    for i, second in enumerate((1000, 5000, 6000, 1001)):  # the limit for late rows follows one batch behind
        path = tmp_path / "in" / f"{i}.txt"
        path.write_text(f"- {second} 2004.01.05 node Jan 05 10:00:00 u@n1 kernel: w{i}\n")
        os.utime(path, (time.time() - 100 + i,) * 2)
    lines = spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in")).withColumnRenamed("value", "line")
    out, query = drain(spark, st.time_count(lines, "10 seconds", 10, 10, "payload"))
    assert [r.n_distinct for r in out.where(F.unix_seconds("window_start") == 1000).collect()] == [1]
    dropped = sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
    assert dropped >= 1


def test_words_running(spark, tmp_path, rows):
    import os

    os.makedirs(tmp_path / "in")
    for i in range(3):
        (tmp_path / "in" / f"{i}.txt").write_text(",".join(["a", "b", "a"] * (i + 1)))
    words = read_words(spark, str(tmp_path / "in"), streaming=True, max_files_per_trigger=1)
    query = (st.word_count(words).writeStream.outputMode("complete").format("memory").queryName("words")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    assert rows(spark.table("words")) == [("a", 12), ("b", 6)]


def test_new_links(spark, tmp_path, rows):
    import json
    import os

    os.makedirs(tmp_path / "in")
    for i, page in enumerate(['<a href="a.zip">', '<a href="a.zip"><a href="b.zip">']):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"html": page}))
    stream = spark.readStream.schema("html string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out, _ = drain(spark, st.new_links(stream))
    assert rows(out, "link") == [("a.zip",), ("b.zip",)]


# ------------------------------------------------------------------ count windows


def payloads(placed):
    return with_unit(parse_date(placed), "payload")


@pytest.mark.parametrize("length,slide,emit", [(50, 50, "full"), (90, 40, "next_record"), (20, 70, "next_record")])
def test_count_window_stream(spark, parts, log, rows, length, slide, emit):
    folder = fresh_folder(spark, "windows")
    sink = DistinctPerCountWindow(spark, f"{folder}/w", ["at"], length, slide, emit, units=payloads)
    runs = []

    def replaying(df, i):
        runs.append(i)
        sink(df, i)
        if i == 2:  # as after a failure behind the writes
            sink(df, i)

    # two runs: the second goes on from the checkpoint
    st.each_batch(parts.add(3).stream(), replaying, f"{folder}/check").awaitTermination()
    st.each_batch(parts.add().stream(), replaying, f"{folder}/check").awaitTermination()
    assert runs == [0, 1, 2, 3, 4]
    model = model_count_windows([t for _, t in log], length, slide, emit)
    want = []
    for k, held in model.items():
        units = [t.split(" ", 8)[8] for t in held if not t.startswith("broken")]
        if units:
            want.append((k, len(set(units)), len(units)))
    assert rows(sink.results(), "window_id", "n_distinct", "n_rows") == sorted(want, key=repr)


@pytest.mark.parametrize("length, slide", [(80, 80), (80, 30), (30, 50)])
def test_match_window_stream(spark, parts, batch, log, rows, length, slide):
    folder = fresh_folder(spark, "windows")
    sink = MatchesPerCountWindow(spark, f"{folder}/w", ["at"], length, slide)
    st.each_batch(parts.add().stream(), sink, f"{folder}/check").awaitTermination()
    model = model_count_windows([t for _, t in log], length, slide, "next_record")
    want = {(k, t) for k, held in model.items() for t in held if "IRQ" in t and not t.startswith("broken")}
    assert rows(sink.results(), "window_id", "line") == sorted(want, key=repr)
    assert sink.results().columns == ["window_id", "line", "key", "value"]


def test_keyed_window_stream(spark, parts, log, rows):
    """Windows per key, as each instance of a partitioned job counts its own rows."""
    folder = fresh_folder(spark, "windows")
    source = parts.add().stream().withColumn("part", (F.col("at") % 3).cast("int"))
    distinct = DistinctPerCountWindow(spark, f"{folder}/d", ["at"], 30, 12, units=payloads, keys={"part": "int"})
    matches = MatchesPerCountWindow(spark, f"{folder}/m", ["at"], 30, emit="full", keys={"part": "int"})

    def both(df, i):
        distinct(df, i)
        matches(df, i)

    st.each_batch(source, both, f"{folder}/check").awaitTermination()
    counts, lines = [], set()
    for part in range(3):
        mine = [t for i, t in log if i % 3 == part]
        for k, held in model_count_windows(mine, 30, 12, "next_record").items():
            units = [t.split(" ", 8)[8] for t in held if not t.startswith("broken")]
            counts.append((k, part, len(set(units)), len(units)))
        for k, held in model_count_windows(mine, 30, 30, "full").items():
            lines |= {(k, part, t) for t in held if "IRQ" in t and not t.startswith("broken")}
    assert rows(distinct.results(), "window_id", "part", "n_distinct", "n_rows") == sorted(counts, key=repr)
    assert rows(matches.results(), "window_id", "part", "line") == sorted(lines, key=repr)


def test_batches_leave_no_index_behind(spark, parts):
    """The tables of a batch's row index are deleted with the batch."""
    import glob

    from logweir.session import shared_folder

    root = shared_folder(spark).removeprefix("file:")
    kept = lambda: len(glob.glob(f"{root}/logweir/row-index-*")) + len(glob.glob(f"{root}/logweir/row-shifts-*"))
    before = kept()
    folder = fresh_folder(spark, "windows")
    sink = MatchesPerCountWindow(spark, f"{folder}/w", ["at"], 20, 10)
    st.each_batch(parts.add().stream(), sink, f"{folder}/check").awaitTermination()
    assert kept() == before


def test_first_seen_within(spark, parts, rows):
    folder = fresh_folder(spark, "within")
    firsts = st.first_seen_units(parts.add().stream(), within="3650 days")
    st.append_to(firsts, f"{folder}/out", f"{folder}/check").awaitTermination()
    held = spark.read.schema(firsts.schema).parquet(f"{folder}/out")
    assert held.count() == held.distinct().count() > 0


def test_registered_streams_cross_batches(spark):
    from checks import lines as L

    stream = L.streamed_events(spark, "/root/testdata/sf0.001")
    seen = []
    folder = fresh_folder(spark, "batches")
    st.each_batch(stream, lambda batch, batch_id: seen.append(batch.count()), f"{folder}/check").awaitTermination()
    assert len([n for n in seen if n]) >= 4 and sum(seen) == L.events(spark, "/root/testdata/sf0.001").count()


def test_batch_read_of_the_latest_offset(spark):
    from logweir.sources.messages import read_log

    with pytest.raises(ValueError):
        read_log(spark, {"startingOffsets": "latest"}, streaming=False)
