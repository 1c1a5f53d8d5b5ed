from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from logweir.operators import panes as P
from logweir.streaming.watermarked import DenseTimeWindows, TimeOrdered


def batches(seed: int, n: int = 5, each: int = 60, jitter: int = 30) -> list[list[tuple]]:
    r = random.Random(seed)
    return [[(k * each + i, (k * each + i) * 2 + r.randrange(-jitter, jitter)) for i in range(each)] for k in range(n)]


@pytest.mark.parametrize("delay,seed", [(200, 1), (20, 2), (0, 3)])
def test_rows_in_time_order(spark, tmp_path, delay, seed):
    sink = TimeOrdered(spark, str(tmp_path), "id bigint, t bigint", lambda: F.col("t") * 1_000_000, ["id"], delay)
    want, late, held, mark = [], [], [], None
    seen = -(10**9)
    parts = batches(seed)
    parts.insert(2, [])
    parts[1].append((999, None))
    for k, rows in enumerate(parts):
        for _ in range(2):  # replayed
            sink(spark.createDataFrame(rows, "id bigint, t bigint"), k)
        late += [x for x in rows if x[1] is None or (mark is not None and x[1] < mark)]
        held += [x for x in rows if not (x[1] is None or (mark is not None and x[1] < mark))]
        seen = max([seen, *(t for _, t in rows if t is not None)])
        mark = seen - delay
        want += sorted((x for x in held if x[1] < mark), key=lambda x: (x[1], x[0]))
        held = [x for x in held if x[1] >= mark]
    sink.finish()
    want += sorted(held, key=lambda x: (x[1], x[0]))
    got = [(r["id"], r["t"]) for r in sorted(sink.results().collect(), key=lambda r: (r["batch_id"], r["place"]))]
    assert got == want and [t for _, t in got] == sorted(t for _, t in got)
    assert sorted((r["id"] for r in sink.late().collect())) == sorted(i for i, _ in late)
    assert delay > 0 or len(late) > 10


@pytest.mark.parametrize("length,slide,delay", [(10, 10, 60), (12, 5, 60), (5, 20, 60), (10, 10, 0)])
def test_dense_windows(spark, tmp_path, length, slide, delay):
    r = random.Random(length)
    times = [sorted(r.sample(range(40), 12)), sorted(r.sample(range(30, 70), 9)), [], [300, 301, 290], [1000, 250]]
    aggs = {"n": P.counted(), "top": P.most("x"), "mean": P.mean("x")}
    sink = DenseTimeWindows(spark, str(tmp_path), "ts", length, slide, aggs, delay)
    kept, closed = [], None
    for k, ts in enumerate(times):
        frame = spark.createDataFrame([(t, t % 7) for t in ts] + [(None, 1)], "t bigint, x int").withColumn("ts", F.timestamp_seconds("t"))
        for _ in range(2):
            sink(frame, k)
    everything = [t for ts in times for t in ts]
    first = min((w for w in range(-10, 300) if any(w * slide <= t < w * slide + length for t in times[0])))
    last = (1000 - delay - length) // slide
    got = sorted((x["s"], x["n"], x["top"], x["mean"]) for x in sink.results().withColumn("s", F.unix_seconds("window_start")).collect())
    assert [g[0] for g in got] == [w * slide for w in range(first, last + 1)]
    if delay:  # nothing is late: every window is that of all rows
        for s, n, top, mean in got:
            held = [t % 7 for t in everything if s <= t < s + length]
            assert (n, top, mean) == (len(held), max(held, default=None), sum(held) / len(held) if held else None)
        assert sum(x["rows"] for x in sink.late().collect()) == 0
    else:
        assert sum(x["rows"] for x in sink.late().collect()) > 0
