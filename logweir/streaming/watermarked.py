"""Streams whose output waits for a watermark: rows in time order, and dense windows.

Structured Streaming closes windows only where rows are, and hands on rows as they come.
These sinks for ``foreachBatch`` keep what is still open in files. The watermark is the
newest time seen, less ``delay``; it moves from batch to batch, is stored with the state,
and a batch that is replayed reads the state from before it and leaves the same again.
"""

from __future__ import annotations

from collections.abc import Callable
from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import panes as P
from ..operators.windows import MICROS, floor_div, micros
from ..session import drop_paths, written_table
from ..sinks.generations import Generations


class _Watermarked:
    def __init__(self, spark: SparkSession, folder: str, delay: float):
        self.spark, self.folder, self.delay = spark, folder, micros(delay)
        self.marks = Generations(spark, f"{folder}/marks", "seen bigint, mark bigint, due bigint")

    def _mark(self, batch_id: int) -> tuple[int | None, int | None, int | None]:
        """Newest time, watermark and next window as they were before a batch."""
        row = self.marks.read(batch_id).first()
        return tuple(row) if row else (None, None, None)

    def _moved(self, batch_id: int, seen: int | None, due: int | None) -> None:
        mark = None if seen is None else seen - self.delay
        frame = self.spark.createDataFrame([(seen, mark, due)], self.marks.schema)
        self.marks.put(frame, batch_id, whole=True)

    def _put(self, df: DataFrame, what: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{what}/batch_id={batch_id}")


class TimeOrdered(_Watermarked):
    """Rows in time order over all batches: a row is held back until the watermark has
    passed its time, then released with all others before it. ``out`` gets a folder per
    batch, sorted by time and ``order`` with ``place`` in it; rows that come when their time
    has been released go to ``late``. ``finish`` releases the rest once the stream has ended.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, time: Callable[[], Column], order: list[str], delay: float):
        super().__init__(spark, folder, delay)
        self.time, self.order, self.schema = time, order, schema
        self.buffer = Generations(spark, f"{folder}/buffer", f"{schema}, __t bigint")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        made: list[str] = []
        names = self.spark.createDataFrame([], self.schema).columns
        new = written_table(batch.select(*names, self.time().alias("__t")), "time-ordered", made)
        seen, released, _ = self._mark(batch_id)
        top = new.agg(F.max("__t")).first()[0]
        seen = max((x for x in (seen, top) if x is not None), default=None)
        known = F.col("__t").isNotNull()
        late = ~known if released is None else ~known | (F.col("__t") < released)
        self._put(new.where(late).drop("__t"), "late", batch_id)
        pool = self.buffer.read(batch_id).unionByName(new.where(~late))
        mark = -(2**63) if seen is None else seen - self.delay
        self._release(pool.where(F.col("__t") < mark), batch_id)
        self.buffer.put(pool.where(F.col("__t") >= mark), batch_id, whole=True)
        self._moved(batch_id, seen, None)
        drop_paths(self.spark, made)

    def _release(self, rows: DataFrame, batch_id: int) -> None:
        ordered = rows.orderBy("__t", *self.order).drop("__t")
        self._put(ordered.withColumn("place", F.monotonically_increasing_id()), "out", batch_id)

    def finish(self) -> None:
        last = max([*self.buffer.numbers("whole"), -1])
        self._release(self.buffer.read(last + 1), last + 1)

    def results(self) -> DataFrame:
        """The released rows with batch_id and place, which give their order."""
        return self.spark.read.schema(f"{self.schema}, place bigint, batch_id bigint").parquet(f"{self.folder}/out")

    def late(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, batch_id bigint").parquet(f"{self.folder}/late")


class DenseTimeWindows(_Watermarked):
    """Mergeable aggregates of every window from the first one with a row on, also of windows
    without rows, each reported once the watermark has passed its end. State is one row of
    partial aggregates per open pane. ``late`` counts the rows that were too late for some
    of their windows' panes."""

    def __init__(
        self, spark: SparkSession, folder: str, ts: str, length: float, slide: float | None = None,
        aggs: dict[str, P.Mergeable] | None = None, delay: float = 0, offset: float = 0,
    ):
        super().__init__(spark, folder, delay)
        self.ts, self.aggs = ts, aggs or {"n": P.counted()}
        self.length, self.slide, self.offset = micros(length), micros(length if slide is None else slide), micros(offset)
        self.pane = gcd(self.length, self.slide)
        self.state: Generations | None = None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        made: list[str] = []
        length, slide = self.length // self.pane, self.slide // self.pane
        pane = floor_div(F.unix_micros(self.ts) - self.offset, self.pane)
        told = P.pane_parts(batch.where(F.col(self.ts).isNotNull()), pane, self.aggs | {"__rows": P.counted(), "__top": P.most(F.unix_micros(self.ts))})
        new = written_table(told, "dense-panes", made)
        *parts, rows, top = new.columns[1:]
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in new.schema if f.name not in (rows, top))
        self.state = Generations(self.spark, f"{self.folder}/panes", fields)
        seen, _, stored = self._mark(batch_id)
        due = stored  # the first window that is not reported yet; none before the first report
        newest = new.agg(F.max(top)).first()[0]
        seen = max((x for x in (seen, newest) if x is not None), default=None)
        open_ = F.lit(True) if due is None else F.col("__pane") >= due * slide
        self._put(new.where(~open_).agg(F.coalesce(F.sum(rows), F.lit(0)).alias("rows")), "late", batch_id)
        panes = P.same_panes_merged(self.state.read(batch_id).unionByName(new.where(open_).select("__pane", *parts)), self.aggs)
        panes = written_table(panes, "dense-panes", made)
        if due is None:
            low = panes.agg(F.min("__pane")).first()[0]
            due = None if low is None else (low - length) // slide + 1 if slide < length else low // slide
        closed = None if seen is None or due is None else (seen - self.delay - self.offset - self.length) // self.slide + 1  # first window that stays open
        if closed is not None and closed > due:
            windows = P.merged_panes(panes, length, slide, self.aggs).where(F.col("window_id").between(due, closed - 1))
            blocks = self.spark.range(due, closed, 10_000).select(F.col("id").alias("__b")).repartition("__b")
            spine = blocks.select(F.explode(F.sequence("__b", F.least(F.col("__b") + 9_999, F.lit(closed - 1)))).alias("window_id"))
            start = F.col("window_id") * self.slide + self.offset
            dense = P.finished(spine.join(windows, "window_id", "left"), self.aggs, ["window_id"])
            out = dense.select(F.timestamp_micros(start).alias("window_start"), F.timestamp_micros(start + self.length).alias("window_end"), *self.aggs)
            self._put(out, "out", batch_id)
            panes = panes.where(F.col("__pane") >= closed * slide)
            stored = closed
        self.state.put(panes, batch_id, whole=True)
        self._moved(batch_id, seen, stored)
        drop_paths(self.spark, made)

    def results(self) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.folder}/out").parquet(f"{self.folder}/out").drop("batch_id")

    def late(self) -> DataFrame:
        """batch_id and the rows that came too late in it."""
        return self.spark.read.parquet(f"{self.folder}/late")
