"""Count windows over a stream.

Structured Streaming has no window by number of rows, so each micro-batch is
numbered on from the last one and what open windows still need is kept as a
small table per batch. Every write goes to a folder named by the batch id and
overwrites it: a batch that is replayed gives the same state and output.
"""

from __future__ import annotations

from collections.abc import Callable
from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import event_value, message_key
from ..functions.patterns import MATCH_LITERAL
from ..operators.ordering import with_row_index
from ..operators.parsing import matching
from ..operators.windows import distinct_over_panes, floor_div
from ..plans.jobs import now_text
from ..session import drop_paths

_DONE, _DUE = "__done", "__due"


class _CountedStream:
    """Numbering and state shared by the count-window sinks, for ``foreachBatch``.

    ``keys`` (name -> type) makes windows per key, for instance per log
    partition; without it they run over the whole stream.
    """

    state_columns: str

    def __init__(
        self, spark: SparkSession, folder: str, order: list[str], length: int,
        slide: int | None = None, emit: str = "next_record", keys: dict[str, str] | None = None,
    ):
        if emit not in ("next_record", "full"):
            raise ValueError(f"unknown emit {emit!r}")
        self.spark, self.folder, self.order = spark, folder, order
        self.length, self.slide, self.emit = length, slide or length, emit
        self.keys = dict(keys or {})

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        names, made = list(self.keys), []
        placed = with_row_index(self.project(batch), self.order, names, owned=made)
        old = self._read(self._totals_schema, "rows", batch_id - 1).select(
            *names, F.col("after").alias("before"), F.lit(0).cast("bigint").alias("n")
        )
        new = placed.groupBy(*names).agg(F.lit(0).cast("bigint").alias("before"), F.max("row_total").alias("n"))
        totals = old.unionByName(new).groupBy(*names).agg(
            F.coalesce(F.sum("before"), F.lit(0)).alias("before"),
            F.coalesce(F.sum(F.col("before") + F.col("n")), F.lit(0)).alias("after"),
        )
        self._put(totals, "rows", batch_id)
        counts = self._read(self._totals_schema, "rows", batch_id)
        # parsed and reduced once; the windows of this batch and the state of the
        # next are both read from what is written here
        kept = self._numbered(self._read(self._state_schema, "state", batch_id - 1), counts)
        fresh = self._numbered(placed, counts).withColumn("row_idx", F.col("row_idx") + F.col("__before"))
        merged = self.merge(self.still_open(kept), fresh)
        self._put(merged, "state", batch_id)
        state = self._numbered(self._read(self._state_schema, "state", batch_id), counts)
        due = (F.col("window_id") >= F.col(_DONE)) & (F.col("window_id") < F.col(_DUE))
        self._put(self.closed(state, due), "out", batch_id)
        self._forget(batch_id - 2)
        drop_paths(self.spark, made)  # the batch's own index; nothing reads it again

    def _numbered(self, df: DataFrame, counts: DataFrame) -> DataFrame:
        """Add the rows before this batch and how many windows were and are reported."""
        if self.keys:
            on = [F.col(f"d.{k}").eqNullSafe(F.col(f"c.{k}")) for k in self.keys]
            rows = df.alias("d").join(counts.alias("c"), on).select("d.*", "c.before", "c.after")
        else:
            before, after = counts.select("before", "after").head()  # one row
            rows = df.withColumn("before", F.lit(before)).withColumn("after", F.lit(after))
        return rows.select(
            *df.columns,
            F.col("before").cast("bigint").alias("__before"),
            self._reported(F.col("before")).alias(_DONE),
            self._reported(F.col("after")).alias(_DUE),
        )

    def _reported(self, rows: Column) -> Column:
        """How many windows are reported once ``rows`` rows have come."""
        ready = rows.cast("bigint") - self.length - (1 if self.emit == "next_record" else 0)
        return F.greatest(F.lit(0).cast("bigint"), floor_div(ready, self.slide) + 1)

    @property
    def _totals_schema(self) -> str:
        return ", ".join([*[f"{k} {t}" for k, t in self.keys.items()], "before bigint, after bigint"])

    @property
    def _state_schema(self) -> str:
        return ", ".join([*[f"{k} {t}" for k, t in self.keys.items()], self.state_columns])

    def _put(self, df: DataFrame, what: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{what}/batch_id={batch_id}")

    def _read(self, schema: str, what: str, batch_id: int) -> DataFrame:
        if batch_id < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{what}/batch_id={batch_id}")

    def _forget(self, batch_id: int) -> None:
        """State older than the last two batches is never read again."""
        if batch_id < 0:
            return
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for what in ("state", "rows"):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{what}/batch_id={batch_id}")
            path.getFileSystem(conf).delete(path, True)

    def results(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/out").drop("batch_id")

    def project(self, batch: DataFrame) -> DataFrame:
        return batch

    def merge(self, state: DataFrame, placed: DataFrame) -> DataFrame:
        """State of open windows and the numbered rows of the batch as new state."""
        raise NotImplementedError

    def closed(self, state: DataFrame, due: Column) -> DataFrame:
        """The windows that this batch closes."""
        raise NotImplementedError

    def still_open(self, state: DataFrame) -> DataFrame:
        """What windows not reported so far need."""
        raise NotImplementedError


class DistinctPerCountWindow(_CountedStream):
    """Exact distinct ``unit`` and rows per window of messages.

    ``units`` turns numbered messages into rows with a ``unit`` text column (and
    their ``row_idx``). State is one row per (key, pane, unit) of open windows.
    """

    state_columns = "unit string, __pane bigint, __n bigint"

    def __init__(self, *args, units: Callable[[DataFrame], DataFrame], **kwargs):
        super().__init__(*args, **kwargs)
        self.units = units
        self.pane = gcd(self.length, self.slide)

    def merge(self, state, placed):
        names = list(self.keys)
        pane = floor_div(F.col("row_idx"), self.pane).alias("__pane")
        new = self.units(placed).select(
            *names, F.col("unit").cast("string"), pane, F.lit(1).cast("bigint").alias("__n")
        )
        cells = state.select(new.columns).unionByName(new)
        return cells.groupBy(*names, "unit", "__pane").agg(F.sum("__n").alias("__n"))

    def closed(self, state, due):
        ends = F.struct(F.col(_DONE).alias("done"), F.col(_DUE).alias("due"))
        inside = (F.col("window_id") >= F.col("__ends.done")) & (F.col("window_id") < F.col("__ends.due"))
        return distinct_over_panes(
            state.withColumn("__ends", ends), self.length // self.pane, self.slide // self.pane, "unit",
            list(self.keys), rows="n_rows", weight=F.col("__n"), first_id=0, total="__ends", keep=inside,
        )

    def still_open(self, state):
        return state.where(F.col("__pane") >= F.col(_DONE) * (self.slide // self.pane))


class MatchesPerCountWindow(_CountedStream):
    """The set of matching lines in each window of messages, with the key and value
    of the match job. State is the matching lines of open windows; lines are reduced
    to one per pane before windows that overlap are unrolled."""

    state_columns = "line string, row_idx bigint"

    def __init__(
        self, *args, literal: str = MATCH_LITERAL, scope: str = "payload", processed: Column | None = None,
        key: str = "xxhash64", **kwargs,
    ):
        super().__init__(*args, **kwargs)
        self.literal, self.scope, self.processed, self.key = literal, scope, processed, key

    def project(self, batch):
        text = F.when(F.col("line").contains(self.literal), F.col("line")).alias("line")
        return batch.select(*dict.fromkeys([*self.keys, *self.order]), text)

    def merge(self, state, placed):
        new = matching(placed.where(F.col("line").isNotNull()), self.literal, self.scope)
        columns = [*self.keys, "line", "row_idx"]
        return state.select(columns).unionByName(new.select(columns))

    def closed(self, state, due):
        pane = gcd(self.length, self.slide)
        start = floor_div(F.col("row_idx"), pane) * pane
        cells = state.select(*self.keys, "line", start.alias("__start"), _DONE, _DUE).distinct()
        # windows that hold the pane and are reported with this batch
        first = F.greatest(F.col(_DONE), floor_div(F.col("__start") + pane - self.length + self.slide - 1, self.slide))
        last = F.least(F.col(_DUE) - 1, floor_div(F.col("__start"), self.slide))
        ids = F.when(first <= last, F.sequence(first, F.greatest(first, last)))
        rows = cells.select(*self.keys, "line", F.explode(ids).alias("window_id")).distinct()
        processed = now_text() if self.processed is None else self.processed
        return matching(rows, self.literal, self.scope).select(
            "window_id", *self.keys, "line", message_key("line", self.key).alias("key"), event_value(processed).alias("value")
        )

    def still_open(self, state):
        return state.where(F.col("row_idx") >= F.col(_DONE) * self.slide)
