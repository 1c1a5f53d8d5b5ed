"""Counters of a stream, taken in the same pass as the work on it.

``observed`` puts metrics before and after the parser, so nothing is read or parsed twice.
``StreamCounters`` is a listener that keeps them per micro-batch; a batch that is replayed
replaces its counts. Metrics ride on the tasks of the batch, so a ``foreachBatch`` sink must
run one action on its batch, or store it first (``written_table``): a second action would be
counted too.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener

COUNTS = "batch_id bigint, attempted bigint, bytes bigint, first_offset bigint, last_offset bigint, parsed bigint, late bigint"


def observed(stream: DataFrame, name: str, parse: Callable[[DataFrame], DataFrame], line: str = "line", offset: str = "offset") -> DataFrame:
    """The parsed rows of a stream or table. On the way messages, their bytes and offsets
    are counted, and behind the parser the rows that are left."""
    read = stream.observe(
        f"{name}-read", F.count("*").alias("attempted"), F.coalesce(F.sum(F.octet_length(line)), F.lit(0)).cast("bigint").alias("bytes"),
        F.min(offset).cast("bigint").alias("first_offset"), F.max(offset).cast("bigint").alias("last_offset"),
    )
    return parse(read).observe(f"{name}-parsed", F.count("*").alias("parsed"))


class StreamCounters(StreamingQueryListener):
    """Counts of ``observed`` streams by query and batch. ``late`` is what Spark's stateful
    operators dropped behind the watermark: rows, or groups of rows where an aggregate
    combined them before; none where no operator keeps state."""

    def __init__(self, name: str) -> None:
        self.name = name
        self.batches: dict[tuple[str, int], dict[str, int | None]] = {}
        self.ended: dict[str, threading.Event] = {}

    def onQueryStarted(self, event) -> None:
        self.ended.setdefault(str(event.runId), threading.Event())

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        read, parsed = (progress.observedMetrics.get(f"{self.name}-{part}") for part in ("read", "parsed"))
        if read is None or parsed is None or not read["attempted"]:
            return  # another stream, or a batch without rows
        late = sum(operator.numRowsDroppedByWatermark for operator in progress.stateOperators)
        self.batches[str(progress.id), progress.batchId] = read.asDict() | parsed.asDict() | {"late": late}

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.setdefault(str(event.runId), threading.Event()).set()

    def wait(self, run_id: str, seconds: float = 60) -> None:
        """Until the events of a query that has stopped have come: they arrive behind it."""
        if not self.ended.setdefault(str(run_id), threading.Event()).wait(seconds):
            raise TimeoutError(f"no end of query {run_id} after {seconds} s")

    def table(self, spark: SparkSession, query_id: str) -> DataFrame:
        """One row per batch of a query."""
        names = [f.split()[0] for f in COUNTS.split(", ")]
        rows = [{"batch_id": b} | counts for (q, b), counts in sorted(self.batches.items()) if q == str(query_id)]
        return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], COUNTS)
