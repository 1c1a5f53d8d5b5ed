"""Streaming forms of the jobs.

Stateless jobs (match, link extraction) are the batch functions given a stream.
What needs state across micro-batches is here. Exact state grows with the number
of distinct values unless a watermark bounds it, so every form that keeps such
state takes ``within``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import message_key, event_value
from ..functions.patterns import MATCH_LITERAL
from ..operators import counting, links
from ..operators.bloom import BloomTable
from ..operators.parsing import matching, parse_date, parse_dated, parse_payload
from ..operators.windows import MICROS, micros, time_slot
from ..plans.jobs import now_text


_ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def use_rocksdb(spark: SparkSession) -> None:
    """Keep streaming state on disk with incremental checkpoints, not on the heap."""
    for name, value in _ROCKSDB.items():
        spark.conf.set(name, value)


@contextmanager
def on_rocksdb(spark: SparkSession) -> Iterator[None]:
    """``use_rocksdb`` for the streams started inside; the session's settings come back."""
    before = {name: spark.conf.get(name, None) for name in _ROCKSDB}
    use_rocksdb(spark)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def dedup(
    stream: DataFrame, mode: str = "entire_msg", exact: bool = True, line: str = "line",
    within: str | None = None,
) -> DataFrame:
    """First arrivals of a stream: key is the event time in ms, value the line.

    State holds one text per distinct message, or its 64-bit hash if not exact.
    ``within`` forgets a message that late after its event time.
    """
    parsed = parse_payload(stream.select(line), line, anchored=True)
    text = {"entire_msg": line, "payload_only": "msg"}[mode]
    if not exact:
        parsed, text = parsed.withColumn("__h", F.xxhash64(text)), "__h"
    if within:
        timed = parsed.withColumn("ts", F.timestamp_seconds("epoch_s")).withWatermark("ts", within)
        unique = timed.dropDuplicatesWithinWatermark([text])
    else:
        unique = parsed.dropDuplicates([text])
    return unique.select(
        (F.col("epoch_s") * 1000).cast("string").alias("key"), F.col(line).alias("value")
    )


def bloom_dedup_sink(
    table: BloomTable, out: str, order: list[str], mode: str = "entire_msg", line: str = "line",
) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: approximate ``dedup`` whose state is a Bloom filter of a fixed
    size. Messages that pass (key, value) go to a folder of ``out`` for each micro-batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        parsed = parse_payload(batch.select(*order, line), line, anchored=True)
        text = {"entire_msg": line, "payload_only": "msg"}[mode]
        passed = table.admit(parsed, batch_id, text, order, ["epoch_s", line])
        message = passed.select((F.col("epoch_s") * 1000).cast("string").alias("key"), F.col(line).alias("value"))
        message.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return write


def per_batch(write: Callable[[DataFrame, int], None], cols: list[str]) -> Callable:
    """For ``foreachBatch``: hands on the distinct rows of each micro-batch."""
    return lambda batch, batch_id: write(batch.select(*cols).dropDuplicates(cols), batch_id)


def time_ordered(write: Callable[[DataFrame, int], None]) -> Callable:
    """For ``foreachBatch``: hands on each micro-batch of (key, value) rows in time
    order, the key being the event time."""
    return lambda batch, batch_id: write(batch.orderBy(F.col("key").cast("bigint")), batch_id)


def first_seen_units(
    stream: DataFrame, unit: str = "token", line: str = "line", date_parts: str = "year_month",
    within: str | None = None,
) -> DataFrame:
    """Every (year, month, unit) once, when first seen. Append it to a table: the
    running distinct count is a plain count of the rows of that table.

    ``within`` forgets a unit that late after its event time; a unit that comes back
    later is a new row, and the table has to be counted by distinct unit."""
    cols = ["year", "month", "unit"]
    if not within:
        return counting.dated_units(stream, unit, line, date_parts).dropDuplicates(cols)
    if date_parts != "year_month":
        raise ValueError("within needs the months of the event's own date")
    timed = counting.with_unit(parse_dated(stream.select(line), line), unit, line).select("ts", *cols)
    return timed.withWatermark("ts", within).dropDuplicatesWithinWatermark(cols).select(cols)


def counts_of_first_seen(table: DataFrame) -> DataFrame:
    return table.groupBy("year", "month").agg(F.count("unit").alias("n_distinct"))


def sketch_sink(path: str, line: str = "line") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: one row per micro-batch with its sketch and line
    counts. A replayed batch overwrites its row."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        report = counting.sketch_report(rows, "batch_id", line).drop("batch_id")
        report.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def sketch_totals(sketches: DataFrame) -> DataFrame:
    """Distinct overall and line totals of the sketches stored so far."""
    return sketches.agg(
        counting.estimate(F.hll_union_agg("sketch")).alias("approx_distinct"),
        F.sum("parsed").alias("parsed"),
        F.sum("attempted").alias("attempted"),
    )


def time_match(
    stream: DataFrame, delay: str, length: float = 10, literal: str = MATCH_LITERAL,
    scope: str = "payload", line: str = "line", processed=None, key: str = "xxhash64",
    slide: float | None = None,
) -> DataFrame:
    """The set of matches of each window; sets are forgotten once the watermark,
    ``delay`` behind the newest event, has passed their window."""
    events = matching(stream.select(line), literal, scope, line).withWatermark("ts", delay)
    slotted, _ = _in_slots(events, length, slide)
    return slotted.dropDuplicates(["window", line]).select(
        F.col("window.start").alias("window_start"),
        message_key(line, key).alias("key"),
        event_value(now_text() if processed is None else processed).alias("value"),
    )


def time_count(
    stream: DataFrame, delay: str, length: float = 10, slide: float = 1, unit: str = "token",
    line: str = "line",
) -> DataFrame:
    """Exact distinct units per closed window (append mode).

    Keyed states, one entry per (window, unit) and one per window, instead of one
    growing set per window. Where windows overlap, units are reduced to one per pane
    before they are copied to the windows that hold the pane.
    """
    units = counting.with_unit(parse_dated(stream.select(line), line), unit, line).select("ts", "unit")
    units = units.withWatermark("ts", delay)
    if slide < length:
        pane = gcd(micros(length), micros(slide)) / MICROS
        panes = units.withColumn("pane", time_slot("ts", pane)).dropDuplicates(["pane", "unit"])
        units = panes.select(F.window_time("pane").alias("ts"), "unit")
    slotted, end = _in_slots(units, length, slide)
    once = slotted.dropDuplicates(["window", "unit"])
    return once.groupBy("window").agg(F.count("unit").alias("n_distinct")).select(
        F.col("window.start").alias("window_start"), end.alias("window_end"), "n_distinct"
    )


def _in_slots(events: DataFrame, length: float, slide: float | None) -> tuple[DataFrame, Column]:
    """Events with their ``window``, and the column of its end. Gapped windows tumble by
    their slide, which also decides when they close, after the rows between windows
    have been left out."""
    if slide is None or slide <= length:
        return events.withColumn("window", time_slot("ts", length, slide)), F.col("window.end")
    inside = events.where(F.pmod(F.unix_micros("ts"), F.lit(micros(slide))) < micros(length))
    return inside.withColumn("window", time_slot("ts", slide)), F.timestamp_micros(F.unix_micros("window.start") + micros(length))


def word_count(stream: DataFrame, word: str = "word") -> DataFrame:
    """Running count per word (complete or update mode)."""
    return counting.count_by_key(stream, word)


def new_links(
    stream: DataFrame, pattern: str = links.ARCHIVE, html: str = "html", within: str | None = None, ts: str = "ts",
) -> DataFrame:
    """Links not seen before on the stream: link_key, link. ``within`` forgets a link
    that late after the time ``ts`` of its page."""
    if within:
        timed = links.page_links(stream.withWatermark(ts, within), html, pattern, keep=[ts])
        return timed.dropDuplicatesWithinWatermark(["link_key"]).select("link_key", "link")
    found = links.page_links(stream, html, pattern)
    return found.select("link_key", "link").dropDuplicates(["link_key"])


def append_to(
    stream: DataFrame, path: str, checkpoint: str, mode: str = "append", available_now: bool = True
) -> StreamingQuery:
    """Run a stream into parquet files."""
    writer = (
        stream.writeStream.outputMode(mode).format("parquet")
        .option("path", path).option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def each_batch(
    stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str,
    available_now: bool = True, mode: str = "append",
) -> StreamingQuery:
    """Run a stream into a ``foreachBatch`` sink."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
