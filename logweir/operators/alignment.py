"""Put tables side by side: by position or by second.

Both are one grouped pass over the union of the inputs instead of a chain of
full outer joins, whose merged key would have to be shuffled again per table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .metrics import (
    HARDWARE_COLUMNS, LATENCY_COLUMNS, THROUGHPUT_COLUMNS, hardware_aggs, hardware_report,
    latency_aggs, throughput_aggs,
)
from .ordering import with_row_index

_SOURCE = "__source"


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def zip_by_position(
    tables: dict[str, DataFrame], order: list[str], stop: str | None = None
) -> DataFrame:
    """Row t of every table side by side; see ``zip_sources``."""
    tagged = [df.withColumn(_SOURCE, F.lit(label)) for label, df in tables.items()]
    columns = {label: df.columns for label, df in tables.items()}
    return zip_sources(_union(tagged), _SOURCE, columns, order, stop)


def zip_sources(
    rows: DataFrame, source: str, columns: dict[str, list[str]], order: list[str], stop: str | None = None
) -> DataFrame:
    """Rows of several sources in one frame, row t of each side by side.

    ``columns`` lists the columns of each source; they come out prefixed with the
    source. A source that has run out shows nulls. ``stop="second_longest"`` ends
    with the first row in which at most one source still has data, so the tail of
    the longest is cut (a single source keeps one row).
    """
    if stop not in (None, "second_longest"):
        raise ValueError(f"unknown stop {stop!r}")
    placed = with_row_index(rows, order, [source])
    if stop:
        placed = _cut(placed, len(columns))
    side = {
        label: F.first(F.when(F.col(source) == label, F.struct(*names)), ignorenulls=True)
        for label, names in columns.items()
    }
    wide = placed.groupBy("row_idx").agg(*[c.alias(label) for label, c in side.items()])
    return wide.select(
        "row_idx",
        *[F.col(f"`{label}`")[c].alias(f"{label}_{c}") for label, names in columns.items() for c in names],
    )


def _cut(rows: DataFrame, n_tables: int) -> DataFrame:
    """Keep rows 0..r, r being the row count of the second-longest table, and
    make sure that row r is there even if no table reaches it."""
    if n_tables == 1:
        return rows.where(F.col("row_idx") == 0)
    # one row per table, at most; an empty table has none and counts 0
    lengths = F.sort_array(F.collect_list("row_total"), asc=False)
    r = (
        rows.where("row_idx = 0")
        .agg(F.coalesce(F.try_element_at(lengths, F.lit(2)), F.lit(0)).alias("r"))
    )
    closing = r.select(F.col("r").alias("row_idx"))
    return rows.where(F.col("row_idx") <= r.scalar()).unionByName(closing, allowMissingColumns=True)


def align_by_second(
    latency: DataFrame, throughput: DataFrame, hardware: DataFrame, order: list[str]
) -> DataFrame:
    """Parsed metric lines of all three kinds, rolled up and joined on the second."""
    rows = _union([
        latency.select("second", *LATENCY_COLUMNS),
        throughput.select("second", *THROUGHPUT_COLUMNS),
        hardware.select("second", *order, "cpu1", "cpu5", "total_mem", "free_mem"),
    ])
    wide = rows.groupBy("second").agg(*latency_aggs(), *throughput_aggs(), *hardware_aggs(order))
    report = hardware_report()
    return wide.select(
        "second", *LATENCY_COLUMNS, *THROUGHPUT_COLUMNS,
        *[report[c].alias(c) for c in HARDWARE_COLUMNS],
    )
