"""Approximate distinct counts over sliding windows, from a dyadic tree of sketches.

A level-j node is the mergeable sketch of 2**j panes. A window is the union of at most two
nodes per level, those that lie in it while their parents do not, so it merges a number of
sketches that grows with the logarithm of its length, and the tree serves windows of any
length and slide over the same panes. A pane's sketch goes into its ancestors in one
shuffle, combined on the map side; then every node is sent to the windows it is part of,
at most 2**j of them, which again are combined before they move. Rows are never copied.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, functions as F

from .counting import SKETCH_BITS, estimate
from .panes import _multiples
from .windows import _complete, floor_div, micros

_LEVEL, _NODE = "level", "node"


def sketch_nodes(rows: DataFrame, pane: Column, longest: int, unit: str = "unit", keys: list[str] = (), bits: int = SKETCH_BITS) -> DataFrame:
    """level, node, keys and sketch of every node that holds a row and covers at most
    ``longest`` panes."""
    panes = rows.groupBy(*keys, pane.alias("__pane")).agg(F.hll_sketch_agg(unit, bits).alias("sketch"))
    levels = F.sequence(F.lit(0), F.lit(max(0, longest.bit_length() - 1)))
    ancestors = panes.select(*keys, "__pane", "sketch", F.explode(levels).alias(_LEVEL))
    node = F.call_function("shiftright", F.col("__pane"), F.col(_LEVEL))
    return ancestors.groupBy(*keys, _LEVEL, node.alias(_NODE)).agg(F.hll_union_agg("sketch").alias("sketch"))


def windows_of_nodes(nodes: DataFrame, length: int, slide: int, keys: list[str] = ()) -> DataFrame:
    """window_id, keys and sketch of each window of ``length`` panes, every ``slide``."""
    size = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col(_LEVEL))
    start, end = F.col(_NODE) * size, (F.col(_NODE) + 1) * size
    left = F.pmod(F.col(_NODE), F.lit(2)) == 0
    # window starts that hold the node: from end - length to start; those that hold its parent too take that
    parent_fits = 2 * size <= length
    low = F.when(parent_fits & ~left, start - size + 1).otherwise(end - length)
    high = F.when(parent_fits & left, end + size - length - 1).otherwise(start)
    served = nodes.where(size <= length).select(*keys, "sketch", F.explode(_multiples(low, high, slide)).alias("window_id"))
    return served.groupBy("window_id", *keys).agg(F.hll_union_agg("sketch").alias("sketch"))


def sketched_in_time_windows(
    df: DataFrame, ts: str, length: float, slide: float | None = None, unit: str = "unit", keys: list[str] = (), offset: float = 0,
    bits: int = SKETCH_BITS, out: str = "approx_distinct",
) -> DataFrame:
    """Approximate distinct ``unit`` per time window (and key); null units count nowhere."""
    len_us, slide_us, off_us = micros(length), micros(length if slide is None else slide), micros(offset)
    pane_us = gcd(len_us, slide_us)
    pane = floor_div(F.unix_micros(ts) - off_us, pane_us)
    rows = df.where(F.col(unit).isNotNull() & F.col(ts).isNotNull())
    nodes = sketch_nodes(rows, pane, len_us // pane_us, unit, keys, bits)
    windows = windows_of_nodes(nodes, len_us // pane_us, slide_us // pane_us, keys)
    start = F.col("window_id") * slide_us + off_us
    return windows.select(
        F.timestamp_micros(start).alias("window_start"), F.timestamp_micros(start + len_us).alias("window_end"), *keys, estimate().alias(out)
    )


def sketched_in_count_windows(
    rows: DataFrame, length: int, slide: int | None = None, unit: str = "unit", keys: list[str] = (), emit: str = "next_record",
    bits: int = SKETCH_BITS, out: str = "approx_distinct",
) -> DataFrame:
    """Approximate distinct ``unit`` per reported window of indexed rows (``windows.indexed``).

    A key's number of rows is equal in all of them, so it can be one of the keys."""
    slide = length if slide is None else slide
    pane_rows = gcd(length, slide)
    by = [*keys, "row_total"]
    held = rows.where(F.col(unit).isNotNull())
    nodes = sketch_nodes(held, floor_div(F.col("row_idx"), pane_rows), length // pane_rows, unit, by, bits)
    windows = windows_of_nodes(nodes, length // pane_rows, slide // pane_rows, by)
    windows = windows.where((F.col("window_id") >= 0) & _complete(F.col("window_id"), length, slide, emit))
    return windows.select("window_id", *keys, estimate().alias(out))
