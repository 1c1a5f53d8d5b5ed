"""Sliding windows of mergeable aggregates, without copying rows into windows.

Rows are first reduced to panes of gcd(length, slide): one partial aggregate per pane,
combined on the map side. Panes are cut into blocks as long as a window. Within a block,
running aggregates from its start (prefixes) and from its end (suffixes) merge each pane
twice; a window is the suffix of one block and the prefix of the next. So a pane is merged
a fixed number of times however many windows hold it, and the only thing unrolled per
window are its (at most) two parts. Panes without rows do not exist: a suffix serves all
window starts back to the pane before it, a prefix all window ends up to the next.

Sums of doubles are added in another order than over rows. A distinct count is not
mergeable: ``windows.distinct_in_*`` are exact, ``sketched`` is approximate.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import gcd

from pyspark.sql import Column, DataFrame, Window, functions as F

from .counting import SKETCH_BITS
from .windows import _complete, floor_div, indexed, micros

_PANE, _BLOCK = "__pane", "__block"


@dataclass(frozen=True)
class Mergeable:
    """An aggregate in parts: ``parts`` over rows, ``merges`` over the columns that hold
    those parts, and ``finish`` of the merged parts (by default the only part)."""

    parts: tuple[Column, ...]
    merges: tuple[Callable[[str], Column], ...]
    finish: Callable[..., Column] = lambda part: part


def counted(value: Column | str = "*") -> Mergeable:
    """Rows, or those in which ``value`` is not null."""
    return Mergeable((F.count(value),), (F.sum,), lambda n: F.coalesce(n, F.lit(0)))


def total(value: Column | str) -> Mergeable:
    return Mergeable((F.sum(value),), (F.sum,))


def least(value: Column | str) -> Mergeable:
    return Mergeable((F.min(value),), (F.min,))


def most(value: Column | str) -> Mergeable:
    return Mergeable((F.max(value),), (F.max,))


def mean(value: Column | str) -> Mergeable:
    return Mergeable((F.sum(value), F.count(value)), (F.sum, F.sum), lambda s, n: F.when(n > 0, s / n))


def spread(value: Column | str) -> Mergeable:
    """Population standard deviation, by the sums of the powers."""
    x = (F.col(value) if isinstance(value, str) else value).cast("double")

    def finish(n: Column, s: Column, q: Column) -> Column:
        return F.when(n > 0, F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0))))

    return Mergeable((F.count(x), F.sum(x), F.sum(x * x)), (F.sum, F.sum, F.sum), finish)


def last_of(value: str, order: str) -> Mergeable:
    """The value of the row that is last in ``order``."""
    return Mergeable((F.max(F.struct(order, value)),), (F.max,), lambda part: part[value])


def either(condition: Column) -> Mergeable:
    """Whether any row meets the condition."""
    return Mergeable((F.bool_or(condition),), (F.bool_or,))


def sketched(value: Column | str, bits: int = SKETCH_BITS) -> Mergeable:
    """Approximate distinct values; parts are sketches."""
    return Mergeable((F.hll_sketch_agg(value, bits),), (F.hll_union_agg,), F.hll_sketch_estimate)


def over_panes(
    rows: DataFrame, pane: Column, length: int, slide: int, aggs: dict[str, Mergeable], keys: list[str] = (),
    first_id: int | None = None, keep: Column | None = None, carried: dict[str, Column] | None = None,
) -> DataFrame:
    """``window_id`` (window k: panes k*slide to k*slide+length-1), keys and ``aggs`` of
    every window that holds a row. ``carried``: columns that are equal in all rows of a
    key, for ``keep``, a condition over window_id and them."""
    aggs = aggs | {name: Mergeable((F.max(c),), (F.max,)) for name, c in (carried or {}).items()}
    if slide >= length:  # a row lies in at most one window
        inside = rows.withColumn(_PANE, pane).where(F.pmod(F.col(_PANE), F.lit(slide)) < length)
        merged = inside.groupBy(*keys, floor_div(F.col(_PANE), slide).alias("window_id")).agg(*_parts(aggs))
    else:
        merged = merged_panes(pane_parts(rows, pane, aggs, keys), length, slide, aggs, keys)
    out = finished(merged, aggs, ["window_id", *keys])
    if first_id is not None:
        out = out.where(F.col("window_id") >= first_id)
    if keep is not None:
        out = out.where(keep)
    return out.drop(*(carried or {}))


def _names(aggs: dict[str, Mergeable]) -> dict[str, list[str]]:
    return {name: [f"__{k}_{i}" for i in range(len(agg.parts))] for k, (name, agg) in enumerate(aggs.items())}


def _parts(aggs: dict[str, Mergeable]) -> list[Column]:
    names = _names(aggs)
    return [p.alias(n) for name, agg in aggs.items() for p, n in zip(agg.parts, names[name])]


def _merges(aggs: dict[str, Mergeable]) -> list[tuple[Callable[[str], Column], str]]:
    names = _names(aggs)
    return [(m, n) for name, agg in aggs.items() for m, n in zip(agg.merges, names[name])]


def pane_parts(rows: DataFrame, pane: Column, aggs: dict[str, Mergeable], keys: list[str] = ()) -> DataFrame:
    """keys, __pane and the parts of every pane that holds a row."""
    return rows.groupBy(*keys, pane.alias(_PANE)).agg(*_parts(aggs))


def same_panes_merged(panes: DataFrame, aggs: dict[str, Mergeable], keys: list[str] = ()) -> DataFrame:
    """One row per pane, of parts that several batches told of it."""
    return panes.groupBy(*keys, _PANE).agg(*[m(n).alias(n) for m, n in _merges(aggs)])


def finished(merged: DataFrame, aggs: dict[str, Mergeable], kept: list[str]) -> DataFrame:
    names = _names(aggs)
    return merged.select(*kept, *[agg.finish(*[F.col(n) for n in names[name]]).alias(name) for name, agg in aggs.items()])


def merged_panes(panes: DataFrame, length: int, slide: int, aggs: dict[str, Mergeable], keys: list[str] = ()) -> DataFrame:
    """window_id, keys and merged parts of every window that holds one of the panes."""
    merges = _merges(aggs)
    if slide >= length:
        inside = panes.where(F.pmod(F.col(_PANE), F.lit(slide)) < length)
        return inside.groupBy(*keys, floor_div(F.col(_PANE), slide).alias("window_id")).agg(*[m(n).alias(n) for m, n in merges])
    panes = panes.withColumn(_BLOCK, floor_div(F.col(_PANE), length))
    block = Window.partitionBy(*keys, _BLOCK)
    up, down = block.orderBy(F.asc(_PANE)), block.orderBy(F.desc(_PANE))
    so_far = (Window.unboundedPreceding, Window.currentRow)
    at, first = F.col(_PANE), F.col(_BLOCK) * length
    both = panes.select(
        *keys, _PANE, _BLOCK,
        F.struct(*[m(n).over(up.rowsBetween(*so_far)).alias(n) for m, n in merges]).alias("__prefix"),
        F.struct(*[m(n).over(down.rowsBetween(*so_far)).alias(n) for m, n in merges]).alias("__suffix"),
        F.coalesce(F.lead(_PANE).over(up), first + length).alias("__next"), F.coalesce(F.lag(_PANE).over(up), first - 1).alias("__before"),
    )
    # windows that start after the pane before this one, and at this one at the latest
    starts = _multiples(F.col("__before") + 1, at, slide)
    # windows that end at this pane or later, before the next one, and start in the block before
    ends = _multiples(at - (length - 1), F.least(F.col("__next") - 1, first + length - 2) - (length - 1), slide)
    served = F.array(F.struct(starts.alias("ids"), F.col("__suffix").alias("part")), F.struct(ends.alias("ids"), F.col("__prefix").alias("part")))
    unrolled = both.select(*keys, F.explode(served).alias("s")).select(*keys, F.explode("s.ids").alias("window_id"), "s.part.*")
    return unrolled.groupBy(*keys, "window_id").agg(*[m(n).alias(n) for m, n in merges])


def _multiples(low: Column, high: Column, by: int) -> Column:
    """The numbers k with low <= k * by <= high."""
    a, b = -floor_div(-low, by), floor_div(high, by)
    return F.when(a <= b, F.sequence(a, b))


def sliding_count_window(
    df: DataFrame, order: list[str], length: int, slide: int | None = None, aggs: dict[str, Mergeable] | None = None,
    partition_by: list[str] = (), emit: str = "next_record", given: bool = False,
) -> DataFrame:
    """``windows.count_window`` for mergeable aggregates: full windows of ``length`` rows."""
    slide = length if slide is None else slide
    rows, pane = indexed(df, order, partition_by, given), gcd(length, slide)
    return over_panes(
        rows, floor_div(F.col("row_idx"), pane), length // pane, slide // pane, aggs or {"n": counted()}, partition_by, first_id=0,
        keep=_complete(F.col("window_id"), length, slide, emit), carried={"row_total": F.col("row_total")},
    )


def sliding_time_window(
    df: DataFrame, ts: str, length: float, slide: float | None = None, aggs: dict[str, Mergeable] | None = None,
    keys: list[str] = (), offset: float = 0,
) -> DataFrame:
    """``windows.time_window`` for mergeable aggregates."""
    len_us, slide_us, off_us = micros(length), micros(length if slide is None else slide), micros(offset)
    pane_us = gcd(len_us, slide_us)
    pane = floor_div(F.unix_micros(ts) - off_us, pane_us)
    out = over_panes(df.where(F.col(ts).isNotNull()), pane, len_us // pane_us, slide_us // pane_us, aggs or {"n": counted()}, keys)
    start = F.col("window_id") * slide_us + off_us
    return out.select(
        F.timestamp_micros(start).alias("window_start"), F.timestamp_micros(start + len_us).alias("window_end"),
        *[c for c in out.columns if c != "window_id"],
    )
