"""Time windows and count windows: tumbling, sliding and gapped.

A window of ``length`` opens every ``slide``; slide above length leaves gaps.
Windows are half open and, for time, aligned to the epoch plus ``offset``.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written_table
from .ordering import with_given_index, with_row_index

MICROS = 1_000_000
_PANE, _CHUNK = "__pane", "__chunk"
_BITS = 63  # panes in a bitmap; the sign bit stays free
_CHUNK_WINDOWS = 64  # window lengths per chunk; the overlap repeats 1/64 of the cells


def micros(seconds: float) -> int:
    return round(seconds * MICROS)


def floor_div(n: Column, by: int) -> Column:
    """Whole division rounding down, on integers throughout."""
    return F.call_function("div", n - F.pmod(n, F.lit(by)), F.lit(by))


# ------------------------------------------------------------------ time windows


def time_slot(ts: str, length: float, slide: float | None = None, offset: float = 0) -> Column:
    """The window struct(start, end) of a time, in seconds; slide <= length."""
    step = f"{micros(slide or length)} microseconds"
    return F.window(ts, f"{micros(length)} microseconds", step, f"{micros(offset)} microseconds")


def in_time_windows(
    df: DataFrame, ts: str, length: float, slide: float | None = None, offset: float = 0
) -> DataFrame:
    """Rows with ``window_start`` and ``window_end``, once per window they lie in."""
    slide = length if slide is None else slide
    if slide <= length:
        slotted = df.withColumn("__w", time_slot(ts, length, slide, offset))
        start, end = F.col("__w.start"), F.col("__w.end")
    else:  # gapped: drop the rows between windows, then tumble by the slide
        past = F.pmod(F.unix_micros(ts) - micros(offset), F.lit(micros(slide)))
        slotted = df.where(past < micros(length)).withColumn("__w", time_slot(ts, slide, slide, offset))
        start = F.col("__w.start")
        end = F.timestamp_micros(F.unix_micros(start) + micros(length))
    return slotted.select(*df.columns, start.alias("window_start"), end.alias("window_end"))


def time_window(
    df: DataFrame,
    ts: str,
    length: float,
    slide: float | None = None,
    aggs: dict[str, Column] | None = None,
    keys: list[str] = (),
    offset: float = 0,
    emit_empty: bool = False,
) -> DataFrame:
    """Aggregate ``aggs`` (name -> aggregate column) per window and key."""
    slide = length if slide is None else slide
    aggs = aggs or {"n": F.count("*")}
    windows = in_time_windows(df, ts, length, slide, offset)
    out = windows.groupBy("window_start", "window_end", *keys).agg(
        *[c.alias(n) for n, c in aggs.items()]
    )
    if not emit_empty:
        return out
    return with_empty_windows(out, length, slide, offset, keys)


def with_empty_windows(
    out: DataFrame, length: float, slide: float, offset: float = 0, keys: list[str] = ()
) -> DataFrame:
    """Add the windows that hold no rows, between the first and the last that do (of the
    same key, if there are keys).

    The result has one row per window, so it is stored once and read for both
    its bounds and its rows. The list of windows is spread out in blocks before
    it is unrolled: a long span with a short slide is not built by one task.
    """
    len_us, slide_us, off_us = micros(length), micros(slide), micros(offset)
    stored = written_table(out, "windows")
    place = floor_div(F.unix_micros("window_start") - off_us, slide_us)
    bounds = stored.groupBy(*keys).agg(F.min(place).alias("__lo"), F.max(place).alias("__hi"))
    spine = (
        bounds.where("__lo is not null")
        .select(*keys, "__hi", F.expr("explode(sequence(__lo, __hi, 10000l))").alias("__b"))
        .repartition(*keys, "__b")
        .select(*keys, F.expr("explode(sequence(__b, least(__b + 9999, __hi)))").alias("__k"))
        .select(*keys, F.timestamp_micros(F.col("__k") * slide_us + off_us).alias("window_start"))
    )
    end = F.timestamp_micros(F.unix_micros("e.window_start") + len_us)
    on = F.col("e.window_start") == F.col("w.window_start")
    for k in keys:  # null keys form a group too
        on = on & F.col(f"e.{k}").eqNullSafe(F.col(f"w.{k}"))
    rest = [c for c in out.columns if not c.startswith("window_")]
    return spine.alias("e").join(stored.alias("w"), on, "left").select(
        "e.window_start", end.alias("window_end"), *[F.col(f"e.{c}" if c in keys else f"w.{c}") for c in rest]
    )


def distinct_in_time_windows(
    df: DataFrame,
    ts: str,
    length: float,
    slide: float | None = None,
    unit: str = "unit",
    keys: list[str] = (),
    offset: float = 0,
    rows: str | None = None,
) -> DataFrame:
    """Exact distinct ``unit`` per window (and key), without copying rows per window."""
    slide = length if slide is None else slide
    len_us, slide_us, off_us = micros(length), micros(slide), micros(offset)
    pane_us = gcd(len_us, slide_us)
    pane = floor_div(F.unix_micros(ts) - off_us, pane_us)
    out = distinct_over_panes(
        df.select(*keys, unit, pane.alias(_PANE)),
        len_us // pane_us, slide_us // pane_us, unit, keys, rows=rows,
    )
    start = F.col("window_id") * slide_us + off_us
    return out.select(
        F.timestamp_micros(start).alias("window_start"),
        F.timestamp_micros(start + len_us).alias("window_end"),
        *[c for c in out.columns if c != "window_id"],
    )


# ----------------------------------------------------------------- count windows


def indexed(df: DataFrame, order: list[str], partition_by: list[str] = (), given: bool = False) -> DataFrame:
    """Rows with ``row_idx`` and ``row_total``; ``given`` trusts a gapless order column."""
    if given:
        if len(order) != 1:
            raise ValueError("a given index is one order column")
        return with_given_index(df, order[0], partition_by)
    return with_row_index(df, order, partition_by)


def _complete(window_id: Column, length: int, slide: int, emit: str) -> Column:
    """Whether a window is reported: when full, or only once one more row came."""
    if emit not in ("next_record", "full"):
        raise ValueError(f"unknown emit {emit!r}")
    end = window_id * slide + length
    return end < F.col("row_total") if emit == "next_record" else end <= F.col("row_total")


def in_count_windows(
    rows: DataFrame, length: int, slide: int | None = None, emit: str = "next_record"
) -> DataFrame:
    """Indexed rows with ``window_id``, once per reported window they lie in."""
    slide = length if slide is None else slide
    i = F.col("row_idx")
    last = floor_div(i, slide)
    if slide >= length:  # at most one window per row
        out = rows.where(i % slide < length).withColumn("window_id", last)
    else:
        first = F.greatest(F.lit(0).cast("bigint"), floor_div(i - length, slide) + 1)
        out = rows.withColumn("window_id", F.explode(F.sequence(first, last)))
    return out.where(_complete(F.col("window_id"), length, slide, emit))


def count_window(
    df: DataFrame,
    order: list[str],
    length: int,
    slide: int | None = None,
    aggs: dict[str, Column] | None = None,
    partition_by: list[str] = (),
    emit: str = "next_record",
    given: bool = False,
) -> DataFrame:
    """Aggregate ``aggs`` per window of ``length`` rows in arrival order.

    Window k holds rows [k*slide, k*slide+length); partial windows are never
    reported.
    """
    aggs = aggs or {"n": F.count("*")}
    rows = in_count_windows(indexed(df, order, partition_by, given), length, slide, emit)
    return rows.groupBy("window_id", *partition_by).agg(*[c.alias(n) for n, c in aggs.items()])


def distinct_in_count_windows(
    rows: DataFrame,
    length: int,
    slide: int | None = None,
    unit: str = "unit",
    keys: list[str] = (),
    emit: str = "next_record",
    count: str | None = None,
) -> DataFrame:
    """Exact distinct ``unit`` per reported window of indexed rows."""
    slide = length if slide is None else slide
    pane_rows = gcd(length, slide)
    pane = floor_div(F.col("row_idx"), pane_rows)
    cells = rows.select(*keys, unit, pane.alias(_PANE), "row_total")
    return distinct_over_panes(
        cells, length // pane_rows, slide // pane_rows, unit, keys, rows=count, first_id=0,
        total="row_total", keep=_complete(F.col("window_id"), length, slide, emit),
    )


# ------------------------------------------------------------------------- panes


def distinct_over_panes(
    df: DataFrame,
    length: int,
    slide: int,
    unit: str,
    keys: list[str] = (),
    rows: str | None = None,
    weight: Column | None = None,
    first_id: int | None = None,
    total: str | None = None,
    keep: Column | None = None,
    out: str = "n_distinct",
) -> DataFrame:
    """Distinct ``unit`` (and, if ``rows`` names it, rows) per window of ``length``
    panes, one window every ``slide`` panes. Null units count nowhere.

    Windows without overlap are plain groups. Overlapping ones are never built
    by copying rows into each window: short ones go by bitmap, others (and those
    that also count rows) by look-back.
    """
    df = df.where(F.col(unit).isNotNull())
    n_rows = F.sum(weight) if weight is not None else F.count("*")
    if slide >= length:
        held = df.where(F.pmod(F.col(_PANE), F.lit(slide)) < length) if slide > length else df
        windows = held.withColumn("window_id", floor_div(F.col(_PANE), slide))
        if first_id is not None:
            windows = windows.where(F.col("window_id") >= first_id)
        if keep is not None:
            windows = windows.where(keep)
        counted = [F.count_distinct(unit).alias(out)] + ([n_rows.alias(rows)] if rows else [])
        return windows.groupBy("window_id", *keys).agg(*counted)
    per_block = (_BITS - length) // slide + 1
    if not rows and length - slide <= per_block * slide // 2:
        return _distinct_by_bitmap(df, length, slide, per_block, unit, keys, first_id, total, keep, out)
    return _distinct_by_look_back(df, length, slide, unit, keys, rows, n_rows, first_id, total, keep, out)


def _distinct_by_bitmap(df, length, slide, per_block, unit, keys, first_id, total, keep, out):
    """Per unit and block of ``per_block`` windows, one 64-bit map of the panes
    the unit occurs in: one shuffle, combined on the map side. A window holds
    the unit if any of its bits is set; those are summed per block.
    """
    pane = F.col(_PANE)
    span = per_block * slide  # panes from one block to the next
    oldest = floor_div(pane - length, slide) + 1
    if first_id is not None:
        oldest = F.greatest(F.lit(first_id).cast("bigint"), oldest)
    newest = floor_div(pane, slide)
    blocks = F.sequence(floor_div(oldest, per_block), floor_div(newest, per_block))
    # with a first window, panes before it lie in no window
    placed = df.select("*", F.explode(F.when(oldest <= newest, blocks)).alias("__block"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (pane - F.col("__block") * span).cast("int"))
    totals = [F.max(total).alias(total)] if total else []
    maps = placed.groupBy(*keys, unit, "__block").agg(F.bit_or(bit).alias("__map"), *totals)
    masks = [((1 << length) - 1) << (j * slide) for j in range(per_block)]
    # one text for all windows of a block: cheaper to analyse than as many columns
    held = ", ".join(f"count(case when (__map & {m}l) <> 0 then 1 end)" for m in masks)
    counts = maps.groupBy(*keys, "__block").agg(F.expr(f"array({held})").alias("__counts"), *totals)
    windows = counts.select(
        *keys, *([total] if total else []), "__block", F.posexplode("__counts").alias("__j", out)
    ).withColumn("window_id", F.col("__block") * per_block + F.col("__j"))
    windows = windows.where(F.col(out) > 0)
    if first_id is not None:
        windows = windows.where(F.col("window_id") >= first_id)
    if keep is not None:
        windows = windows.where(keep)
    return windows.select("window_id", *keys, out)


def _distinct_by_look_back(df, length, slide, unit, keys, rows, n_rows, first_id, total, keep, out):
    """Rows shrink to cells (key, unit, pane) first. In each window a unit counts
    once, at its first pane there: the window must start after the pane where
    the unit was seen before. So cells are never compared across windows, and
    what is unrolled per window is summed on the map side before it moves.

    The look-back is at most one window long. Cells are therefore cut along the
    pane axis into chunks, each with a copy of the last window of panes before
    it, and a unit that occurs in every pane is spread over many tasks.
    """
    lead = [*keys, *([total] if total else [])]
    cells = df.groupBy(*lead, unit, _PANE).agg(n_rows.alias("__rows"))
    chunk = length * _CHUNK_WINDOWS
    home = floor_div(F.col(_PANE), chunk)
    ahead = floor_div(F.col(_PANE) + (length - 1), chunk)
    spread = cells.withColumn(_CHUNK, F.explode(F.sequence(home, ahead)))
    seen = Window.partitionBy(*lead, unit, _CHUNK).orderBy(_PANE)
    looked = spread.withColumn("__prev", F.lag(_PANE).over(seen)).where(home == F.col(_CHUNK))
    pane = F.col(_PANE)
    last = floor_div(pane, slide)
    oldest = pane - length
    if not rows:  # only windows in which this pane is the unit's first
        oldest = F.greatest(oldest, F.coalesce(F.col("__prev"), oldest))
    first = floor_div(oldest, slide) + 1
    if first_id is not None:
        first = F.greatest(F.lit(first_id).cast("bigint"), first)
    ids = F.when(first <= last, F.sequence(first, last))
    unrolled = looked.select(*lead, "__prev", "__rows", F.explode(ids).alias("window_id"))
    if keep is not None:
        unrolled = unrolled.where(keep)
    fresh = F.col("__prev").isNull() | (F.col("__prev") < F.col("window_id") * slide)
    aggs = [F.count_if(fresh).alias(out)]
    if rows:
        aggs.append(F.sum("__rows").alias(rows))
    return unrolled.groupBy("window_id", *keys).agg(*aggs)


def emit_windows(
    windows: DataFrame, window: str, keys: list[str] = (), value: Column | None = None
) -> DataFrame:
    """Closed windows as messages: the window (and keys) as key, and ``value``,
    by default the rest as JSON."""
    rest = [c for c in windows.columns if c != window]
    key = F.concat_ws("/", F.col(window).cast("string"), *[F.col(k).cast("string") for k in keys])
    body = F.to_json(F.struct(*rest)) if value is None else value
    return windows.select(key.alias("key"), body.alias("value"))
