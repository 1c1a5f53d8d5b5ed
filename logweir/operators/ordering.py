"""Arrival order: a global or per-key row index that no single task computes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import written_table

_CHUNK, _POS, _SHIFT = "__chunk", "__pos", "__shift"
_POS_BITS = (1 << 33) - 1  # low bits of monotonically_increasing_id: place in the partition


def with_row_index(
    df: DataFrame,
    order: list[str],
    partition_by: list[str] = (),
    index: str = "row_idx",
    total: str = "row_total",
    owned: list[str] | None = None,
) -> DataFrame:
    """Number rows 0, 1, ... in ``order`` (a total order) and add their total,
    over the whole frame or within each ``partition_by`` group.

    Rows are range-partitioned and sorted on (group, order), so a hot group is
    cut across tasks like any other range, and written once with their place.
    A second, pruned pass counts rows per (range, group); the running sum of
    those counts, one row per range and group, gives the shift to join back.
    The shifts are stored as well, so their size is known when the join is planned:
    Spark's own check broadcasts them and the rows stay where they are; should they
    be too many, it joins by shuffle. ``owned`` takes the paths of both tables, for
    callers that delete them.
    """
    keys = list(partition_by)
    sort_by = [*keys, *order]
    placed = written_table(
        df.repartitionByRange(*sort_by)
        .sortWithinPartitions(*sort_by)
        .withColumn(_CHUNK, F.spark_partition_id())
        .withColumn(_POS, F.monotonically_increasing_id().bitwiseAND(F.lit(_POS_BITS))),
        "row-index",
        owned,
    )
    spans = placed.groupBy(_CHUNK, *keys).agg(F.min(_POS).alias("__first"), F.count("*").alias("__n"))
    within = Window.partitionBy(*keys)
    before = within.orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    shifts = written_table(spans.select(
        _CHUNK,
        *keys,
        (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias(_SHIFT),
        F.sum("__n").over(within).alias(total),
    ), "row-shifts", owned)
    on = F.col(f"p.{_CHUNK}") == F.col(f"s.{_CHUNK}")
    for k in keys:  # null keys form a group too
        on = on & F.col(f"p.{k}").eqNullSafe(F.col(f"s.{k}"))
    return (
        placed.alias("p")
        .join(shifts.alias("s"), on)
        .select(
            *[F.col(f"p.{c}") for c in df.columns],
            (F.col(f"p.{_POS}") + F.col(f"s.{_SHIFT}")).alias(index),
            F.col(f"s.{total}"),
        )
    )


def with_given_index(
    df: DataFrame,
    offset: str,
    partition_by: list[str] = (),
    index: str = "row_idx",
    total: str = "row_total",
) -> DataFrame:
    """The same two columns where ``offset`` already numbers the rows of each
    ``partition_by`` group without gaps or repeats, like the offsets within the
    partitions of a log: no sort, and only one row per group is shuffled. The spans
    of groups are stored, so that their size is known when they are joined back and
    small ones are broadcast. The query fails if a range of offsets does not fit its
    row count.
    """
    keys = list(partition_by)
    span = F.struct(F.min(offset).alias("lo"), F.max(offset).alias("hi"), F.count("*").alias("n"))
    if keys:
        spans = written_table(df.groupBy(*keys).agg(span.alias("__span")), "offset-spans")
        on = [F.col(f"d.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
        rows = df.alias("d").join(spans.alias("s"), on).select("d.*", "s.__span")
        lo, hi, n = (F.col("__span")[x] for x in ("lo", "hi", "n"))
    else:
        one = df.agg(span).scalar()
        rows, (lo, hi, n) = df, (one[x] for x in ("lo", "hi", "n"))
    checked = F.when(hi - lo + 1 == n, F.col(offset) - lo).otherwise(
        F.raise_error(F.lit(f"{offset} has gaps or repeats")).cast("bigint")
    )
    return rows.select(*df.columns, checked.alias(index), n.alias(total))
