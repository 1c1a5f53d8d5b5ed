"""Roll-ups of parsed metric lines to one row per second."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import sheet_date, sheet_time

GB = float(1 << 30)

LATENCY_COLUMNS = ["p50", "p999"]
THROUGHPUT_COLUMNS = ["qps"]
HARDWARE_COLUMNS = ["cpu1", "cpu5", "free_mem_gb", "used_mem_gb", "percentage_used"]


def latency_aggs() -> list[Column]:
    """Means cut to whole microseconds."""
    return [F.floor(F.avg(c)).alias(c) for c in LATENCY_COLUMNS]


def throughput_aggs() -> list[Column]:
    return [F.sum("qps").alias("qps")]


def hardware_aggs(order: list[str]) -> list[Column]:
    """Mean load and free memory; the total is that of the second's last line."""
    if len(order) == 1:
        total = F.max_by("total_mem", order[0])
    else:
        total = F.max(F.when(F.col("total_mem").isNotNull(), F.struct(*order, "total_mem")))["total_mem"]
    return [
        F.avg("cpu1").alias("cpu1"),
        F.avg("cpu5").alias("cpu5"),
        F.avg("free_mem").alias("free_mem"),
        total.alias("total_mem"),
    ]


def hardware_report() -> dict[str, Column]:
    used = F.col("total_mem") - F.col("free_mem")
    return {
        "cpu1": F.round("cpu1", 4),
        "cpu5": F.round("cpu5", 4),
        "free_mem_gb": F.round(F.col("free_mem") / GB, 4),
        "used_mem_gb": F.round(used / GB, 4),
        "percentage_used": F.round(F.try_divide(used, F.col("total_mem")) * 100.0, 4),
    }


def latency_by_second(parsed: DataFrame, keys: list[str] = ()) -> DataFrame:
    return parsed.groupBy(*keys, "second").agg(*latency_aggs())


def throughput_by_second(parsed: DataFrame, keys: list[str] = ()) -> DataFrame:
    return parsed.groupBy(*keys, "second").agg(*throughput_aggs())


def hardware_by_second(parsed: DataFrame, order: list[str], keys: list[str] = ()) -> DataFrame:
    return (
        parsed.groupBy(*keys, "second")
        .agg(*hardware_aggs(order))
        .select(*keys, "second", *[c.alias(n) for n, c in hardware_report().items()])
    )


def as_sheet(by_second: DataFrame, keys: list[str] = ()) -> DataFrame:
    """The report layout: unpadded date and time columns instead of the second."""
    rest = [c for c in by_second.columns if c != "second" and c not in keys]
    return by_second.orderBy(*keys, "second").select(
        *keys, sheet_date("second").alias("date"), sheet_time("second").alias("time"), *rest
    )
