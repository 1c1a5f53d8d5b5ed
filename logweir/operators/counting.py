"""Counts: words, distinct things per month, mergeable sketches, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import fill_key, tokens
from .parsing import parse_date, with_parse_flag

SKETCH_BITS = 12
SKETCH_ERROR = 1.04 / (1 << SKETCH_BITS) ** 0.5


def with_unit(df: DataFrame, unit: str, line: str = "line", msg: str = "msg") -> DataFrame:
    """Add ``unit``, the thing to count: every token of the payload, the payload,
    the line, or the loader key of the line. Tokens give one row each."""
    value = {
        "token": lambda: F.explode(tokens(msg)),
        "payload": lambda: F.col(msg),
        "line": lambda: F.col(line),
        "key": lambda: fill_key(line),
    }
    if unit not in value:
        raise ValueError(f"unknown unit {unit!r}")
    return df.select(*df.columns, value[unit]().alias("unit"))


def dated_units(
    df: DataFrame, unit: str = "token", line: str = "line", date_parts: str = "year_month"
) -> DataFrame:
    """year, month, unit of every well-formed line.

    ``date_parts="as_coded"`` takes the third part of the date as the month.
    """
    if date_parts not in ("year_month", "as_coded"):
        raise ValueError(f"unknown date_parts {date_parts!r}")
    month = "day" if date_parts == "as_coded" else "month"
    parsed = with_unit(parse_date(df.select(line), line), unit, line)
    return parsed.select("year", F.col(month).alias("month"), "unit")


def count_by_key(df: DataFrame, key: str, out: str = "n") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias(out))


def random_rows(df: DataFrame, n: int = 5, seed: int | None = None) -> DataFrame:
    """``n`` rows in random order; each task hands on at most ``n``."""
    return df.orderBy(F.rand(seed)).limit(n)


def conservation(groups: DataFrame, rows: DataFrame, n: str = "n") -> DataFrame:
    """One row: rows read, rows counted in the groups, and what is missing."""
    read = rows.agg(F.count("*")).scalar()
    return groups.agg(F.coalesce(F.sum(n), F.lit(0)).alias("counted")).select(
        read.alias("rows_read"), "counted", (read - F.col("counted")).alias("missing")
    )


def distinct_by(df: DataFrame, keys: list[str], unit: str = "unit", out: str = "n_distinct") -> DataFrame:
    """Exact distinct count per group.

    Spark first shuffles on (keys, unit) after a map-side pre-aggregation, so a
    group with a third of all rows is spread over all tasks.
    """
    return df.groupBy(*keys).agg(F.count_distinct(unit).alias(out))


def sketch_by(df: DataFrame, keys: list[str], unit: str = "unit", bits: int = SKETCH_BITS) -> DataFrame:
    """One mergeable sketch per group."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(unit, bits).alias("sketch"))


def merge_sketches(sketches: DataFrame, keys: list[str] = ()) -> DataFrame:
    return sketches.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))


def estimate(sketch: Column | str = "sketch") -> Column:
    return F.hll_sketch_estimate(sketch)


def within_bound(estimated: Column, exact: Column, sigmas: float = 3.0) -> Column:
    """Whether an estimate lies within ``sigmas`` standard errors of the sketch."""
    return F.abs(estimated - exact) <= F.lit(sigmas * SKETCH_ERROR) * exact


def dedup_stats(df: DataFrame, fmt: str = "payload", line: str = "line") -> DataFrame:
    """One row: records seen, and distinct payloads among the parsed ones."""
    return with_parse_flag(df.select(line), fmt, line, payload="__msg").agg(
        F.count("*").alias("records"), F.count_distinct("__msg").alias("unique_records")
    )


def sketch_report(df: DataFrame, batch: str, line: str = "line", bits: int = SKETCH_BITS) -> DataFrame:
    """Per batch, in one pass: sketch of the distinct payloads, lines parsed and attempted."""
    return with_parse_flag(df.select(batch, line), "date", line, payload="__msg").groupBy(batch).agg(
        F.count("*").alias("attempted"),
        F.count_if("parsed").alias("parsed"),
        F.hll_sketch_agg("__msg", bits).alias("sketch"),
    )
