"""The registered queries: each a Spark query over the given tables and, where
SQL can say the same, the oracle's SQL with equal column names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without ``sql`` only its rows are checked."""

    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def load() -> None:
    """Import the modules that register queries."""
    from . import parsing_queries, counting_queries, window_queries  # noqa: F401
    from . import metric_queries, metric_files, device_queries, stream_queries  # noqa: F401
    from . import pane_queries, counter_queries  # noqa: F401
