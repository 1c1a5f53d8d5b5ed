"""Sliding windows of mergeable aggregates, over the events as count and time windows."""

from __future__ import annotations

import heapq

import pyarrow.compute as pc
from pyspark.sql import functions as F

from logweir.operators import panes as P, reducers as R, sketch_tree as T, windows as W
from logweir.operators.counting import with_unit, within_bound
from logweir.operators.parsing import parse_date, parse_dated
from logweir.session import written_table

from . import lines as L
from .registry import query
from .window_queries import PLACED_MSG, TIMED, sliding, sliding_rows_floor, start_s

INDEXED = """WITH i AS (SELECT event_id, user_id, "value", event_type, row_number() OVER (ORDER BY event_id) - 1 AS i,
 count(*) OVER () AS n FROM events)"""
STATS = """count(*) AS n_rows, sum(user_id) AS total, min(user_id) AS low, max("value") AS top,
 sum(user_id) / count(user_id) AS mean_user, arg_max(event_type, event_id) AS last_type, bool_or(event_type = 'error') AS failed"""


def _stats():
    return {
        "n_rows": P.counted(), "total": P.total("user_id"), "low": P.least("user_id"), "top": P.most("value"),
        "mean_user": P.mean("user_id"), "last_type": P.last_of("event_type", "event_id"), "failed": P.either(F.col("event_type") == "error"),
    }


def _rows(spark, sf_dir):
    return L.events(spark, sf_dir, L.EVENT_TEXT, "user_id", "value", "event_type").drop("line")


@query("count_window_panes", f"{INDEXED}, {sliding_rows_floor(1000, 100, 'i', STATS)}")
def count_window_panes(spark, sf_dir):
    return P.sliding_count_window(_rows(spark, sf_dir), ["event_id"], 1000, 100, _stats())


@query("count_window_slide_one", f"{INDEXED}, s AS (SELECT i, n, count(*) OVER w AS n_rows, sum(user_id) OVER w AS total, min(user_id) OVER w AS low,"
       " max(\"value\") OVER w AS top FROM i WINDOW w AS (ORDER BY i ROWS BETWEEN CURRENT ROW AND 999 FOLLOWING)) "
       "SELECT i AS window_id, n_rows, total, low, top FROM s WHERE i + 1000 < n")
def count_window_slide_one(spark, sf_dir):
    """A window of 1,000 rows at every row."""
    aggs = {k: v for k, v in _stats().items() if k in ("n_rows", "total", "low", "top")}
    return P.sliding_count_window(_rows(spark, sf_dir), ["event_id"], 1000, 1, aggs)


@query("count_window_panes_keyed", """WITH i AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i,
 count(*) OVER (PARTITION BY event_type) AS n FROM events), """ + sliding_rows_floor(90, 40, "i", STATS.split(", arg_max")[0].replace("\n", " "), ", event_type", "<="))
def count_window_panes_keyed(spark, sf_dir):
    aggs = {k: v for k, v in _stats().items() if k not in ("last_type", "failed")}
    return P.sliding_count_window(_rows(spark, sf_dir), ["event_id"], 90, 40, aggs, ["event_type"], emit="full")


@query("time_window_panes", f"""{TIMED}, e AS (SELECT p.s, "value", user_id, event_type, event_id FROM p JOIN events USING (event_id)),
 {sliding(3600, 60, 'e', STATS.replace(chr(10), ' '))}""")
def time_window_panes(spark, sf_dir):
    """An hour at every minute, over panes with gaps between them."""
    rows = parse_dated(L.events(spark, sf_dir, L.EVENT_TEXT, "value", "user_id", "event_type"))
    return start_s(P.sliding_time_window(rows, "ts", 3600, 60, _stats()))


@query("time_window_panes_sketch", f"""{TIMED}, {sliding(86400, 3600, 'p', 'count(DISTINCT msg) AS n_exact, count(*) AS n_rows, true AS within')}""")
def time_window_panes_sketch(spark, sf_dir):
    """Approximate distinct payloads of each window beside the exact ones."""
    rows = parse_dated(L.events(spark, sf_dir))
    about = P.sliding_time_window(rows, "ts", 86400, 3600, {"about": P.sketched("msg"), "n_rows": P.counted()})
    exact = W.distinct_in_time_windows(rows, "ts", 86400, 3600, "msg").withColumnRenamed("n_distinct", "n_exact")
    both = start_s(about).join(start_s(exact), "start_s")
    return both.select("start_s", "n_exact", "n_rows", within_bound(F.col("about"), F.col("n_exact"), 5).alias("within"))


@query("time_count_sketch", f"""{TIMED}, {sliding(86400, 3600, 'p', 'count(DISTINCT msg) AS n_exact, true AS within')}""")
def time_count_sketch(spark, sf_dir):
    """A day at every hour, from a tree of sketches, beside the exact counts."""
    rows = parse_dated(L.events(spark, sf_dir))
    about = start_s(T.sketched_in_time_windows(rows, "ts", 86400, 3600, "msg"))
    exact = start_s(W.distinct_in_time_windows(rows, "ts", 86400, 3600, "msg")).withColumnRenamed("n_distinct", "n_exact")
    both = exact.join(about, "start_s", "full")
    return both.select("start_s", "n_exact", F.coalesce(within_bound(F.col("approx_distinct"), F.col("n_exact"), 3), F.lit(False)).alias("within"))


@query("bucket_count_sketch", f"{PLACED_MSG}, {sliding_rows_floor(1000, 100, 'm', 'count(DISTINCT unit) AS n_exact, true AS within')}")
def bucket_count_sketch(spark, sf_dir):
    placed = with_unit(parse_date(W.indexed(L.events(spark, sf_dir), ["event_id"])), "payload")
    placed = written_table(placed.select("row_idx", "row_total", "unit"), "placed-payloads")
    about = T.sketched_in_count_windows(placed, 1000, 100)
    exact = W.distinct_in_count_windows(placed, 1000, 100).withColumnRenamed("n_distinct", "n_exact")
    both = exact.join(about, "window_id", "full")
    return both.select("window_id", "n_exact", F.coalesce(within_bound(F.col("approx_distinct"), F.col("n_exact"), 3), F.lit(False)).alias("within"))


class RunnersUp(R.Reducer):
    """Rows, and the second highest value."""

    def init(self):
        return 0, []

    def add(self, state, rows):
        held = rows.column("value").drop_null()
        best = held.take(pc.sort_indices(held, sort_keys=[("", "descending")])[:2])
        return self.merge(state, (rows.num_rows, best.to_pylist()))

    def merge(self, left, right):
        return left[0] + right[0], heapq.nlargest(2, left[1] + right[1])

    def finish(self, state):
        return state[0], state[1][1] if len(state[1]) > 1 else None


@query("time_window_reducer", f"""{TIMED}, e AS (SELECT p.s, "value", event_type FROM p JOIN events USING (event_id)),
 {sliding(3600, 1200, 'e', 'count(*) AS n_rows, max("value", 2)[2] AS second', ', event_type')}""")
def time_window_reducer(spark, sf_dir):
    """A reducer without a built-in equal, in an hour at every 20 minutes."""
    rows = parse_dated(L.events(spark, sf_dir, L.EVENT_TEXT, "value", "event_type"))
    return start_s(R.reduced_in_time_windows(rows, "ts", 3600, 1200, RunnersUp(), "n_rows bigint, second double", ["event_type"])).drop("window_end")
