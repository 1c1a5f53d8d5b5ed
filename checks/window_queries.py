"""Time windows and count windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from logweir.operators import counting as ct, windows as W
from logweir.operators.parsing import parse_date, parse_dated
from logweir.plans import jobs

from . import lines as L
from .parsing_queries import PLAIN, PROCESSED, R2, R3, VALUE, group
from .registry import query

TIMED = f"""{PLAIN}, p AS (SELECT event_id, line, cast({group(1, R3)} AS BIGINT) AS s, {group(2, R3)} AS msg
 FROM l WHERE regexp_matches(line, '{R3}'))"""
TOKENS = f"""{TIMED}, t AS (SELECT * FROM (SELECT event_id, s, unnest(string_split(msg, ' ')) AS unit FROM p) WHERE unit <> '')"""


def start_s(df):
    """The window start in epoch seconds: reads the same in every engine."""
    rest = [c for c in df.columns if c not in ("window_start", "window_end")]
    return df.select(F.unix_seconds("window_start").alias("start_s"), *rest)


@query("time_match", f"""{PLAIN} SELECT DISTINCT {group(1, R2)}::BIGINT // 10 * 10 AS start_s, md5(line) AS key,
 {VALUE} AS value FROM l WHERE regexp_matches(line, '{R2}') AND contains({group(5, R2)}, 'IRQ')""")
def time_match(spark, sf_dir):
    return start_s(jobs.time_match(L.events(spark, sf_dir), processed=F.lit(PROCESSED), key="md5"))


def sliding(length: int, slide: int, source: str, what: str = "count(DISTINCT unit) AS n_distinct", by: str = "") -> str:
    """Every window start of each row, then a plain grouped count."""
    return f"""w AS (SELECT *, unnest(range((s - {length}) // {slide} * {slide} + {slide}, s + 1, {slide})) AS start_s FROM {source})
 SELECT start_s{by}, {what} FROM w GROUP BY ALL"""


@query("time_count", f"{TOKENS}, {sliding(10, 1, 't')}")
def time_count(spark, sf_dir):
    return start_s(jobs.time_count(L.events(spark, sf_dir)))


@query("time_count_hourly", f"{TOKENS}, {sliding(3600, 600, 't', 'count(DISTINCT unit) AS n_distinct, count(*) AS n_tokens')}")
def time_count_hourly(spark, sf_dir):
    return start_s(jobs.time_count(L.events(spark, sf_dir), 3600, 600, rows="n_tokens"))


@query("time_count_by_month", f"""{TIMED}, m AS (SELECT s, msg AS unit, year(make_timestamp(s*1000000)) AS y,
 month(make_timestamp(s*1000000)) AS m FROM p),
 w AS (SELECT *, unnest(range((s - 86400) // 43200 * 43200 + 43200, s + 1, 43200)) AS start_s FROM m)
SELECT start_s, cast(y AS INT) AS year, cast(m AS INT) AS month, count(DISTINCT unit) AS n_distinct FROM w GROUP BY ALL""")
def time_count_by_month(spark, sf_dir):
    return start_s(jobs.time_count(L.events(spark, sf_dir), 86400, 43200, "payload", by_month=True))


# the key reading: distinct loader keys per window
@query("time_count_keys", f"""{TIMED}, k AS (SELECT s, substr(line, 1, 24) AS unit FROM p), {sliding(3600, 900, 'k')}""")
def time_count_keys(spark, sf_dir):
    return start_s(jobs.time_count(L.events(spark, sf_dir), 3600, 900, "key"))


@query("time_window_stats", f"""{TIMED}, e AS (SELECT p.s, "value", user_id FROM p JOIN events USING (event_id)),
 {sliding(3600, 1200, 'e', 'count(*) AS n, max("value") AS top, min(user_id) AS low')}""")
def time_window_stats(spark, sf_dir):
    rows = parse_dated(L.events(spark, sf_dir, L.EVENT_TEXT, "value", "user_id"))
    aggs = {"n": F.count("*"), "top": F.max("value"), "low": F.min("user_id")}
    return start_s(W.time_window(rows, "ts", 3600, 1200, aggs))


@query("time_count_dense", f"""{TIMED}, c AS (SELECT s // 60 * 60 AS start_s, count(*) AS n FROM p GROUP BY 1)
SELECT k.start_s, coalesce(n, 0) AS n FROM (SELECT unnest(range(min(start_s), max(start_s) + 1, 60)) AS start_s FROM c) k
 LEFT JOIN c USING (start_s)""")
def time_count_dense(spark, sf_dir):
    rows = parse_dated(L.events(spark, sf_dir))
    return start_s(W.time_window(rows, "ts", 60, emit_empty=True).fillna({"n": 0}))


@query("time_count_dense_keyed", f"""{TIMED}, e AS (SELECT p.s, event_type FROM p JOIN events USING (event_id)),
 c AS (SELECT event_type, s // 600 * 600 AS start_s, count(*) AS n FROM e GROUP BY ALL),
 k AS (SELECT event_type, unnest(range(min(start_s), max(start_s) + 1, 600)) AS start_s FROM c GROUP BY event_type)
SELECT event_type, start_s, coalesce(n, 0) AS n FROM k LEFT JOIN c USING (event_type, start_s)""")
def time_count_dense_keyed(spark, sf_dir):
    rows = parse_dated(L.events(spark, sf_dir, L.EVENT_TEXT, "event_type"))
    return start_s(W.time_window(rows, "ts", 600, keys=["event_type"], emit_empty=True).fillna({"n": 0}))


@query("time_gap_count", f"""{TOKENS} SELECT s // 7200 * 7200 AS start_s, count(DISTINCT unit) AS n_distinct
FROM t WHERE s % 7200 < 3600 GROUP BY 1""")
def time_gap_count(spark, sf_dir):
    return start_s(jobs.time_count(L.events(spark, sf_dir), 3600, 7200))


@query("time_gap_rows", f"{TIMED} SELECT s // 2 * 2 AS start_s, count(*) AS n FROM p WHERE s % 2 < 1 GROUP BY 1")
def time_gap_rows(spark, sf_dir):
    return start_s(W.time_window(parse_dated(L.events(spark, sf_dir)), "ts", 1, 2))


# ------------------------------------------------------------------ count windows

PLACED = """i AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM l)"""
PLACED_TIMED = f"""{PLAIN}, {PLACED}"""


@query("bucket_match", f"""{PLACED_TIMED} SELECT DISTINCT i // 1000 AS window_id, md5(line) AS key, {VALUE} AS value
FROM i WHERE (i // 1000) * 1000 + 1000 < n AND regexp_matches(line, '{R2}') AND contains({group(5, R2)}, 'IRQ')""")
def bucket_match(spark, sf_dir):
    lines = L.events(spark, sf_dir)
    return jobs.bucket_match(lines, ["event_id"], 1000, 1000, processed=F.lit(PROCESSED), key="md5")


@query("bucket_match_filtered", f"""{PLAIN}, f AS (SELECT * FROM l WHERE regexp_matches(line, '{R2}')
 AND contains({group(5, R2)}, 'IRQ')), i AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM f)
SELECT i // 50 AS window_id, md5(line) AS key, {VALUE} AS value FROM i WHERE (i // 50) * 50 + 50 < n""")
def bucket_match_filtered(spark, sf_dir):
    """Windows of matches instead of messages."""
    return jobs.bucket_match(L.events(spark, sf_dir), ["event_id"], 50, 50, filter_first=True,
                             processed=F.lit(PROCESSED), key="md5")


def sliding_rows(length: int, slide: int, source: str, what: str, by: str = "", emit: str = "<") -> str:
    return f"""w AS (SELECT *, unnest(range(greatest(0, (i - {length}) // {slide} + 1), i // {slide} + 1)) AS window_id FROM {source})
 SELECT window_id{by}, {what} FROM w WHERE window_id * {slide} + {length} {emit} n GROUP BY ALL"""


# i - length is negative for the first rows: shift before the whole division, which truncates
def sliding_rows_floor(length: int, slide: int, source: str, what: str, by: str = "", emit: str = "<") -> str:
    first = f"cast(greatest(0, floor((i - {length}) / {slide}) + 1) AS BIGINT)"
    return sliding_rows(length, slide, source, what, by, emit).replace(
        f"greatest(0, (i - {length}) // {slide} + 1)", first)


PLACED_MSG = f"""{PLACED_TIMED}, m AS (SELECT i, n, {group(2, R3)} AS unit FROM i WHERE regexp_matches(line, '{R3}'))"""


@query("bucket_count", f"{PLACED_MSG}, {sliding_rows_floor(1000, 100, 'm', 'count(DISTINCT unit) AS n_distinct')}")
def bucket_count(spark, sf_dir):
    return jobs.bucket_count(L.events(spark, sf_dir), ["event_id"], 1000, 100, "payload")


@query("bucket_count_tokens", f"""{PLACED_MSG}, t AS (SELECT * FROM (SELECT i, n, unnest(string_split(unit, ' ')) AS unit FROM m)
 WHERE unit <> ''), {sliding_rows_floor(900, 400, 't', 'count(DISTINCT unit) AS n_distinct, count(*) AS n_tokens', emit='<=').replace('n GROUP', 'n GROUP')}""")
def bucket_count_tokens(spark, sf_dir):
    """Slide that does not divide the length, reported as soon as full."""
    return jobs.bucket_count(L.events(spark, sf_dir), ["event_id"], 900, 400, "token", emit="full", rows="n_tokens")


@query("bucket_gap", f"""{PLACED_TIMED} SELECT i // 1000 AS window_id, count(DISTINCT line) AS n_distinct
FROM i WHERE i % 1000 < 100 AND (i // 1000) * 1000 + 100 < n GROUP BY 1""")
def bucket_gap(spark, sf_dir):
    return jobs.bucket_count(L.events(spark, sf_dir), ["event_id"], 100, 1000)


# offsets that number the messages without gaps need no sort
@query("bucket_count_offsets", f"""{PLAIN}, i AS (SELECT line, event_id - min(event_id) OVER () AS i, count(*) OVER () AS n FROM l),
 m AS (SELECT i, n, {group(2, R3)} AS unit FROM i WHERE regexp_matches(line, '{R3}')),
 {sliding_rows_floor(1000, 100, 'm', 'count(DISTINCT unit) AS n_distinct')}""")
def bucket_count_offsets(spark, sf_dir):
    return jobs.bucket_count(L.events(spark, sf_dir), ["event_id"], 1000, 100, "payload", given=True)


# a window per log partition, numbered by the offsets there
@query("bucket_count_partitions", f"""{PLAIN}, i AS (SELECT cast(event_id % 16 AS INT) AS part, event_id // 16 AS i,
 count(*) OVER (PARTITION BY event_id % 16) AS n, line FROM l),
 m AS (SELECT part, i, n, {group(2, R3)} AS unit FROM i WHERE regexp_matches(line, '{R3}')),
 {sliding_rows_floor(100, 50, 'm', 'count(DISTINCT unit) AS n_distinct', ', part')}""")
def bucket_count_partitions(spark, sf_dir):
    rows = L.events(spark, sf_dir, L.EVENT_TEXT, "cast(event_id % 16 as int) as part", "event_id div 16 as offset")
    return jobs.bucket_count(rows, ["offset"], 100, 50, "payload", partition_by=["part"], given=True)


@query("bucket_match_partitions", f"""{PLAIN}, i AS (SELECT cast(event_id % 16 AS INT) AS part, event_id // 16 AS i,
 count(*) OVER (PARTITION BY event_id % 16) AS n, line FROM l)
SELECT DISTINCT part, i // 100 AS window_id, md5(line) AS key, {VALUE} AS value FROM i
WHERE (i // 100) * 100 + 100 < n AND regexp_matches(line, '{R2}') AND contains({group(5, R2)}, 'IRQ')""")
def bucket_match_partitions(spark, sf_dir):
    rows = L.events(spark, sf_dir, L.EVENT_TEXT, "cast(event_id % 16 as int) as part", "event_id div 16 as offset")
    return jobs.bucket_match(rows, ["offset"], 100, 100, processed=F.lit(PROCESSED), key="md5", partition_by=["part"])


@query("count_window_keyed", f"""WITH i AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i,
 count(*) OVER (PARTITION BY event_type) AS n FROM events),
 {sliding_rows_floor(100, 40, 'i', 'count(*) AS n_rows, min(event_id) AS first_id, max(event_id) AS last_id, max("value") AS top', ', event_type')}""")
def count_window_keyed(spark, sf_dir):
    rows = L.events(spark, sf_dir, L.EVENT_TEXT, "event_type", "value").drop("line")
    aggs = {"n_rows": F.count("*"), "first_id": F.min("event_id"), "last_id": F.max("event_id"), "top": F.max("value")}
    return W.count_window(rows, ["event_id"], 100, 40, aggs, ["event_type"])


@query("row_index", """
SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS row_idx,
 count(*) OVER (PARTITION BY event_type) AS row_total FROM events""")
def row_index(spark, sf_dir):
    from logweir.operators.ordering import with_row_index

    rows = L.events(spark, sf_dir, L.EVENT_TEXT, "event_type", "ts").drop("line")
    return with_row_index(rows, ["ts", "event_id"], ["event_type"]).drop("ts")


@query("window_emit", f"""{PLACED_TIMED} SELECT cast(i // 1000 AS VARCHAR) AS key,
 '{{"n":'||count(*)||',"first_id":'||min(event_id)||'}}' AS value FROM i WHERE (i // 1000) * 1000 + 1000 < n GROUP BY i // 1000""")
def window_emit(spark, sf_dir):
    aggs = {"n": F.count("*"), "first_id": F.min("event_id")}
    windows = W.count_window(L.events(spark, sf_dir).select("event_id"), ["event_id"], 1000, 1000, aggs)
    return W.emit_windows(windows, "window_id")
