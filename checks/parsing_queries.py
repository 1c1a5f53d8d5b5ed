"""Parsing, matching, message keys and values, bulk-load keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from logweir.functions import columns as C, patterns as P
from logweir.operators import parsing as ps
from logweir.plans import jobs
from logweir.sources import messages as ms

from . import lines as L
from .registry import query

PROCESSED = "2024-02-01T00:00:00Z"


def whole(pattern: str) -> str:
    return r"\A" + pattern + r"\z"


R1, R2, R3 = whole(P.DATE_LINE), whole(P.EVENT_LINE), whole(P.PAYLOAD_LINE)
STRICT = whole(P.STRICT_EVENT_LINE)
DAMAGED = f"WITH l AS ({L.duck_events(L.DUCK_DAMAGED_TEXT)})"
PLAIN = f"WITH l AS ({L.duck_events()})"


def group(n: int, pattern: str, text: str = "line") -> str:
    return f"regexp_extract({text}, '{pattern}', {n})"


def iso(epoch: str) -> str:
    return f"strftime(make_timestamp(({epoch})*1000000), '%Y-%m-%dT%H:%M:%SZ')"


EPOCH = f"cast({group(1, R2)} AS BIGINT)"
VALUE = (
    f"'{PROCESSED}:'||{iso(EPOCH)}||':'||{group(2, R2)}||{group(3, R2)}||{group(4, R2)}||':'||{group(5, R2)}"
)


@query("parse_date", f"""{DAMAGED}
SELECT event_id, cast({group(1, R1)} AS INT) AS year, cast({group(2, R1)} AS INT) AS month,
 cast({group(3, R1)} AS INT) AS day, {group(4, R1)} AS msg FROM l WHERE regexp_matches(line, '{R1}')""")
def parse_date(spark, sf_dir):
    return ps.parse_date(L.events(spark, sf_dir, L.DAMAGED_TEXT)).drop("line")


@query("parse_event", f"""{DAMAGED}
SELECT event_id, {EPOCH} AS epoch_s, {group(2, R2)} AS username, {group(3, R2)} AS sep,
 {group(4, R2)} AS nodename, {group(5, R2)} AS msg FROM l WHERE regexp_matches(line, '{R2}')""")
def parse_event(spark, sf_dir):
    return ps.parse_event(L.events(spark, sf_dir, L.DAMAGED_TEXT)).drop("line", "ts")


@query("parse_event_strict", f"""{DAMAGED}
SELECT event_id, cast({group(1, STRICT)} AS BIGINT) AS epoch_s, {group(2, STRICT)} AS username,
 {group(3, STRICT)} AS sep, {group(4, STRICT)} AS nodename, {group(5, STRICT)} AS msg
FROM l WHERE regexp_matches(line, '{STRICT}')""")
def parse_event_strict(spark, sf_dir):
    return ps.parse_event(L.events(spark, sf_dir, L.DAMAGED_TEXT), strict_sep=True).drop("line", "ts")


# found behind any prefix, so the damaged lines parse too
@query("parse_payload", f"""{DAMAGED}
SELECT event_id, cast({group(1, P.PAYLOAD_LINE + '$')} AS BIGINT) AS epoch_s, {group(2, P.PAYLOAD_LINE + '$')} AS msg
FROM (SELECT event_id, replace(line, 'ALERT - ', 'ALERT text before - ') AS line FROM l)
WHERE regexp_matches(line, '{P.PAYLOAD_LINE}$')""")
def parse_payload(spark, sf_dir):
    lines = L.events(spark, sf_dir, L.DAMAGED_TEXT)
    prefixed = F.replace("line", F.lit("ALERT - "), F.lit("ALERT text before - "))
    return ps.parse_payload(lines.withColumn("line", prefixed)).drop("line")


@query("parse_payload_anchored", f"""{DAMAGED}
SELECT event_id, cast({group(1, R3)} AS BIGINT) AS epoch_s, {group(2, R3)} AS msg
FROM l WHERE regexp_matches(line, '{R3}')""")
def parse_payload_anchored(spark, sf_dir):
    return ps.parse_payload(L.events(spark, sf_dir, L.DAMAGED_TEXT), anchored=True).drop("line")


@query("malformed_lines", f"{DAMAGED} SELECT event_id, line FROM l WHERE NOT regexp_matches(line, '{R2}')")
def malformed_lines(spark, sf_dir):
    return ps.rejected_lines(L.events(spark, sf_dir, L.DAMAGED_TEXT))


@query("parse_stats", f"""{DAMAGED}
SELECT count(*) AS attempted, count(*) FILTER (regexp_matches(line, '{R1}')) AS parsed,
 count(*) FILTER (NOT regexp_matches(line, '{R1}')) AS rejected FROM l""")
def parse_stats(spark, sf_dir):
    return ps.parse_stats(L.events(spark, sf_dir, L.DAMAGED_TEXT))


@query("match", f"""{DAMAGED} SELECT md5(line) AS key, {VALUE} AS value FROM l
WHERE regexp_matches(line, '{R2}') AND contains({group(5, R2)}, 'IRQ')""")
def match(spark, sf_dir):
    lines = L.events(spark, sf_dir, L.DAMAGED_TEXT)
    return jobs.match(lines, processed=F.lit(PROCESSED), key="md5")


# the literal anywhere in the line, here a node name
@query("match_line_scope", f"""{PLAIN} SELECT md5(line) AS key, {VALUE} AS value FROM l
WHERE regexp_matches(line, '{R2}') AND contains(line, 'node3')""")
def match_line_scope(spark, sf_dir):
    lines = L.events(spark, sf_dir)
    return jobs.match(lines, literal="node3", scope="line", processed=F.lit(PROCESSED), key="md5")


@query("event_key", f"{PLAIN} SELECT event_id, md5(line) AS key FROM l")
def event_key(spark, sf_dir):
    return L.events(spark, sf_dir).select("event_id", C.message_key("line", "md5").alias("key"))


@query("event_key_unique", """
SELECT count(*) AS events, count(*) AS keys FROM events""")
def event_key_unique(spark, sf_dir):
    keys = L.events(spark, sf_dir).select(C.message_key("line").alias("key"))
    return keys.agg(F.count("*").alias("events"), F.count_distinct("key").alias("keys"))


@query("event_value", f"{PLAIN} SELECT event_id, {VALUE} AS value FROM l WHERE regexp_matches(line, '{R2}')")
def event_value(spark, sf_dir):
    parsed = ps.parse_event(L.events(spark, sf_dir))
    return parsed.select("event_id", C.event_value(F.lit(PROCESSED)).alias("value"))


@query("iso_time", f"SELECT event_id, {iso('epoch_us(ts)//1000000')} AS iso FROM events")
def iso_time(spark, sf_dir):
    epoch = "unix_seconds(cast(ts as timestamp)) as epoch_s"
    return L.events(spark, sf_dir, L.EVENT_TEXT, epoch).select("event_id", C.iso_time("epoch_s").alias("iso"))


@query("sheet_time", """
SELECT event_id, year(ts)||'-'||month(ts)||'-'||day(ts) AS date, hour(ts)||':'||minute(ts)||':'||second(ts) AS time
FROM events""")
def sheet_time(spark, sf_dir):
    return L.events(spark, sf_dir, L.EVENT_TEXT, "ts").select(
        "event_id", C.sheet_date("ts").alias("date"), C.sheet_time("ts").alias("time")
    )


@query("month_key", """
SELECT month(o_orderdate)||'-'||year(o_orderdate) AS month_key, count(*) AS n FROM orders GROUP BY 1""")
def month_key(spark, sf_dir):
    parsed = ps.parse_date(L.orders(spark, sf_dir))
    return parsed.groupBy(C.month_key("month", "year").alias("month_key")).agg(F.count("*").alias("n"))


# lines of this shape are one byte per character in the part that makes the key
@query("fill_key", f"{PLAIN} SELECT event_id, substr(line, 1, 24) AS key, line AS value FROM l")
def fill_key(spark, sf_dir):
    lines = L.events(spark, sf_dir)
    return lines.select(
        "event_id", C.fill_key("line").cast("string").alias("key"), F.col("line").alias("value")
    )


def as_messages(spark, sf_dir):
    """The event lines as a log of 144 partitions."""
    rows = L.events(spark, sf_dir, L.EVENT_TEXT, "cast(event_id % 144 as int) as partition",
                    "event_id div 144 as offset", "cast(ts as timestamp) as timestamp")
    filled = ms.fill_messages(rows)
    body = rows.select("partition", "offset", "timestamp", F.lit("syslog").alias("topic"),
                       C.fill_key("line").alias("key"), F.encode("line", "UTF-8").alias("value"))
    assert filled.columns == ["key", "value"]
    return body


@query("topic_metrics", f"""{PLAIN}
SELECT 'syslog' AS topic, cast(event_id%144 AS INT) AS partition, max(event_id//144) AS current_offset,
 cast(sum(strlen(line)) AS BIGINT) AS bytes, count(*) AS messages FROM l GROUP BY event_id%144""")
def topic_metrics(spark, sf_dir):
    return ms.topic_metrics(as_messages(spark, sf_dir))


@query("sampled_messages", f"""{PLAIN}
SELECT cast(event_id%144 AS INT) AS partition, event_id//144 AS "offset", line FROM l WHERE (event_id//144)%10=0""")
def sampled_messages(spark, sf_dir):
    sampled = ms.text_lines(ms.sampled_messages(as_messages(spark, sf_dir), every=10))
    return sampled.select("partition", "offset", "line")
