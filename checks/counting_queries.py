"""Distinct counts, sketches, words, de-duplication, keyed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from logweir.operators import counting as ct, dedup as dd
from logweir.operators.parsing import parse_date, parse_event, parse_payload
from logweir.plans import jobs
from logweir.session import fresh_folder
from logweir.sinks.keyed import KeyedTable
from logweir.sinks.leveled import LeveledTable
from logweir.sources.files import read_table

from . import lines as L
from .parsing_queries import DAMAGED, PLAIN, R1, R2, R3, group
from .registry import query

ORDERS = f"""WITH l AS ({L.duck_orders()}), d AS (SELECT o_orderkey, line, cast({group(1, R1)} AS INT) AS year,
 cast({group(2, R1)} AS INT) AS month, cast({group(3, R1)} AS INT) AS day, {group(4, R1)} AS msg
 FROM l WHERE regexp_matches(line, '{R1}'))"""
ORDER_TOKENS = f"""{ORDERS}, t AS (SELECT * FROM (SELECT *, unnest(string_split(msg, ' ')) AS unit FROM d) WHERE unit <> '')"""


@query("count_exact", f"{ORDER_TOKENS} SELECT year, month, count(DISTINCT unit) AS n_distinct FROM t GROUP BY ALL")
def count_exact(spark, sf_dir):
    return jobs.count(L.orders(spark, sf_dir), "token")


@query("count_report", f"""{ORDER_TOKENS} SELECT year, month, count(DISTINCT unit) AS n_distinct,
 row_number() OVER (ORDER BY year, month) - 1 AS place FROM t GROUP BY year, month""")
def count_report(spark, sf_dir):
    """The order of the report, shown by the place of its rows."""
    report = jobs.count(L.orders(spark, sf_dir), ordered=True)
    place = F.monotonically_increasing_id()
    return report.coalesce(1).withColumn("place", place)


@query("count_payload", f"{ORDERS} SELECT year, month, count(DISTINCT msg) AS n_distinct FROM d GROUP BY ALL")
def count_payload(spark, sf_dir):
    return jobs.count(L.orders(spark, sf_dir), "payload")


@query("count_line", f"{ORDERS} SELECT year, month, count(DISTINCT line) AS n_distinct FROM d GROUP BY ALL")
def count_line(spark, sf_dir):
    return jobs.count(L.orders(spark, sf_dir), "line")


@query("count_as_coded", f"""{ORDERS}
SELECT year, day AS month, count(DISTINCT msg) AS n_distinct FROM d GROUP BY ALL""")
def count_as_coded(spark, sf_dir):
    return jobs.count(L.orders(spark, sf_dir), "payload", date_parts="as_coded")


@query("count_hll", f"""{ORDER_TOKENS}
SELECT year, month, count(DISTINCT unit) AS n_exact, true AS within FROM t GROUP BY ALL""")
def count_hll(spark, sf_dir):
    lines = L.orders(spark, sf_dir)
    exact = jobs.count(lines).withColumnRenamed("n_distinct", "n_exact")
    both = exact.join(jobs.count(lines, exact=False), ["year", "month"])
    return both.select("year", "month", "n_exact",
                       ct.within_bound(F.col("n_distinct"), F.col("n_exact"), 5).alias("within"))


# a batch per year: the sketches of the batches merge to the overall count
@query("hll_overall", f"""{ORDERS} SELECT count(DISTINCT msg) AS n_exact, count(*) AS parsed,
 (SELECT count(*) FROM l) AS attempted, true AS within FROM d""")
def hll_overall(spark, sf_dir):
    lines = L.orders(spark, sf_dir, "year(o_orderdate) as batch")
    _, overall = jobs.distinct_overall(lines, "batch")
    exact = parse_date(lines).agg(F.count_distinct("msg")).scalar()
    return overall.select(exact.alias("n_exact"), "parsed", "attempted",
                          ct.within_bound(F.col("approx_distinct"), exact).alias("within"))


@query("hll_by_batch", f"""{ORDERS} SELECT year AS batch, count(DISTINCT msg) AS n_exact, count(*) AS parsed,
 true AS within FROM d GROUP BY 1""")
def hll_by_batch(spark, sf_dir):
    lines = L.orders(spark, sf_dir, "year(o_orderdate) as batch")
    shown, _ = jobs.distinct_overall(lines, "batch")
    exact = parse_date(lines).groupBy("batch").agg(F.count_distinct("msg").alias("n_exact"))
    return shown.join(exact, "batch").select(
        "batch", "n_exact", "parsed", ct.within_bound(F.col("approx_distinct"), F.col("n_exact"), 5).alias("within")
    )


WORDS = r"WITH w AS (SELECT unnest(string_split(text, ' ')) AS word FROM documents), t AS (SELECT word FROM w WHERE word <> '')"


def _words(spark, sf_dir):
    from logweir.functions.columns import tokens

    return read_table(spark, sf_dir, "documents").select(F.explode(tokens("text")).alias("word"))


@query("word_count", f"{WORDS} SELECT word, count(*) AS n FROM t GROUP BY word")
def word_count(spark, sf_dir):
    return jobs.word_count(_words(spark, sf_dir))


@query("count_check", f"{WORDS} SELECT count(*) AS rows_read, count(*) AS counted, cast(0 AS BIGINT) AS missing FROM t")
def count_check(spark, sf_dir):
    words = _words(spark, sf_dir)
    return ct.conservation(jobs.word_count(words), words)


# --------------------------------------------------------------------- dedup

# each user's lines of a type and payload repeat: drop what makes a line unique
REPEATED = L.EVENT_TEXT.replace("unix_seconds(cast(ts as timestamp))", "unix_seconds(date_trunc('day', ts))").replace(
    "'MMM dd HH:mm:ss'", "'MMM dd 00:00:00'")
DUCK_REPEATED = L.DUCK_EVENT_TEXT.replace("epoch_us(ts)", "epoch_us(date_trunc('day', ts)::timestamp)").replace(
    "%b %d %H:%M:%S", "%b %d 00:00:00")
DUCK_REPEATS = f"WITH l AS ({L.duck_events(DUCK_REPEATED)})"


@query("dedup_line", f"""{DUCK_REPEATS}
SELECT cast(cast({group(1, R3)} AS BIGINT)*1000 AS VARCHAR) AS key, line AS value
FROM (SELECT line FROM l GROUP BY line) WHERE regexp_matches(line, '{R3}')""")
def dedup_line(spark, sf_dir):
    return jobs.dedup(L.events(spark, sf_dir, REPEATED), ["event_id"])


@query("dedup_payload", f"""{DAMAGED}, p AS (SELECT event_id, line, cast({group(1, R3)} AS BIGINT) AS epoch_s,
 {group(2, R3)} AS msg FROM l WHERE regexp_matches(line, '{R3}'))
SELECT cast(epoch_s*1000 AS VARCHAR) AS key, line AS value
FROM (SELECT *, row_number() OVER (PARTITION BY msg ORDER BY event_id) AS rn FROM p) WHERE rn = 1""")
def dedup_payload(spark, sf_dir):
    lines = L.events(spark, sf_dir, L.DAMAGED_TEXT)
    return jobs.dedup(lines, ["event_id"], mode="payload_only")


@query("dedup_payload_order", f"""{PLAIN}, p AS (SELECT event_id, epoch_us(ts)//1000000 AS epoch_s,
 {group(2, R3)} AS msg FROM (SELECT event_id, line, ts FROM l JOIN events USING (event_id)))
SELECT event_id, epoch_s, row_number() OVER (ORDER BY epoch_s, event_id) - 1 AS place
FROM (SELECT *, row_number() OVER (PARTITION BY msg ORDER BY event_id) AS rn FROM p) WHERE rn = 1""")
def dedup_payload_order(spark, sf_dir):
    """The time order of the output, shown by numbering it."""
    from logweir.operators.ordering import with_row_index

    firsts = dd.dedup_payloads(L.events(spark, sf_dir), ["event_id"])
    placed = with_row_index(firsts.select("event_id", "epoch_s"), ["epoch_s", "event_id"])
    return placed.select("event_id", "epoch_s", F.col("row_idx").alias("place"))


@query("dedup_stats", f"""{DAMAGED} SELECT count(*) AS records,
 count(DISTINCT {group(2, R3)}) FILTER (regexp_matches(line, '{R3}')) AS unique_records FROM l""")
def dedup_stats(spark, sf_dir):
    return ct.dedup_stats(L.events(spark, sf_dir, L.DAMAGED_TEXT))


@query("dedup_approx", """
SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn
 FROM documents) WHERE rn = 1""")
def dedup_approx(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return dd.dedup_by_hash(docs, "text", ["doc_id"], ["lang", "source"])


@query("dedup_per_batch", f"""{PLAIN}
SELECT DISTINCT cast(epoch_us(ts)//86400000000 AS BIGINT) AS batch, {group(2, R2)} AS username, {group(5, R2)} AS msg
FROM l JOIN events USING (event_id)""")
def dedup_per_batch(spark, sf_dir):
    batch = "unix_seconds(cast(ts as timestamp)) div 86400 as batch"
    parsed = parse_event(L.events(spark, sf_dir, L.EVENT_TEXT, batch))
    return dd.distinct_per_batch(parsed, "batch", ["username", "msg"])


@query("unseen_payloads", f"""{PLAIN}, p AS (SELECT event_type, user_id, {group(2, R3)} AS msg FROM l JOIN events USING (event_id)),
 q AS (SELECT DISTINCT event_type, user_id||' '||substr(msg, strpos(msg, ' ') + 1) AS body FROM p)
SELECT DISTINCT body FROM q WHERE event_type <> 'error' AND body NOT IN (SELECT body FROM q WHERE event_type = 'error')""")
def unseen_payloads(spark, sf_dir):
    """What users did that they did not also do in an error event."""
    parsed = parse_payload(L.events(spark, sf_dir, L.EVENT_TEXT, "event_type", "user_id"), anchored=True)
    body = F.expr("concat(user_id, ' ', substr(msg, instr(msg, ' ') + 1))").alias("body")
    bodies = parsed.select("event_type", body)
    is_error = F.col("event_type") == "error"
    seen = bodies.where(is_error).select("body").distinct()
    return dd.unseen(bodies.where(~is_error).select("body").distinct(), seen, "body")


# --------------------------------------------------------------- keyed tables


@query("kv_upsert", f"""{PLAIN} SELECT {group(2, R2)}||{group(3, R2)}||{group(4, R2)} AS key,
 arg_max({group(5, R2)}, event_id) AS value FROM l GROUP BY 1""")
def kv_upsert(spark, sf_dir):
    """Three batches, ten days each; later batches replace earlier rows."""
    days = "(dayofmonth(ts) - 1) div 10 as batch"
    parsed = parse_event(L.events(spark, sf_dir, L.EVENT_TEXT, days))
    rows = parsed.select("batch", "event_id", F.concat("username", "sep", "nodename").alias("key"),
                         F.col("msg").alias("value"))
    table = KeyedTable(spark, fresh_folder(spark, "kv"), rows.select("key", "value").schema, "key")
    for batch in range(4):
        table.upsert(rows.where(F.col("batch") == batch), batch, ["event_id"])
    return table.current()


LEVELED = 6


@query("kv_upsert_levels", f"""WITH b AS (SELECT *, (event_id - min(event_id) OVER ()) //
 ((max(event_id) OVER () - min(event_id) OVER ()) // {LEVELED} + 1) AS batch FROM events)
SELECT user_id AS key, arg_max(event_type, event_id) AS value, min(batch) = {LEVELED - 1} AS created FROM b GROUP BY 1""")
def kv_upsert_levels(spark, sf_dir):
    """Six batches into sorted levels; the last one's new keys are told by what was there before."""
    events = read_table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("key"), F.col("event_type").alias("value"))
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    step = (high - low) // LEVELED + 1
    table = LeveledTable(spark, fresh_folder(spark, "leveled"), events.select("key", "value").schema, "key", ranges=8, fanout=2)
    for batch in range(LEVELED):
        rows = events.where(F.col("event_id").between(low + batch * step, low + (batch + 1) * step - 1))
        table.upsert(rows, batch, ["event_id"])
    told = table.with_created(rows.select("key").distinct(), before=LEVELED - 1)
    return table.current().join(told, "key", "left").select("key", "value", F.coalesce("created", F.lit(False)).alias("created"))


@query("last_write_map", f"""{PLAIN} SELECT cast(epoch_us(ts)//86400000000 AS BIGINT) AS day, {group(2, R2)} AS username,
 arg_max({group(5, R2)}, event_id) AS value, count(*) AS total FROM l JOIN events USING (event_id) GROUP BY 1, 2""")
def last_write_map(spark, sf_dir):
    """One value per key and day window: the one written last."""
    from logweir.operators.windows import time_window
    from logweir.sinks.keyed import last_write

    parsed = parse_event(L.events(spark, sf_dir))
    out = time_window(parsed, "ts", 86400, aggs={"value": last_write("msg", ["event_id"]), "total": F.count("*")},
                      keys=["username"])
    day = F.expr("unix_seconds(window_start) div 86400").alias("day")
    return out.select(day, "username", "value", "total")
