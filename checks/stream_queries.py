"""The jobs as streams over the events table, run until all of it is read.

The oracle of a stream is the SQL of its batch form (closed windows only where
a watermark decides what is reported).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from logweir.functions.columns import tokens
from logweir.operators.counting import dated_units, with_unit
from logweir.operators.ordering import with_row_index
from logweir.operators.parsing import parse_date, parse_dated
from logweir.plans import jobs
from logweir.session import fresh_folder
from logweir.sinks.keyed import KeyedTable
from logweir.streaming import jobs as st
from logweir.streaming.count_windows import DistinctPerCountWindow, MatchesPerCountWindow
from logweir.streaming.distinct_bitmaps import DistinctBitmaps
from logweir.streaming.watermarked import DenseTimeWindows, TimeOrdered

from . import lines as L
from .parsing_queries import PLAIN, PROCESSED, R2, R3, VALUE, group
from .registry import ORACLES, query
from .window_queries import PLACED_MSG, PLACED_TIMED, TIMED, TOKENS, sliding_rows_floor, start_s


def collected(spark, stream, label, mode="append"):
    """Run a stream into files and read them."""
    folder = fresh_folder(spark, label)
    st.append_to(stream, f"{folder}/out", f"{folder}/checkpoint", mode).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query("stream_match", f"""{PLAIN} SELECT md5(line) AS key, {VALUE} AS value FROM l
WHERE regexp_matches(line, '{R2}') AND contains({group(5, R2)}, 'IRQ')""")
def stream_match(spark, sf_dir):
    stream = jobs.match(L.streamed_events(spark, sf_dir), processed=F.lit(PROCESSED), key="md5")
    return collected(spark, stream, "match")


@query("stream_count", f"""{TOKENS} SELECT cast(year(make_timestamp(s*1000000)) AS INT) AS year,
 cast(month(make_timestamp(s*1000000)) AS INT) AS month, count(DISTINCT unit) AS n_distinct FROM t GROUP BY ALL""")
def stream_count(spark, sf_dir):
    firsts = st.first_seen_units(L.streamed_events(spark, sf_dir))
    return st.counts_of_first_seen(collected(spark, firsts, "count"))


_MONTHS = "cast(year(make_timestamp(s*1000000)) AS INT) AS year, cast(month(make_timestamp(s*1000000)) AS INT) AS month"


@query("stream_count_bitmaps", f"""{TOKENS}, u AS (SELECT {_MONTHS}, unit FROM t)
SELECT year, month, count(DISTINCT unit) AS n_distinct FROM u GROUP BY ALL
UNION ALL SELECT year, NULL, count(DISTINCT unit) FROM u GROUP BY ALL""")
def stream_count_bitmaps(spark, sf_dir):
    """Per month, and per year from the same bitmaps."""
    folder = fresh_folder(spark, "bitmaps")
    table = DistinctBitmaps(spark, f"{folder}/state", {"year": "int", "month": "int"}, lambda b: dated_units(b, "token"))
    st.each_batch(L.streamed_events(spark, sf_dir), table, f"{folder}/checkpoint").awaitTermination()
    years = table.counts(["year"]).withColumn("month", F.lit(None).cast("int"))
    return table.counts().unionByName(years)


@query("stream_distinct", f"""{PLAIN} SELECT count(*) AS attempted, count(*) AS parsed, true AS within FROM l""")
def stream_distinct(spark, sf_dir):
    """Sketch per micro-batch, merged; compared with the exact count."""
    from logweir.operators.counting import within_bound

    folder = fresh_folder(spark, "sketches")
    lines = L.streamed_events(spark, sf_dir)
    st.each_batch(lines, st.sketch_sink(f"{folder}/out"), f"{folder}/checkpoint").awaitTermination()
    totals = st.sketch_totals(spark.read.parquet(f"{folder}/out"))
    exact = parse_date(L.events(spark, sf_dir)).agg(F.count_distinct("msg")).scalar()
    return totals.select("attempted", "parsed", within_bound(F.col("approx_distinct"), exact).alias("within"))


@query("stream_dedup", f"""{PLAIN} SELECT DISTINCT {group(2, R3)} AS msg FROM l WHERE regexp_matches(line, '{R3}')""")
def stream_dedup(spark, sf_dir):
    from logweir.operators.parsing import parse_payload

    firsts = st.dedup(L.streamed_events(spark, sf_dir), "payload_only")
    return parse_payload(collected(spark, firsts, "dedup"), "value").select("msg")


@query("stream_dedup_bloom", f"""{PLAIN} SELECT count(DISTINCT {group(2, R3)}) AS n_exact, 0 AS n_repeats, true AS within
FROM l WHERE regexp_matches(line, '{R3}')""")
def stream_dedup_bloom(spark, sf_dir):
    """No repeat passes, and fewer first arrivals are lost than the filter's rate says."""
    from logweir.operators.bloom import BloomTable
    from logweir.operators.parsing import parse_payload

    folder, rate = fresh_folder(spark, "bloom"), 0.01
    exact = parse_payload(L.events(spark, sf_dir), anchored=True).agg(F.count_distinct("msg").alias("n")).first()["n"]
    table = BloomTable(spark, f"{folder}/filter", max(1, exact), rate)
    sink = st.bloom_dedup_sink(table, f"{folder}/out", ["event_id"], "payload_only")
    st.each_batch(L.streamed_events(spark, sf_dir), sink, f"{folder}/checkpoint").awaitTermination()
    passed = parse_payload(spark.read.parquet(f"{folder}/out"), "value").agg(F.count("*").alias("n"), F.count_distinct("msg").alias("d"))
    return passed.select(
        F.lit(exact).alias("n_exact"), (F.col("n") - F.col("d")).cast("int").alias("n_repeats"), (exact - F.col("d") <= rate * exact).alias("within"),
    )


@query("stream_time_match", f"""{PLAIN} SELECT DISTINCT {group(1, R2)}::BIGINT // 10 * 10 AS start_s, md5(line) AS key,
 {VALUE} AS value FROM l WHERE regexp_matches(line, '{R2}') AND contains({group(5, R2)}, 'IRQ')""")
def stream_time_match(spark, sf_dir):
    stream = st.time_match(L.streamed_events(spark, sf_dir), "1 hour", processed=F.lit(PROCESSED), key="md5")
    return start_s(collected(spark, stream, "time-match"))


@query("stream_time_count", f"""{TOKENS},
 w AS (SELECT *, unnest(range((s - 86400) // 43200 * 43200 + 43200, s + 1, 43200)) AS start_s FROM t)
SELECT start_s, count(DISTINCT unit) AS n_distinct FROM w
WHERE start_s + 86400 <= (SELECT max(s) - 3600 FROM t) GROUP BY 1""")
def stream_time_count(spark, sf_dir):
    stream = st.time_count(L.streamed_events(spark, sf_dir), "1 hour", 86400, 43200)
    return start_s(collected(spark, stream, "time-count"))


def _payloads(placed):
    return with_unit(parse_date(placed), "payload")


@query("stream_bucket_count", f"{PLACED_MSG}, {sliding_rows_floor(1000, 100, 'm', 'count(DISTINCT unit) AS n_distinct')}")
def stream_bucket_count(spark, sf_dir):
    folder = fresh_folder(spark, "bucket-count")
    sink = DistinctPerCountWindow(spark, f"{folder}/windows", ["event_id"], 1000, 100, units=_payloads)
    st.each_batch(L.streamed_events(spark, sf_dir), sink, f"{folder}/checkpoint").awaitTermination()
    return sink.results().select("window_id", "n_distinct")


@query("stream_bucket_count_partitions", f"""{PLAIN}, i AS (SELECT cast(event_id % 16 AS INT) AS part, event_id // 16 AS i,
 count(*) OVER (PARTITION BY event_id % 16) AS n, line FROM l),
 m AS (SELECT part, i, n, {group(2, R3)} AS unit FROM i WHERE regexp_matches(line, '{R3}')),
 {sliding_rows_floor(100, 50, 'm', 'count(DISTINCT unit) AS n_distinct, count(*) AS n_rows', ', part')}""")
def stream_bucket_count_partitions(spark, sf_dir):
    """Windows per log partition."""
    folder = fresh_folder(spark, "bucket-count")
    rows = L.streamed_events(spark, sf_dir).withColumn("part", F.expr("cast(event_id % 16 as int)"))
    sink = DistinctPerCountWindow(
        spark, f"{folder}/windows", ["event_id"], 100, 50, units=_payloads, keys={"part": "int"})
    st.each_batch(rows, sink, f"{folder}/checkpoint").awaitTermination()
    return sink.results()


@query("stream_bucket_match", f"""{PLACED_TIMED} SELECT DISTINCT i // 1000 AS window_id, line FROM i
WHERE (i // 1000) * 1000 + 1000 < n AND regexp_matches(line, '{R2}') AND contains({group(5, R2)}, 'IRQ')""")
def stream_bucket_match(spark, sf_dir):
    folder = fresh_folder(spark, "bucket-match")
    sink = MatchesPerCountWindow(spark, f"{folder}/windows", ["event_id"], 1000)
    st.each_batch(L.streamed_events(spark, sf_dir), sink, f"{folder}/checkpoint").awaitTermination()
    return sink.results().select("window_id", "line")


@query("stream_bucket_match_sliding", f"""{PLACED_TIMED},
 w AS (SELECT *, unnest(range(greatest(0, i // 250 - 3), i // 250 + 1)) AS window_id FROM i
 WHERE regexp_matches(line, '{R2}') AND contains({group(5, R2)}, 'IRQ'))
SELECT DISTINCT window_id, md5(line) AS key, {VALUE} AS value FROM w WHERE window_id * 250 + 1000 < n""")
def stream_bucket_match_sliding(spark, sf_dir):
    folder = fresh_folder(spark, "bucket-match")
    sink = MatchesPerCountWindow(
        spark, f"{folder}/windows", ["event_id"], 1000, 250, processed=F.lit(PROCESSED), key="md5")
    st.each_batch(L.streamed_events(spark, sf_dir), sink, f"{folder}/checkpoint").awaitTermination()
    return sink.results().select("window_id", "key", "value")


@query("stream_time_count_dense", f"""{TIMED}, c AS (SELECT s // 60 * 60 AS start_s, count(*) AS n FROM p GROUP BY 1)
SELECT k.start_s, coalesce(n, 0) AS n FROM (SELECT unnest(range(min(start_s), (SELECT max(s) FROM p) - 3600 - 59, 60)) AS start_s FROM c) k
 LEFT JOIN c USING (start_s)""")
def stream_time_count_dense(spark, sf_dir):
    """Rows per minute, minutes without rows too, up to an hour behind the newest."""
    folder = fresh_folder(spark, "dense")
    sink = DenseTimeWindows(spark, f"{folder}/windows", "ts", 60, delay=3600)
    rows = parse_dated(L.streamed_events(spark, sf_dir)).select("ts")
    st.each_batch(rows, sink, f"{folder}/checkpoint").awaitTermination()
    return start_s(sink.results())


@query("stream_time_ordered", f"""{PLAIN}, o AS (SELECT event_id, epoch_us(ts) // 1000000 + (user_id % 97 - 48) * 3600 AS t FROM events)
SELECT event_id, t, row_number() OVER (ORDER BY t, event_id) - 1 AS place FROM o""")
def stream_time_ordered(spark, sf_dir):
    """Events up to two days early or late, in the order of their times over all batches."""
    folder = fresh_folder(spark, "ordered")
    shifted = F.unix_seconds(F.col("ts").cast("timestamp")) + (F.col("user_id") % 97 - 48) * 3600
    rows = L.in_batches(spark, sf_dir, "events", "event_id").select("event_id", shifted.alias("t"))
    sink = TimeOrdered(spark, f"{folder}/ordered", "event_id bigint, t bigint", lambda: F.col("t") * 1_000_000, ["event_id"], 4 * 86_400)
    st.each_batch(rows, sink, f"{folder}/checkpoint").awaitTermination()
    sink.finish()
    return with_row_index(sink.results(), ["batch_id", "place"], index="at").select("event_id", "t", F.col("at").alias("place"))


@query("stream_time_gap_count", f"""{TOKENS} SELECT s // 86400 * 86400 AS start_s, count(DISTINCT unit) AS n_distinct
FROM t WHERE s % 86400 < 43200 AND s // 86400 * 86400 + 86400 <= (SELECT max(s) - 3600 FROM t) GROUP BY 1""")
def stream_time_gap_count(spark, sf_dir):
    """Half days with half days between them."""
    stream = st.time_count(L.streamed_events(spark, sf_dir), "1 hour", 43200, 86400)
    return start_s(collected(spark, stream, "time-gap-count"))


@query("stream_time_gap_match", f"""{PLAIN} SELECT DISTINCT {group(1, R2)}::BIGINT // 20 * 20 AS start_s, md5(line) AS key,
 {VALUE} AS value FROM l WHERE regexp_matches(line, '{R2}') AND contains({group(5, R2)}, 'IRQ') AND {group(1, R2)}::BIGINT % 20 < 10""")
def stream_time_gap_match(spark, sf_dir):
    stream = st.time_match(
        L.streamed_events(spark, sf_dir), "1 hour", 10, processed=F.lit(PROCESSED), key="md5", slide=20)
    return start_s(collected(spark, stream, "time-gap-match"))


@query("stream_upsert", f"""{PLAIN} SELECT {group(2, R2)} AS key, arg_max({group(5, R2)}, event_id) AS value FROM l GROUP BY 1""")
def stream_upsert(spark, sf_dir):
    from logweir.operators.parsing import parse_event

    folder = fresh_folder(spark, "upsert")
    rows = parse_event(L.streamed_events(spark, sf_dir)).select(
        "event_id", F.col("username").alias("key"), F.col("msg").alias("value"))
    table = KeyedTable(spark, f"{folder}/table", rows.select("key", "value").schema, "key")
    st.each_batch(rows, table.sink(["event_id"]), f"{folder}/checkpoint").awaitTermination()
    return table.current()


@query("stream_word_count", "WITH w AS (SELECT unnest(string_split(text, ' ')) AS word FROM documents) SELECT word, count(*) AS n FROM w WHERE word <> '' GROUP BY word")
def stream_word_count(spark, sf_dir):
    """Running counts in update mode, upserted by word. Words grow with the table, so their
    state is on disk, not on the heap."""
    folder = fresh_folder(spark, "words")
    words = L.in_batches(spark, sf_dir, "documents", "doc_id").select(F.explode(tokens("text")).alias("word"))
    counts = st.word_count(words)
    table = KeyedTable(spark, f"{folder}/table", counts.schema, "word")
    with st.on_rocksdb(spark):
        st.each_batch(counts, table.sink(), f"{folder}/checkpoint", mode="update").awaitTermination()
    return table.current()


@query("stream_first_seen_urls")
def stream_first_seen_urls(spark, sf_dir):
    from .device_queries import PATTERN

    return collected(spark, st.new_links(L.in_batches(spark, sf_dir, "pages", "page_id"), PATTERN), "links")


def _same_as_batch():
    from .device_queries import DUCK_LINKS

    ORACLES["stream_first_seen_urls"] = f"{DUCK_LINKS} SELECT DISTINCT md5(link) AS link_key, link FROM l"


_same_as_batch()
