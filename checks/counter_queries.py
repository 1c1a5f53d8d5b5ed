"""Counters in the same pass, late rows, and jobs over files they wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from logweir.operators import counting
from logweir.operators.metrics import latency_by_second
from logweir.operators.ordering import with_row_index
from logweir.operators.parsing import parse_event
from logweir.session import fresh_folder
from logweir.sinks.writers import write_report
from logweir.sources.files import read_table, read_words
from logweir.streaming import jobs as st
from logweir.streaming.counters import StreamCounters, observed
from logweir.streaming.watermarked import TimeOrdered

from . import lines as L
from .metric_queries import LAT, LAT_S, in_seconds, latency
from .registry import query

#: A seventh of the lines cannot be parsed.
TORN = f"if(event_id % 7 = 3, substr({L.EVENT_TEXT}, 3), {L.EVENT_TEXT})"
DUCK_TORN = f"CASE WHEN event_id % 7 = 3 THEN substr({L.DUCK_EVENT_TEXT}, 3) ELSE {L.DUCK_EVENT_TEXT} END"
BATCHED = f"""WITH b AS (SELECT *, ({DUCK_TORN}) AS line, (event_id - min(event_id) OVER ()) //
 ((max(event_id) OVER () - min(event_id) OVER ()) // {L.BATCHES} + 1) AS batch_id FROM events)"""


@query("stream_counters", f"""{BATCHED} SELECT batch_id, count(*) AS attempted, sum(strlen(line))::bigint AS bytes, min(event_id) AS first_offset,
 max(event_id) AS last_offset, count(*) FILTER (event_id % 7 <> 3) AS parsed, 0::bigint AS late FROM b GROUP BY 1""")
def stream_counters(spark, sf_dir):
    """Lines, bytes, offsets and parsed rows of each micro-batch, while the stream is stored."""
    stream = L.in_batches(spark, sf_dir, "events", "event_id").select(F.col("event_id").alias("offset"), F.expr(TORN).alias("line"))
    counters = StreamCounters("events")
    spark.streams.addListener(counters)
    try:
        folder = fresh_folder(spark, "counted")
        run = st.append_to(observed(stream, "events", parse_event), f"{folder}/out", f"{folder}/checkpoint")
        run.awaitTermination()
        counters.wait(run.runId)
    finally:
        spark.streams.removeListener(counters)
    return counters.table(spark, run.id)


LATE_AFTER = 10 * 86400


@query("late_rows", f"""WITH b AS (SELECT *, (user_id - min(user_id) OVER ()) //
 ((max(user_id) OVER () - min(user_id) OVER ()) // {L.BATCHES} + 1) AS batch_id FROM events),
 m AS (SELECT batch_id, max(ts) AS top FROM b GROUP BY 1),
 s AS (SELECT batch_id, max(top) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM m)
SELECT b.batch_id, event_id FROM b JOIN s USING (batch_id) WHERE ts < seen - INTERVAL {LATE_AFTER} SECOND""")
def late_rows(spark, sf_dir):
    """Rows whose time the watermark of the batches before has passed. The stream comes by
    users, so every batch spans the whole time."""
    stream = L.in_batches(spark, sf_dir, "events", "user_id").select("event_id", "ts")
    sink = TimeOrdered(
        spark, fresh_folder(spark, "late"), "event_id bigint, ts timestamp_ntz",
        lambda: F.unix_micros(F.col("ts").cast("timestamp")), ["event_id"], LATE_AFTER,
    )
    st.each_batch(stream, sink, f"{fresh_folder(spark, 'late')}/checkpoint").awaitTermination()
    return sink.late().select("batch_id", "event_id")


@query("words_file", """SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY 1""")
def words_file(spark, sf_dir):
    """Words written to comma-separated files and read back by their separator."""
    folder = fresh_folder(spark, "words")
    words = read_table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word"))
    words.write.option("lineSep", ",").text(folder)
    return counting.count_by_key(read_words(spark, folder), "word")


@query("report_files", f"""WITH {LAT}, {LAT_S} SELECT row_number() OVER (ORDER BY second_s) - 1 AS place, second_s, p50, p999 FROM lat_s""")
def report_files(spark, sf_dir):
    """A report written as CSV files in time order, read back in the order of files and lines."""
    folder = fresh_folder(spark, "report")
    report = in_seconds(latency_by_second(latency(spark, sf_dir)))
    write_report(report, folder, ["second_s"])
    stored = spark.read.option("header", True).schema(report.schema).csv(folder)
    placed = stored.select(
        "*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"),
    )
    indexed = with_row_index(placed, ["file", "block", "at"])
    return indexed.select(F.col("row_idx").cast("bigint").alias("place"), *report.columns)


@query("random_rows", """SELECT least(5, count(*))::bigint AS n, least(5, count(*))::bigint AS n_distinct, least(5, count(*))::bigint AS n_known,
 true AS same_again FROM events""")
def random_rows(spark, sf_dir):
    """What holds of five random rows: all different, all of the table, and the same again
    with the same seed."""
    ids = read_table(spark, sf_dir, "events").select("event_id")
    draws = [counting.random_rows(ids, 5, seed=11).withColumn("draw", F.lit(k)) for k in (0, 1)]
    picked = draws[0].unionByName(draws[1]).groupBy("event_id").agg(
        F.count_if(F.col("draw") == 0).alias("first"), F.count_if(F.col("draw") == 1).alias("again")
    )
    known = ids.withColumn("known", F.lit(1))
    return picked.join(known, "event_id", "left").agg(
        F.sum("first").alias("n"), F.count_if(F.col("first") > 0).alias("n_distinct"), F.sum("known").alias("n_known"),
        F.bool_and(F.col("first") == F.col("again")).alias("same_again"),
    )
