"""The named jobs, end to end. Each is a function of frames: give it a batch
frame for a result table, or (where it says so) a stream."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import event_value, iso_time, message_key, source_label
from ..functions.patterns import MATCH_LITERAL
from ..operators import alignment, counting, dedup as dd, devices, links, metrics, windows as W
from ..operators.parsing import (
    matching, parse_date, parse_dated, parse_hardware, parse_latency, parse_payload, parse_throughput,
)
from ..session import written_table
from ..sinks.keyed import KeyedTable
from ..sources.archives import unpack_records
from ..sources.files import METRIC_FILES, metric_files, read_metric_lines


def now_text() -> Column:
    return iso_time(F.unix_seconds(F.current_timestamp()))


def _key_value(
    events: DataFrame, processed: Column | None, key: str, line: str, *keep: Column | str
) -> DataFrame:
    processed = now_text() if processed is None else processed
    return events.select(
        *keep, message_key(line, key).alias("key"), event_value(processed).alias("value")
    )


# ------------------------------------------------------------------ single message


def dedup(
    df: DataFrame, order: list[str], mode: str = "entire_msg", exact: bool = True,
    line: str = "line", ordered: bool = True,
) -> DataFrame:
    """De-duplicated messages in time order: key is the event time in ms, value the line."""
    if mode not in ("entire_msg", "payload_only"):
        raise ValueError(f"unknown mode {mode!r}")
    rows = df.select(*order, line)
    if not exact:
        text = "msg" if mode == "payload_only" else line
        parsed = parse_payload(rows, line, anchored=True)
        firsts = dd.dedup_by_hash(parsed, text, order, ["epoch_s", line] if text == "msg" else [line, "epoch_s"])
    elif mode == "payload_only":
        firsts = dd.dedup_payloads(rows, order, line)
    else:
        firsts = dd.dedup_lines(rows, order, line)
    return dd.keyed_by_millis(dd.in_time_order(firsts, order) if ordered else firsts, line)


def match(
    df: DataFrame, literal: str = MATCH_LITERAL, scope: str = "payload", line: str = "line",
    processed: Column | None = None, key: str = "xxhash64", strict_sep: bool = False,
) -> DataFrame:
    """Key and value of every event holding the literal. Batch or stream."""
    return _key_value(matching(df, literal, scope, line, strict_sep), processed, key, line)


def count(
    df: DataFrame, unit: str = "token", exact: bool = True, line: str = "line",
    date_parts: str = "year_month", ordered: bool = False,
) -> DataFrame:
    """Distinct units per year and month, exact or by sketch; as a report, in their order."""
    units = counting.dated_units(df, unit, line, date_parts)
    if exact:
        counts = counting.distinct_by(units, ["year", "month"])
    else:
        sketches = counting.sketch_by(units, ["year", "month"])
        counts = sketches.select("year", "month", counting.estimate().alias("n_distinct"))
    return counts.orderBy("year", "month") if ordered else counts


def distinct_overall(df: DataFrame, batch: str, line: str = "line") -> tuple[DataFrame, DataFrame]:
    """Distinct payloads by sketch, per batch and overall, with line counts."""
    per_batch = counting.sketch_report(df, batch, line)
    overall = per_batch.agg(
        counting.estimate(F.hll_union_agg("sketch")).alias("approx_distinct"),
        F.sum("parsed").alias("parsed"),
        F.sum("attempted").alias("attempted"),
    )
    shown = per_batch.select(
        batch, counting.estimate().alias("approx_distinct"), "parsed", "attempted"
    )
    return shown, overall


# --------------------------------------------------------------------- time windows


def time_match(
    df: DataFrame, length: float = 10, slide: float = 10, literal: str = MATCH_LITERAL,
    scope: str = "payload", line: str = "line", processed: Column | None = None, key: str = "xxhash64",
) -> DataFrame:
    """The set of matches of each window: window_start, key, value. Batch or stream.

    Key and value are functions of the line, so only window and line are shuffled,
    and the lines that are left are parsed once more for their values.
    """
    events = W.in_time_windows(matching(df.select(line), literal, scope, line), "ts", length, slide)
    unique = events.select("window_start", line).distinct()
    return _key_value(matching(unique, literal, scope, line), processed, key, line, "window_start")


def time_count(
    df: DataFrame, length: float = 10, slide: float = 1, unit: str = "token", line: str = "line",
    by_month: bool = False, rows: str | None = None,
) -> DataFrame:
    """Distinct units per window (and month). ``rows`` names a count of units."""
    keys = ["year", "month"] if by_month else []
    parsed = parse_dated(df.select(line), line)
    units = counting.with_unit(parsed, unit, line).select("ts", *keys, "unit")
    return W.distinct_in_time_windows(units, "ts", length, slide, "unit", keys, rows=rows)


# -------------------------------------------------------------------- count windows


def bucket_match(
    df: DataFrame, order: list[str], length: int = 100_000, slide: int = 100_000,
    literal: str = MATCH_LITERAL, scope: str = "payload", line: str = "line",
    emit: str = "next_record", filter_first: bool = False, processed: Column | None = None,
    key: str = "xxhash64", partition_by: list[str] = (), given: bool = False,
) -> DataFrame:
    """The set of matches in each window of messages: window_id, key, value.

    All messages are numbered, over the whole log or within ``partition_by``, but
    only lines that can match travel with their number. ``filter_first`` makes it
    windows of matches instead. ``given``: see ``bucket_count``.
    """
    keys = list(partition_by)
    if filter_first and given:
        raise ValueError("given numbers are those of all messages; windows of matches are numbered anew")
    if filter_first:
        names = [f"__o{i}" for i in range(len(order))]
        places = [F.col(o).alias(n) for o, n in zip(order, names)]
        matches = matching(df.select(*keys, *places, line), literal, scope, line)
        rows = W.indexed(matches.select(*keys, *names, line), names, keys)
    else:
        text = F.when(F.col(line).contains(literal), F.col(line)).alias(line)
        rows = W.indexed(df.select(*dict.fromkeys([*keys, *order]), text), order, keys, given)
    inside = W.in_count_windows(rows.where(F.col(line).isNotNull()), length, slide, emit)
    window = ["window_id", *keys]
    unique = inside.select(*window, line).dropDuplicates([*window, line])
    return _key_value(matching(unique, literal, scope, line), processed, key, line, *window)


def bucket_count(
    df: DataFrame, order: list[str], length: int = 1_000_000, slide: int = 100_000,
    unit: str = "line", line: str = "line", emit: str = "next_record", rows: str | None = None,
    partition_by: list[str] = (), given: bool = False,
) -> DataFrame:
    """Distinct units in each window of messages, over the whole log or within
    ``partition_by``.

    Messages are numbered first; lines that do not parse still fill windows.
    ``given``: the order column already numbers the messages without gaps, as the
    offsets within a log partition do, which saves sorting them.
    """
    keys = list(partition_by)
    placed = W.indexed(df.select(*dict.fromkeys([*keys, *order]), line), order, keys, given)
    if unit in ("token", "payload"):
        placed = parse_date(placed, line)
    units = counting.with_unit(placed, unit, line)
    return W.distinct_in_count_windows(units, length, slide, "unit", keys, emit, rows)


# -------------------------------------------------------------------------- devices


def device_links(pages: DataFrame, seen: DataFrame | None, order: list[str], pattern: str = links.ARCHIVE) -> DataFrame:
    """Archive addresses on pages that no earlier run has seen (link_key in ``seen``)."""
    new = links.first_seen_links(links.page_links(pages, pattern=pattern, keep=order), order)
    return new if seen is None else dd.unseen(new, seen, "link_key")


def device_index(archives: DataFrame, index_date: Column | None = None) -> DataFrame:
    """Archives (path, content), or their records read by ranges (``read_members``), to
    documents with id key and JSON value."""
    records = archives if "fields" in archives.columns else unpack_records(archives)
    return devices.as_json(devices.device_documents(records, index_date))


def index_devices(
    archives: DataFrame, table: KeyedTable, run: int, index_date: Column | None = None
) -> DataFrame:
    """Upsert the documents of one run; gives them back with ``created``, false
    where a document with that id was there before."""
    documents = written_table(device_index(archives, index_date), "documents")
    table.upsert(documents, run)
    return table.with_created(documents, before=run)


# ---------------------------------------------------------------------------- words


def word_count(words: DataFrame, word: str = "word") -> DataFrame:
    """Count per word. Batch, or a stream in complete mode."""
    return counting.count_by_key(words, word)


# -------------------------------------------------------------------------- metrics

_PLACE = ["path", "block", "pos"]


def _folder_of(path: str) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def metric_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Per-second tables of all metric logs below a folder, by ``source`` (their folder)."""
    def lines(kind: str) -> DataFrame:
        return read_metric_lines(spark, folder, kind).withColumn("source", _folder_of("path"))

    return {
        "latency": metrics.latency_by_second(parse_latency(lines("latency")), ["source"]),
        "throughput": metrics.throughput_by_second(parse_throughput(lines("throughput")), ["source"]),
        "hardware": metrics.hardware_by_second(parse_hardware(lines("hardware")), _PLACE, ["source"]),
    }


def metric_folders(spark: SparkSession, folder: str) -> dict[tuple[str, str], str]:
    """The column label of every (kind, source folder), in the order of the folders.

    Folders whose names give one label are told apart by a number, so none are merged:
    ``label``, ``label_2`` and so on.
    """
    labels: dict[tuple[str, str], str] = {}
    for kind in METRIC_FILES:
        folders = metric_files(spark, folder, kind).select(_folder_of("path").alias("source")).distinct()
        label = F.concat_ws("_", F.lit(kind), source_label("source"))
        rows = folders.select("source", label.alias("label")).orderBy("label", "source").collect()
        taken = {r["label"] for r in rows}
        seen: set[str] = set()
        for r in rows:
            name, n = r["label"], 1
            while name in seen or (n > 1 and name in taken):
                n += 1
                name = f"{r['label']}_{n}"
            seen.add(name)
            labels[kind, r["source"]] = name
    return labels


def metric_report(spark: SparkSession, folder: str, stop: str | None = None) -> DataFrame:
    """The wide report: one block of columns per kind and source folder, by position.

    The list of source folders decides the columns, so it is read up front.
    """
    tables = metric_tables(spark, folder)
    labels = metric_folders(spark, folder)
    tagged, columns = [], {}
    for kind, table in tables.items():
        own = {source: label for (k, source), label in labels.items() if k == kind}
        named = F.lit(None).cast("string")
        if own:
            named = F.create_map(*[F.lit(x) for pair in own.items() for x in pair])[F.col("source")]
        tagged.append(table.withColumn("label", named).drop("source"))
        names = [c for c in table.columns if c != "source"]
        columns |= {label: names for label in own.values()}
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return alignment.zip_sources(union, "label", columns, ["second"], stop).orderBy("row_idx")
