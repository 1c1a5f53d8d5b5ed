"""Parse log lines into typed columns.

Each parser takes a frame with a text column and returns its well-formed rows
with the fields added; other columns ride along. Works on batch and streaming
frames alike.

One regex pass per line: the match is rewritten to marked pieces, and a 0-or-1
row ``explode`` both drops lines that did not match and hands on the pieces.
Catalyst does not push later filters below the explode, so the regex is neither
run again per field nor again for the filter, and all of it is one codegen span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import patterns as P
from ..functions.columns import has_literal, unit_bytes, utc_second

_TEXT, _PIECES = "__marked", "__pieces"


def _pieces(df: DataFrame, line: str, fmt: P.LineFormat, keep_rejected: bool = False) -> DataFrame:
    marked = F.regexp_replace(F.col(line), F.lit(fmt.pattern), F.lit(fmt.replacement))
    if fmt.starts_with:  # a failed anchored match costs nothing
        marked = F.when(F.col(line).startswith(fmt.starts_with), marked).otherwise(F.col(line))
    # a rewritten line never equals its source, so inequality is the match test
    found = F.when(
        F.col(_TEXT) != F.col(line), F.array(F.split(_TEXT, P.MARK, fmt.pieces))
    )
    explode = F.explode_outer if keep_rejected else F.explode
    return df.withColumn(_TEXT, marked).select(*df.columns, explode(found).alias(_PIECES))


def _piece(i: int) -> Column:
    return F.col(_PIECES)[i]


def _typed(df: DataFrame, base: list[str], required: list[str], **fields: Column) -> DataFrame:
    """Add or replace typed fields; a number too big for its type rejects the line."""
    out = df.select(*[b for b in base if b not in fields], *[c.alias(n) for n, c in fields.items()])
    for name in required:
        out = out.where(F.col(name).isNotNull())
    return out


def parse_date(df: DataFrame, line: str = "line") -> DataFrame:
    """year, month, day, msg."""
    return _typed(
        _pieces(df, line, P.DATE),
        df.columns,
        ["year", "month", "day"],
        year=_piece(1).try_cast("int"),
        month=_piece(2).try_cast("int"),
        day=_piece(3).try_cast("int"),
        msg=_piece(4),
    )


def parse_event(df: DataFrame, line: str = "line", strict_sep: bool = False) -> DataFrame:
    """epoch_s, ts, username, sep, nodename, msg.

    A token without a separator is cut by backtracking, as the pattern reads.
    ``strict_sep`` takes only a real separator and else leaves user and sep null.
    """
    epoch = _piece(1).try_cast("bigint")
    if strict_sep:
        no_user = _piece(2) == ""
        return _typed(
            _pieces(df, line, P.STRICT_EVENT),
            df.columns,
            ["epoch_s"],
            epoch_s=epoch,
            ts=F.timestamp_seconds(epoch),
            username=F.when(~no_user, _piece(2)),
            sep=F.when(~no_user, _piece(3)),
            nodename=_piece(4),
            msg=_piece(5),
        )
    return _typed(
        _pieces(df, line, P.EVENT),
        df.columns,
        ["epoch_s"],
        epoch_s=epoch,
        ts=F.timestamp_seconds(epoch),
        username=_piece(2),
        sep=F.substring(_piece(4), 1, 1),
        nodename=_piece(3),
        msg=F.substr(_piece(4), F.lit(2)),
    )


def parse_payload(df: DataFrame, line: str = "line", anchored: bool = False) -> DataFrame:
    """epoch_s, msg. Unanchored finds the shape behind any prefix."""
    fmt = P.PAYLOAD if anchored else P.PAYLOAD_FOUND
    return _typed(
        _pieces(df, line, fmt),
        df.columns,
        ["epoch_s"],
        epoch_s=_piece(1).try_cast("bigint"),
        msg=_piece(2),
    )


def parse_dated(df: DataFrame, line: str = "line") -> DataFrame:
    """epoch_s, ts, year, month, day, msg: both times of a line in one pass."""
    epoch = _piece(1).try_cast("bigint")
    return _typed(
        _pieces(df, line, P.DATED),
        df.columns,
        ["epoch_s", "year", "month", "day"],
        epoch_s=epoch,
        ts=F.timestamp_seconds(epoch),
        year=_piece(2).try_cast("int"),
        month=_piece(3).try_cast("int"),
        day=_piece(4).try_cast("int"),
        msg=_piece(5),
    )


def parse_latency(df: DataFrame, line: str = "line") -> DataFrame:
    """second, p50, p999 (microseconds)."""
    return _typed(
        _pieces(df, line, P.LATENCY),
        df.columns,
        ["second", "p50", "p999"],
        second=utc_second(_piece(1)),
        p50=_piece(2).try_cast("bigint"),
        p999=_piece(3).try_cast("bigint"),
    )


def parse_throughput(df: DataFrame, line: str = "line") -> DataFrame:
    """second, qps, duration_us."""
    return _typed(
        _pieces(df, line, P.THROUGHPUT),
        df.columns,
        ["second", "qps", "duration_us"],
        second=utc_second(_piece(1)),
        qps=_piece(2).try_cast("bigint"),
        duration_us=_piece(3).try_cast("bigint"),
    )


def parse_hardware(df: DataFrame, line: str = "line") -> DataFrame:
    """second, cpu1, cpu5, total_mem, free_mem (memory in bytes)."""
    number = {n: _piece(i).try_cast("double") for n, i in
              (("cpu1", 2), ("cpu5", 3), ("total", 4), ("free", 6))}
    return _typed(
        _pieces(df, line, P.HARDWARE),
        df.columns,
        ["second", "cpu1", "cpu5", "total_mem", "free_mem"],
        second=utc_second(_piece(1)),
        cpu1=number["cpu1"],
        cpu5=number["cpu5"],
        total_mem=unit_bytes(number["total"], _piece(5)),
        free_mem=unit_bytes(number["free"], _piece(7)),
    )


# format, type of its numeric pieces, their places, place of the payload
_FORMATS = {
    "date": (P.DATE, "int", (1, 2, 3), 4),
    "event": (P.EVENT, "bigint", (1,), None),
    "payload": (P.PAYLOAD, "bigint", (1,), 2),
    "payload_found": (P.PAYLOAD_FOUND, "bigint", (1,), 2),
}


def with_parse_flag(
    df: DataFrame, fmt: str = "event", line: str = "line", payload: str | None = None
) -> DataFrame:
    """All rows, with boolean ``parsed`` and, if named, the payload (null when rejected)."""
    shape, kind, numeric, text = _FORMATS[fmt]
    ok = F.col(_PIECES).isNotNull()
    for i in numeric:
        ok = ok & _piece(i).try_cast(kind).isNotNull()
    out = _pieces(df, line, shape, keep_rejected=True).select(
        *df.columns, _PIECES, F.coalesce(ok, F.lit(False)).alias("parsed")
    )
    if payload is None:
        return out.drop(_PIECES)
    return out.select(
        *df.columns, "parsed", F.when(F.col("parsed"), _piece(text)).alias(payload)
    )


def rejected_lines(df: DataFrame, fmt: str = "event", line: str = "line") -> DataFrame:
    """The side output of a parser: the rows it drops."""
    return with_parse_flag(df, fmt, line).where(~F.col("parsed")).drop("parsed")


def parse_stats(df: DataFrame, fmt: str = "date", line: str = "line") -> DataFrame:
    """One row: lines attempted, parsed and rejected."""
    return (
        with_parse_flag(df, fmt, line)
        .agg(
            F.count("*").alias("attempted"),
            F.count_if("parsed").alias("parsed"),
            F.count_if(~F.col("parsed")).alias("rejected"),
        )
    )


def matching(
    df: DataFrame, literal: str = P.MATCH_LITERAL, scope: str = "payload", line: str = "line",
    strict_sep: bool = False,
) -> DataFrame:
    """Parsed events holding ``literal`` in the payload or anywhere in the line.

    The line test runs first either way: it is implied by the payload test and
    spares most lines the regex.
    """
    if scope not in ("payload", "line"):
        raise ValueError(f"unknown scope {scope!r}")
    out = parse_event(df.where(has_literal(line, literal)), line, strict_sep)
    return out.where(has_literal("msg", literal)) if scope == "payload" else out
