"""Scalar expressions over log fields. All are built-in JVM-side functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .patterns import FILL_KEY_BYTES, MATCH_LITERAL, UNIT_BYTES


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utc_parts(epoch_s: Column) -> tuple[Column, Column, Column, Column]:
    """Date, hour, minute and second in UTC, whatever the session's time zone."""
    rest = F.pmod(epoch_s, F.lit(86_400))
    date = F.date_from_unix_date(F.floor((epoch_s - rest) / 86_400).cast("int"))
    return date, F.floor(rest / 3600).cast("int"), F.floor(F.pmod(rest, F.lit(3600)) / 60).cast("int"), F.pmod(rest, F.lit(60)).cast("int")


def iso_time(epoch_s: Column | str) -> Column:
    """ISO-8601 text of epoch seconds, in UTC."""
    date, *clock = utc_parts(col_of(epoch_s))
    hms = F.concat_ws(":", *[F.lpad(c.cast("string"), 2, "0") for c in clock])
    return F.concat(date.cast("string"), F.lit("T"), hms, F.lit("Z"))


def utc_second(text: Column) -> Column:
    """The instant of a ``yyyy-MM-dd HH:mm:ss`` text read as UTC, null if it is none."""
    local = text.try_cast("timestamp_ntz")
    seconds = F.unix_date(local.cast("date")).cast("bigint") * 86_400 + F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)
    return F.timestamp_seconds(seconds)


def epoch_second(ts: Column | str) -> Column:
    """Epoch seconds of an instant, or of a time without zone read as UTC.

    ``typeof`` is known when the plan is made, so one of the branches is left.
    """
    ts = col_of(ts)
    local = F.unix_date(ts.cast("date")).cast("bigint") * 86_400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return F.when(F.typeof(ts) == "timestamp_ntz", local).otherwise(F.unix_seconds(ts.cast("timestamp")))


def sheet_date(ts: Column | str) -> Column:
    """Unpadded date column of the report files, in UTC."""
    date, *_ = utc_parts(epoch_second(ts))
    return F.concat(F.lpad(F.year(date).cast("string"), 4, "0"), F.lit("-"), F.concat_ws("-", F.month(date), F.day(date)))


def sheet_time(ts: Column | str) -> Column:
    """Unpadded time column of the report files, in UTC."""
    _, *clock = utc_parts(epoch_second(ts))
    return F.concat_ws(":", *clock)


def month_key(month: Column | str, year: Column | str) -> Column:
    return F.concat_ws("-", col_of(month).cast("int"), col_of(year).cast("int"))


def unit_bytes(n: Column | str, unit: Column | str) -> Column:
    """A size with a two-letter unit as bytes; an unknown unit leaves it as it is."""
    factor = F.lit(1.0)
    for name, size in UNIT_BYTES.items():
        factor = F.when(col_of(unit) == name, F.lit(float(size))).otherwise(factor)
    return col_of(n) * factor


def has_literal(text: Column | str, literal: str = MATCH_LITERAL) -> Column:
    return col_of(text).contains(literal)


def message_key(line: Column | str, kind: str = "xxhash64") -> Column:
    """Unique key of a message: 64-bit hash, or md5 text where engines must agree."""
    if kind == "xxhash64":
        return F.xxhash64(col_of(line))
    if kind == "md5":
        return F.md5(col_of(line))
    raise ValueError(f"unknown key kind {kind!r}")


def event_value(
    processed: Column,
    epoch_s: Column | str = "epoch_s",
    username: Column | str = "username",
    sep: Column | str = "sep",
    nodename: Column | str = "nodename",
    msg: Column | str = "msg",
) -> Column:
    """``processed:event time:user<sep>node:payload``; absent user and separator are left out."""
    blank = F.lit("")
    who = F.concat(
        F.coalesce(col_of(username), blank), F.coalesce(col_of(sep), blank), col_of(nodename)
    )
    return F.concat_ws(":", processed, iso_time(epoch_s), who, col_of(msg))


def fill_key(line: Column | str, n_bytes: int = FILL_KEY_BYTES) -> Column:
    """The first bytes of a line; cuts bytes, not characters."""
    return F.substring(F.encode(col_of(line), "UTF-8"), 1, n_bytes)


def url_key(url: Column | str) -> Column:
    return F.md5(col_of(url))


def tokens(text: Column | str) -> Column:
    """Space-delimited strings of a text, without empty ones."""
    return F.filter(F.split(col_of(text), " "), lambda t: t != "")


def source_label(path: Column | str) -> Column:
    """Column prefix of a report file: its path from the first part with a leading digit on."""
    path = col_of(path)
    tail = F.regexp_replace(F.regexp_extract(path, r"(?:^|/)([0-9].*)$", 1), "/", "")
    label = F.when(tail == "", path).otherwise(tail)
    return F.regexp_replace(F.translate(label, ":/.-", "____"), "^_+", "")


def member_name(archive: Column | str, extension: str = "txt") -> Column:
    """Name of the file expected inside an archive: same stem, other extension."""
    base = F.element_at(F.split(col_of(archive), "/"), -1)
    return F.concat(F.regexp_replace(base, r"\.[^.]*$", ""), F.lit(f".{extension}"))
