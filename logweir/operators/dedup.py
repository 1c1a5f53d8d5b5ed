"""De-duplication: whole stream or per batch, exact or by hash.

The kept row is the first in arrival order, given by the caller. Every form is
one grouped minimum, combined on the map side: a line that makes up a third of
the input shrinks to one row per map task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.patterns import PAYLOAD
from .parsing import parse_payload


def first_by(df: DataFrame, key: Column, order: list[str], keep: list[Column]) -> DataFrame:
    """For each key the ``keep`` columns of its first row in ``order``."""
    names = [f"__o{i}" for i in range(len(order))]
    first = F.min(F.struct(*[F.col(o).alias(n) for o, n in zip(order, names)], *keep))
    grouped = df.groupBy(key.alias("__key")).agg(first.alias("__first"))
    return grouped.select("__key", "__first.*").withColumnsRenamed(dict(zip(names, order)))


def dedup_lines(df: DataFrame, order: list[str], line: str = "line", ordered: bool = False) -> DataFrame:
    """First arrival of every distinct well-formed line: arrival, epoch_s, line.

    The time comes out of the line itself, so only the arrival is carried.
    """
    df = df.where(F.col(line).startswith(PAYLOAD.starts_with))  # spare the shuffle what cannot parse
    if len(order) == 1:  # one fixed-width minimum: hash aggregation throughout
        firsts = df.groupBy(line).agg(F.min(order[0]).alias(order[0]))
    else:
        firsts = first_by(df, F.col(line), order, []).withColumnRenamed("__key", line)
    out = parse_payload(firsts, line, anchored=True).select(*order, "epoch_s", line)
    return in_time_order(out, order) if ordered else out


def dedup_payloads(
    df: DataFrame, order: list[str], line: str = "line", anchored: bool = True, ordered: bool = False
) -> DataFrame:
    """First arrival of every distinct payload: arrival, epoch_s, line.

    A line ends in its payload, which is the group key; only the text before it
    is carried through the shuffle and the line is put together again after.
    """
    parsed = parse_payload(df, line, anchored)
    head = F.expr(f"left(`{line}`, length(`{line}`) - length(msg))").alias("__head")
    firsts = first_by(parsed, F.col("msg"), order, [F.col("epoch_s"), head])
    out = firsts.select(*order, "epoch_s", F.concat("__head", "__key").alias(line))
    return in_time_order(out, order) if ordered else out


def dedup_by_hash(df: DataFrame, text: str, order: list[str], keep: list[str] = ()) -> DataFrame:
    """Approximate dedup on the 64-bit hash of a text: never lets a duplicate
    through, may drop a first arrival whose hash is taken (n*n / 2**65)."""
    key = F.xxhash64(text)
    if len(order) == 1 and not keep:
        return df.groupBy(key.alias("__key")).agg(F.min(order[0]).alias(order[0])).drop("__key")
    return first_by(df, key, order, [F.col(k) for k in keep]).drop("__key")


def distinct_per_batch(df: DataFrame, batch: str, cols: list[str]) -> DataFrame:
    """Distinct rows inside each batch; the same row may come again in the next."""
    return df.select(batch, *cols).distinct()


def unseen(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key no earlier run has recorded."""
    return df.join(seen.select(key), key, "left_anti")


def in_time_order(df: DataFrame, order: list[str], time: str = "epoch_s") -> DataFrame:
    return df.orderBy(time, *order)


def keyed_by_millis(df: DataFrame, line: str = "line") -> DataFrame:
    """Message rows: key is the event time in ms as text, value the whole line."""
    return df.select(
        (F.col("epoch_s") * 1000).cast("string").alias("key"), F.col(line).alias("value")
    )
