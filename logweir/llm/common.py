"""Helpers that the operators share: tables, ranks in hot groups, word hashes, components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written_table

#: ASCII white space, as ``[^\x20\x09-\x0D]+`` sees it; ``bytes.split`` uses the same six.
WORD = r"[^\x20\x09-\x0D]+"
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Odd multipliers of the polynomial hashes, and those of the finalizer.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
#: Bytes hashed at once; a longer text is hashed in pieces cut at white space.
_CHUNK = 1 << 20


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def digits_for(rows: int, each: int = 20_000) -> int:
    """Hex digits of a hash that cut ``rows`` rows into buckets of about ``each``."""
    return max(0, math.ceil(math.log(max(1, rows) / each, 16)))


def ranked_within(
    rows: DataFrame, group: list[str], bucket: str, order: list[Column | str], rank: str = "rank",
    weight: str | None = None, before: str = "before",
) -> DataFrame:
    """Number the rows of each group from 0, and add the weight of those before.

    ``bucket`` cuts each group into parts that follow each other in ``order``; the
    parts are numbered on their own and shifted by the counts of the parts before
    them, so a hot group is spread over as many tasks as it has buckets. Group and
    bucket columns must not be null.
    """
    keys = [*group, bucket]
    amount = F.sum(weight) if weight else F.count("*")
    spans = rows.groupBy(*keys).agg(F.count("*").alias("__n"), amount.alias("__w"))
    earlier = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = spans.select(
        *keys,
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__n0"),
        F.coalesce(F.sum("__w").over(earlier), F.lit(0)).alias("__w0"),
    )
    inside = Window.partitionBy(*keys).orderBy(*order)
    numbered = rows.withColumn("__r", F.row_number().over(inside) - 1)
    if weight:
        numbered = numbered.withColumn(
            "__b", F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(weight)
        )
    joined = numbered.join(starts, keys).withColumn(rank, F.col("__n0") + F.col("__r"))
    if weight:
        joined = joined.withColumn(before, F.col("__w0") + F.col("__b"))
    return joined.drop("__r", "__b", "__n0", "__w0")


def hash_sample(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """One row of each of ``rows`` keys (of all, if fewer) by a hash of ``key``, for
    fitting; of rows that share a key, the least. The share of hashes that goes ahead of
    the ordering follows from the number of keys, not of rows, so repeated keys neither
    empty nor fill the sample, and what reaches one place is bounded however many tasks
    there are."""
    h = F.xxhash64(key)
    n = df.agg(F.approx_count_distinct(h)).first()[0]
    share = (2 * rows + 1000) / max(1, n)
    kept = df if share >= 1 else df.where(F.pmod(h, F.lit(1 << 30)) < int(share * (1 << 30)))
    each = kept.distinct().groupBy(h.alias("__h")).agg(F.min(F.struct(*df.columns)).alias("__row"))
    return each.orderBy("__h").limit(rows).select("__row.*")


# ------------------------------------------------------------------------- word hashes


def mix64(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers over all places."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(_MIX[0])
    h ^= h >> np.uint64(33)
    h *= np.uint64(_MIX[1])
    return h ^ (h >> np.uint64(33))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0..n-1 and their inverses modulo 2**64."""
    held = _POWERS.get(0)
    if held is None or len(held[0]) < n:
        size = max(n, _CHUNK + (1 << 16))
        base = _BASES[0]
        inverse = pow(base, -1, 1 << 64)
        with np.errstate(over="ignore"):
            up, down = np.full(size, base, np.uint64), np.full(size, inverse, np.uint64)
            up[0] = down[0] = 1
            held = _POWERS[0] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return held


def _hash_piece(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return starts, mix64((sums[ends] - sums[starts]) * down[starts])


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, and the first word's place of each
    text (one more at the end). Words are split at ASCII white space."""
    hashes, counts, group, size = [], [], [], 0

    def flush() -> None:
        nonlocal group, size
        if group:
            data = np.frombuffer(b"\n".join(group), np.uint8)
            at, h = _hash_piece(data)
            limits = np.cumsum([len(x) + 1 for x in group])
            counts.append(np.diff(np.searchsorted(at, limits), prepend=0))
            hashes.append(h)
            group, size = [], 0

    for text in texts:
        if size + len(text) > _CHUNK:
            flush()
        if len(text) > _CHUNK:
            parts = list(_cut(text))
            got = [_hash_piece(np.frombuffer(p, np.uint8))[1] for p in parts]
            hashes.extend(got)
            counts.append(np.array([sum(map(len, got))]))
        else:
            group.append(text)
            size += len(text) + 1
    flush()
    offsets = np.concatenate([[0], *counts]).cumsum().astype(np.int64)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), offsets


def _cut(text: bytes) -> Iterator[bytes]:
    """Pieces of a long text, cut at ASCII white space."""
    at = 0
    while at < len(text):
        end = min(at + _CHUNK, len(text))
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        yield text[at:end]
        at = end


def window_hashes(words: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of ``length`` words, by a rolling polynomial over word hashes.

    ``words`` is one document's; the result has ``len(words) - length + 1`` entries."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = np.uint64(_BASES[1] + 2 * seed)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        if length <= 8:
            for k in range(length):
                h = h * base + words[k : k + n]
            return mix64(h)
        # doubling: hashes of runs of 1, 2, 4, ... words, joined by the binary digits of the length
        run, size, factor, done = words, 1, base, 0
        while True:
            if length & size:
                h = h * factor + run[done : done + n]
                done += size
            if 2 * size > length:
                return mix64(h)
            run = run[: len(run) - size] * factor + run[size:]
            factor, size = factor * factor, 2 * size


def as_bytes(column: pa.Array) -> list[bytes]:
    """A text column as UTF-8; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def in_slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each has about ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column(text).cast(pa.binary())
        lengths = np.array([len(x) if x is not None else 0 for x in sizes.to_pylist()]) if batch.num_rows < 2 else _lengths(sizes)
        at, total = 0, 0
        for i, n in enumerate(lengths):
            if total and total + n > limit:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += n
        yield batch.slice(at)


def _lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)


# -------------------------------------------------------------------------- components


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node reaches by the edges.

    Alternates the large-star and small-star steps until only stars are left; every round
    is a few grouped passes over the edges, cut by a written table. Nothing is gathered in
    one place. Edges that are stars already take no round.
    """
    both = F.array(F.struct(F.col(a).alias("u"), F.col(b).alias("v")), F.struct(F.col(b).alias("u"), F.col(a).alias("v")))
    least, most = F.least("u", "v"), F.greatest("u", "v")

    def turned(e: DataFrame) -> DataFrame:
        return e.select(F.explode(both).alias("e")).select("e.u", "e.v")

    now = written_table(edges.where(F.col(a) != F.col(b)).select(least_of(a, b).alias(a), most_of(a, b).alias(b)).distinct(), "edges")
    while not _stars(now, a, b):
        around = turned(now)
        low = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = around.join(low, "u").where("v > u and v != m").select(F.col("m").alias("u"), "v")
        large = large.select(least.alias(a), most.alias(b)).distinct()
        small_low = large.groupBy(b).agg(F.min(a).alias("m"))
        small = large.join(small_low, b).select(
            F.explode(F.array(F.struct(F.col("m").alias("x"), F.col(b).alias("y")), F.struct(F.col("m").alias("x"), F.col(a).alias("y")))).alias("e")
        ).select(F.col("e.x").alias(a), F.col("e.y").alias(b)).where(f"{a} != {b}").distinct()
        now = written_table(small, "edges")
    return now.select(F.col(b).alias("node"), F.col(a).alias("component"))


def _stars(edges: DataFrame, a: str, b: str) -> bool:
    """Whether distinct edges, each from its smaller node ``a``, are stars around the
    smallest node of each component: every ``b`` has one edge and is no other's ``a``."""
    ends = edges.select(F.explode(F.array(F.struct(F.col(a).alias("u"), F.lit(0).alias("n")), F.struct(F.col(b).alias("u"), F.lit(1).alias("n")))).alias("e"))
    met = ends.groupBy("e.u").agg(F.count("*").alias("all"), F.sum("e.n").alias("n"))
    return met.where("n > 0 and all > 1").isEmpty()


def least_of(a: str, b: str) -> Column:
    return F.least(F.col(a), F.col(b))


def most_of(a: str, b: str) -> Column:
    return F.greatest(F.col(a), F.col(b))


# --------------------------------------------------------------- packed rows in buckets
#
# Where a corpus is compared word by word there are far more rows than documents. They
# travel as columns of bytes, one parcel for each bucket and batch, so that a shuffle
# moves a few bytes a row and no task handles single rows in Python.


def bucket_count(df: DataFrame, each: int = 1) -> int:
    """Buckets of a shuffle: ``each`` for every partition. Parcels are as many as batches
    times buckets, so there are no more buckets than memory asks for."""
    return each * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def parcels(bucket: np.ndarray, columns: list[np.ndarray]) -> tuple[list[int], list[bytes]]:
    """The rows of each bucket as one byte string: its columns one after another."""
    if not len(bucket):
        return [], []
    order = np.argsort(bucket, kind="stable")
    ranked = bucket[order]
    starts = np.concatenate(([0], np.flatnonzero(np.diff(ranked)) + 1))
    ends = np.append(starts[1:], len(ranked))
    held = [np.ascontiguousarray(c[order]) for c in columns]
    data = [b"".join([c[i:j].tobytes() for c in held]) for i, j in zip(starts.tolist(), ends.tolist())]
    return ranked[starts].tolist(), data


def opened(parcel: bytes, types: list[str]) -> list[np.ndarray]:
    """The columns of a parcel."""
    kinds = [np.dtype(t) for t in types]
    n = len(parcel) // sum(k.itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        out.append(np.frombuffer(parcel, k, n, at))
        at += n * k.itemsize
    return out


def all_opened(data: list[bytes], types: list[str]) -> list[np.ndarray]:
    each = [opened(x, types) for x in data]
    return [np.concatenate([e[k] for e in each]) if each else np.zeros(0, t) for k, t in enumerate(types)]


def parcel_batch(name: str, bucket: list[int], data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(data, pa.binary())], names=[name, "data"])


def by_bucket(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[int, list[bytes]]]:
    """Parcels of each bucket, of a stream sorted by bucket."""
    now, held = None, []
    for batch in batches:
        for b, x in zip(batch.column(name).to_pylist(), batch.column("data").to_pylist()):
            if b != now:
                if held:
                    yield now, held
                now, held = b, []
            held.append(x)
    if held:
        yield now, held


def in_buckets(df: DataFrame, name: str) -> DataFrame:
    """Parcels dealt by bucket and sorted by it within each task."""
    return df.repartition(name).sortWithinPartitions(name)


def alike_rows(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings equal keys together, and where each group starts."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    if not len(order):
        return order, np.zeros(0, np.int64)
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)


def key_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each 64-bit key."""
    with np.errstate(over="ignore"):
        return (mix64(keys.astype(np.int64).view(np.uint64) * np.uint64(_BASES[0]) + np.uint64(1)) % np.uint64(buckets)).astype(np.int32)
