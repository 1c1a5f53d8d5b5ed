"""Removal of repeated word sequences, found by difference-cover anchors.

A window is ``length`` words in a row. Windows are not hashed at every place: shorter
anchors are, and only at places whose remainder by ``period`` lies in a difference cover,
a set in which every remainder is a difference of two members. Wherever two equal windows
start, some shift below the period takes both starts into the cover, and an anchor of
``length - period + 1`` words there lies in both windows. So two equal windows always
share an aligned anchor. Anchors that occur twice are extended: all windows around them
are hashed (96 bits), and those that occur twice or more anywhere are repeats.

Words are split at ASCII white space and compared byte by byte. Every occurrence of a
repeat goes, the first included; kept words are joined by one blank. Windows are judged
on the input. Null text has no words. Repeated rows, and rows that share an id, are
documents of their own; an empty table gives no rows. Very long texts are hashed in
pieces; one text's word hashes must fit into a worker.

All comparisons of words run in buckets of hashes; what a batch already shows to be
repeated is spread over all buckets, so that a passage of very many documents does not
meet in one. Texts are dealt once, by document.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import (
    all_opened, alike_rows, as_bytes, bucket_count, by_bucket, hash_words, in_buckets, in_slices, key_bucket, parcel_batch, parcels,
    window_hashes,
)

LENGTH = 35
#: Difference covers by their period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
_ANCHOR = ["<u8", "<i8", "<i4", "u1"]
_PLACE = ["<i8", "<i4"]
_WINDOW = ["<u8", "<u4", "<i8", "<u4", "<i4", "u1"]
_REPEAT = ["<i8", "<u4", "<i4"]


def period_for(length: int) -> int:
    """The largest period with anchors of 12 words or more, as far as windows allow."""
    return max((p for p in COVERS if length - p + 1 >= min(12, length)), default=1)


def _known(keys: list[np.ndarray], bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a batch have an equal, and the bucket of each row: of the rows of a
    group all but the first are spread."""
    order, starts = alike_rows(keys)
    sizes = np.diff(np.append(starts, len(order)))
    known = np.zeros(len(order), np.uint8)
    known[order] = np.repeat(sizes > 1, sizes)
    nth = np.arange(len(order)) - np.repeat(starts, sizes)
    spread = bucket.copy()
    spread[order] = (bucket[order] + nth) % buckets
    return known, spread


class _Anchors:
    def __init__(self, length: int, period: int, buckets: int) -> None:
        self.anchor, self.cover, self.period, self.buckets = length - period + 1, COVERS[period], period, buckets
        self.length = length

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text"):
            words, at = hash_words(as_bytes(batch.column("text")))
            hashes, keys, places = [], [], []
            for k, i, j in zip(batch.column("k").to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                if j - i < self.length:
                    continue
                h = window_hashes(words[i:j], self.anchor)
                where = np.concatenate([np.arange(c, len(h), self.period, dtype=np.int32) for c in self.cover])
                hashes.append(h[where])
                places.append(where)
                keys.append(np.full(len(where), k, np.int64))
            if hashes:
                h, k, p = np.concatenate(hashes), np.concatenate(keys), np.concatenate(places)
                known, bucket = _known([h], (h % np.uint64(self.buckets)).astype(np.int32), self.buckets)
                yield parcel_batch("hb", *parcels(bucket, [h, k, p, known]))


def _repeated(keys: list[np.ndarray], known: np.ndarray) -> np.ndarray:
    """Rows that have an equal here, or are known to have one, or whose equal has."""
    order, starts = alike_rows(keys)
    sizes = np.diff(np.append(starts, len(order)))
    marked = np.add.reduceat(known[order].astype(np.int64), starts) > 0 if len(starts) else np.zeros(0, bool)
    out = np.zeros(len(order), bool)
    out[order] = np.repeat((sizes > 1) | marked, sizes)
    return out


class _Meet:
    """Keeps the rows of a bucket that occur twice, and sends them to their documents."""

    def __init__(self, types: list[str], n_keys: int, give: list[int], known: int, buckets: int) -> None:
        self.types, self.n_keys, self.give, self.known, self.buckets = types, n_keys, give, known, buckets

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, data in by_bucket(batches, "hb"):
            columns = all_opened(data, self.types)
            keep = _repeated(columns[: self.n_keys], columns[self.known])
            held.append([columns[g][keep] for g in self.give])
            size += int(keep.sum())
            if size > 500_000:
                yield self.sent(held)
                held, size = [], 0
        if size:
            yield self.sent(held)

    def sent(self, held: list[list[np.ndarray]]) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*held)]
        return parcel_batch("b", *parcels(key_bucket(columns[0], self.buckets), columns))


class _Deal:
    """Packs texts for the one shuffle that they make."""

    def __init__(self, buckets: int, more: list[str]) -> None:
        self.buckets, self.more = buckets, more

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in in_slices(batches, "text"):
            keys = np.array(batch.column("k").to_pylist(), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key_bucket(keys, self.buckets), pa.int32()), batch.column("k"), batch.column("doc_id"),
                 pa.array([squeeze.compress(t) for t in as_bytes(batch.column("text"))], pa.binary()), *(batch.column(c) for c in self.more)],
                names=["b", "k", "doc_id", "packed", *self.more],
            )


def _texts(docs: pa.Table) -> Iterator[tuple[int, int | None, bytes]]:
    open_ = zstandard.ZstdDecompressor()
    for batch in docs.to_batches():
        for k, d, x in zip(batch.column("k").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("packed").to_pylist()):
            yield k, d, open_.decompress(x)


def _grouped(keys: np.ndarray, rows: list[np.ndarray]) -> dict[int, list[np.ndarray]]:
    order, starts = alike_rows([keys])
    ends = np.append(starts[1:], len(order))
    ranked = [r[order] for r in rows]
    return {int(keys[order[i]]): [r[i:j] for r in ranked] for i, j in zip(starts, ends)}


class _Windows:
    """Extends the anchors of each document to the windows around them."""

    def __init__(self, length: int, period: int, buckets: int) -> None:
        self.length, self.period, self.buckets = length, period, buckets

    def __call__(self, docs: pa.Table, anchors: pa.Table) -> pa.Table:
        keys, places = all_opened(anchors.column("data").to_pylist(), _PLACE)
        found = _grouped(keys, [places])
        out = [[] for _ in _WINDOW]
        for k, _, text in _texts(docs) if found else ():
            if k not in found:
                continue
            words, _ = hash_words([text])
            n = len(words) - self.length + 1
            if n <= 0:
                continue
            near = np.zeros(n + 1, np.int32)  # windows from place - period + 1 to place
            p = found[k][0]
            p = p[p < n + self.period]
            np.add.at(near, np.clip(p - self.period + 1, 0, n), 1)
            np.add.at(near, np.clip(p + 1, 0, n), -1)
            s = np.flatnonzero(near.cumsum()[:n] > 0).astype(np.int32)
            for c, v in zip(out, (
                window_hashes(words, self.length, 1)[s], (window_hashes(words, self.length, 2)[s] >> np.uint64(32)).astype(np.uint32),
                np.full(len(s), k, np.int64), np.full(len(s), zlib.crc32(text), np.uint32), s,
            )):
                c.append(v)
        if not out[0]:
            return pa.Table.from_batches([parcel_batch("hb", [], [])])
        columns = [np.concatenate(c) for c in out[:5]]
        known, bucket = _known(columns[:2], (columns[0] % np.uint64(self.buckets)).astype(np.int32), self.buckets)
        return pa.Table.from_batches([parcel_batch("hb", *parcels(bucket, [*columns, known]))])


class _Kept:
    """Each document without the words that its repeated windows cover."""

    names = ["doc_id", "n_words", "n_removed", "kept"]

    def __init__(self, length: int, digest: bool, more: list[str]) -> None:
        self.length, self.digest, self.more = length, digest, more

    def __call__(self, docs: pa.Table, repeats: pa.Table) -> pa.Table:
        keys, marks, places = all_opened(repeats.column("data").to_pylist(), _REPEAT)
        found = _grouped(keys, [marks, places])
        rows = []
        for k, d, text in _texts(docs):
            words = text.split()
            n, gone = len(words), 0
            if k in found:
                mark, place = found[k]
                s = place[mark == zlib.crc32(text)]
                cover = np.zeros(n + 1, np.int32)
                np.add.at(cover, s, 1)
                np.add.at(cover, s + self.length, -1)
                stay = cover.cumsum()[:n] == 0
                gone = n - int(stay.sum())
                words = [w for w, x in zip(words, stay.tolist()) if x]
            kept = b" ".join(words)
            rows.append((d, n, gone, hashlib.sha256(kept).hexdigest() if self.digest else kept if gone else text))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        made = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, types)]
        return pa.Table.from_arrays([*made, *(docs.column(c) for c in self.more)], names=[*self.names, *self.more])


def _two(task):
    """A plain function of two tables."""
    return lambda docs, parcels_: task(docs, parcels_)


def without_repeats(
    docs: DataFrame, length: int = LENGTH, text: str = "text", doc_id: str = "doc_id", digest: bool = False, keep: Sequence[str] = (),
) -> DataFrame:
    """doc_id, n_words, n_removed and kept: the text without repeats (as it was, if none),
    or with ``digest`` the SHA-256 of the kept words. ``keep``: other columns to hand on."""
    if length < 1:
        raise ValueError("a window has one word or more")
    period, buckets, owners = period_for(length), bucket_count(docs), bucket_count(docs, 2)
    more = [f"more{i}" for i in range(len(keep))]
    # rows are known by id and text, as ids may be null or repeated
    rows = docs.select(
        F.xxhash64(F.col(doc_id).cast("bigint"), F.col(text)).alias("k"), F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"),
        *[F.col(c).alias(m) for c, m in zip(keep, more)],
    )
    others = "".join(f", {m} {rows.schema[m].dataType.simpleString()}" for m in more)
    dealt = rows.mapInArrow(_Deal(owners, more), f"b int, k bigint, doc_id bigint, packed binary{others}")
    anchors = rows.select("k", "text").mapInArrow(_Anchors(length, period, buckets), "hb int, data binary")
    twice = in_buckets(anchors, "hb").mapInArrow(_Meet(_ANCHOR, 1, [1, 2], 3, owners), "b int, data binary")
    windows = dealt.groupBy("b").cogroup(twice.groupBy("b")).applyInArrow(_two(_Windows(length, period, buckets)), "hb int, data binary")
    repeats = in_buckets(windows, "hb").mapInArrow(_Meet(_WINDOW, 2, [2, 3, 4], 5, owners), "b int, data binary")
    kept = dealt.groupBy("b").cogroup(repeats.groupBy("b")).applyInArrow(
        _two(_Kept(length, digest, more)), f"doc_id bigint, n_words bigint, n_removed bigint, kept string{others}"
    )
    return kept.select("doc_id", "n_words", "n_removed", "kept", *[F.col(m).alias(c) for c, m in zip(keep, more)])
