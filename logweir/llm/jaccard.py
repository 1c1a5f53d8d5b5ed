"""N-gram Jaccard join: count vectors in an R-tree, surviving pairs verified on their sets.

A document's set is its distinct shingles of ``width`` words (a shorter text is one
shingle). Shingles are hashed into groups and the group counts make the document a point:
two points' coordinate minima add up to at least the overlap of the sets. Points are held
in an R-tree (packed by size, each node with the largest count per group and its range of
sizes); a search leaves out nodes, then points, whose summed minima fall short of the
overlap that the similarity needs. Pairs that survive are verified on the whole sets.

One tree over a corpus would not prune: nodes over many documents have large maxima. So
points first meet by shingles: of the sets' shingles in hash order, the first
``n - ceil(s * n) + l`` of two similar sets have at least ``l`` in common (``l`` about an
eighth of ``n``). A document stays only if that many of its first shingles occur
elsewhere; the rest, few, are grouped by shared shingles. Near copies of a long text share
their shingles in hundreds of combinations, so groups with the same smallest member become
one where that means no more comparisons than the groups apart. Each group is an R-tree.

At first a set takes part in one group only, its largest, then its rarest, and a group
proposes to each point its ``NEAREST`` points of other components by bound, so a group of
near copies gives a few pairs for each, not all. What verification links is joined into
components. Then all groups propose the pairs that survive between different components,
each pair in the first of the groups that both are in, until none is left (in rounds with
doubled quota). So every link between different sets decides, whatever the
sizes of groups. Equal sets are one point from the start. A group above ``GROUP_MOST`` is
cut into blocks, and each pair of blocks is a unit of work.

Null and empty texts have no shingles and link with nothing. Repeated rows have equal
sets, so one component; an empty table gives no rows; extra columns are not read. Rows
without an id link like others, and what they link is one component; its id is the
smallest there is, null if all are null. Whole texts are used; words are split at ASCII white space and A-Z lower-cased.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from ..session import written_table
from .common import (
    all_opened, alike_rows, as_bytes, bucket_count, by_bucket, components, hash_words, in_buckets, in_slices, key_bucket, mix64, parcel_batch,
    parcels, window_hashes,
)
from .urls import _block, block_bits, blocked_bloom, might_hold

WIDTH = 5
#: Similarity as a fraction of whole numbers.
SIMILARITY = (75, 100)
GROUP_MOST = 4096
NEAREST = 3
#: Groups of a set that its rows carry, the smallest ids first.
GROUPS_TOLD = 64
#: Ids that a task remembers, so as not to tell them again; beyond that it starts anew.
_REMEMBERED = 100_000
_ENTRY = ["<u8", "<i8", "<u4"]
#: An entry with the number of sets that have its shingle among their first.
_COUNTED = [*_ENTRY, "<u4"]


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of one text's word hashes."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(window_hashes(words, min(width, len(words)), 3 if len(words) >= width else 3 + len(words)))


def point(shingles: np.ndarray) -> bytes:
    """Counts of the shingles by group: as many groups as half the shingles, a power of two."""
    groups = 32
    while groups * 2 < len(shingles):
        groups *= 2
    while True:
        counts = np.bincount((shingles & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
        if counts.max() < 256:
            return counts.astype(np.uint8).tobytes()
        groups *= 2


def identity(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


class Similarity:
    """Whole-number forms of ``overlap / union >= s``."""

    def __init__(self, s: tuple[int, int]) -> None:
        self.num, self.den = s
        if not 0 < self.num <= self.den:
            raise ValueError("similarity lies above 0 and is at most 1")

    def least_overlap(self, both):
        """Of sets with ``both`` members together."""
        return -(-self.num * both // (self.num + self.den))

    def least_size(self, n):
        return -(-self.num * n // self.den)

    def links(self, overlap: int, both: int) -> bool:
        return self.den * overlap >= self.num * (both - overlap)

    def shared(self, n):
        """How many of the first shingles similar sets must share, at this size."""
        return 1 + n // 8

    def first(self, n: int) -> int:
        return min(n, n - self.least_size(n) + self.shared(n))


# ---------------------------------------------------------------------------- documents


class _Sets:
    def __init__(self, width: int) -> None:
        self.width = width

    def each(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        words, at = hash_words([t.lower() for t in as_bytes(batch.column("text"))])
        for i in range(batch.num_rows):
            yield i, shingle_set(words[at[i] : at[i + 1]], self.width)


class _Points(_Sets):
    """doc_id, key, uid (of the set), n and the point of each document."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text"):
            uid, n, points = [], [], []
            for _, s in self.each(batch):
                uid.append(identity(s) if len(s) else None)
                n.append(len(s))
                points.append(point(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(uid, pa.int64()), pa.array(n, pa.int64()), pa.array(points, pa.binary())],
                names=["doc_id", "key", "uid", "n", "point"],
            )


class _First(_Sets):
    """The first shingles of each set, once per task for equal sets."""

    def __init__(self, width: int, similar: Similarity, buckets: int) -> None:
        super().__init__(width)
        self.similar, self.buckets = similar, buckets

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in in_slices(batches, "text"):
            out = [[], [], []]
            for _, s in self.each(batch):
                if not len(s) or (u := identity(s)) in seen:
                    continue
                if len(seen) > _REMEMBERED:
                    seen.clear()
                seen.add(u)
                first = s[: self.similar.first(len(s))]
                out[0].append(first)
                out[1].append(np.full(len(first), u, np.int64))
                out[2].append(np.full(len(first), len(s), np.uint32))
            if out[0]:
                columns = [np.concatenate(c) for c in out]
                # the shingles kept are the smallest hashes, so the low bits deal them out
                yield parcel_batch("hb", *parcels((columns[0] % np.uint64(self.buckets)).astype(np.int32), columns))


class _Packed(_Sets):
    """The texts that sets are made of again, packed, once per task for equal sets: a
    quarter of the sets' own size."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        seen: set[int] = set()
        for batch in in_slices(batches, "text"):
            texts, rows = as_bytes(batch.column("text")), {}
            for i, s in self.each(batch):
                if len(s) and (u := identity(s)) not in seen:
                    if len(seen) > _REMEMBERED:
                        seen.clear()
                    seen.add(u)
                    rows[u] = squeeze.compress(texts[i].lower())
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), pa.array(list(rows.values()), pa.binary())], names=["uid", "packed"])


# ------------------------------------------------------------------- meeting by shingles


def _members(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows (shingle, uid, n), each once and in order, and where each shingle starts."""
    order, starts = alike_rows(columns[:2])
    rows = [c[order[starts]] for c in columns]
    new = np.flatnonzero(np.concatenate(([True], rows[0][1:] != rows[0][:-1]))) if len(starts) else starts
    return rows, new


class _Shared:
    """Rows whose shingle another set has too, with the number of such sets, sent to
    their set's bucket."""

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, data in by_bucket(batches, "hb"):
            rows, new = _members(all_opened(data, _ENTRY))
            sizes = np.diff(np.append(new, len(rows[0])))
            keep = np.repeat(sizes > 1, sizes)
            rows.append(np.repeat(sizes, sizes).astype(np.uint32))
            held.append([r[keep] for r in rows])
            size += int(keep.sum())
            if size > 300_000:
                yield self.sent(held)
                held, size = [], 0
        if size:
            yield self.sent(held)

    def sent(self, held) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*held)]
        return parcel_batch("hb", *parcels(key_bucket(columns[1], self.buckets), columns))


class _Enough:
    """Rows of sets that share enough of their first shingles, sent back by shingle.

    Sets that must share ``k`` of them still share one if each leaves out its ``k - 1``
    most common, so passages of very many documents seldom make a group."""

    def __init__(self, similar: Similarity, buckets: int) -> None:
        self.similar, self.buckets = similar, buckets

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, data in by_bucket(batches, "hb"):
            columns = all_opened(data, _COUNTED)
            order, starts = alike_rows([columns[1], columns[3], columns[0]])
            rows = [c[order[starts]] for c in columns]  # by set, the rarest first
            new = np.flatnonzero(np.concatenate(([True], rows[1][1:] != rows[1][:-1])))
            sizes = np.diff(np.append(new, len(rows[1])))
            n = rows[2][new].astype(np.int64)
            must = self.similar.shared(self.similar.least_size(n))
            nth = np.arange(len(rows[1])) - np.repeat(new, sizes)
            keep = nth <= np.repeat(sizes - must, sizes)
            held.append([r[keep] for r in rows[:3]])
            size += int(keep.sum())
            if size > 300_000:
                yield self.sent(held)
                held, size = [], 0
        if size:
            yield self.sent(held)

    def sent(self, held) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*held)]
        return parcel_batch("hb", *parcels((columns[0] % np.uint64(self.buckets)).astype(np.int32), columns))


class _Groups:
    """(gid, least, uid) of every group of sets that share a shingle, ``least`` being its
    smallest member. Groups with the same members have the same gid, so most are found many
    times and kept once."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        gids, leasts, uids = [], [], []
        size = 0
        for _, data in by_bucket(batches, "hb"):
            rows, new = _members(all_opened(data, _ENTRY))
            ends = np.append(new[1:], len(rows[0]))
            sums = np.add.reduceat(mix64(rows[1].view(np.uint64)), new) if len(new) else new
            gid = mix64(sums.astype(np.uint64)).view(np.int64) if len(new) else new
            for g, i, j in zip(gid.tolist(), new.tolist(), ends.tolist()):
                if j - i > 1 and g not in seen:
                    if len(seen) > _REMEMBERED:
                        seen.clear()
                    seen.add(g)
                    gids.append(np.full(j - i, g, np.int64))
                    leasts.append(np.full(j - i, rows[1][i], np.int64))  # a group's rows are in order
                    uids.append(rows[1][i:j])
                    size += j - i
            if size > 100_000:
                yield self.sent(gids, leasts, uids)
                gids, leasts, uids, size = [], [], [], 0
        if size:
            yield self.sent(gids, leasts, uids)

    @staticmethod
    def sent(*columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["gid", "least", "uid"])


# ---------------------------------------------------------------------------- the R-tree


class CountTree:
    """An R-tree of count vectors, packed in order of size, for overlap searches."""

    FAN = 8

    def __init__(self, sizes: np.ndarray, vectors: np.ndarray) -> None:
        self.order = np.argsort(sizes, kind="stable")
        self.levels = []  # (largest counts, least size, largest size), leaves first
        top, low, high = vectors[self.order], sizes[self.order], sizes[self.order]
        self.levels.append((top, low, high))
        while len(low) > self.FAN:
            starts = np.arange(0, len(low), self.FAN)
            top = np.maximum.reduceat(top, starts, axis=0)
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            self.levels.append((top, low, high))

    def search(self, n: int, vector: np.ndarray, similar: Similarity) -> tuple[np.ndarray, np.ndarray]:
        """Points whose bound reaches the overlap that a set of ``n`` with this vector
        needs, and how near the bound puts them (1: equal)."""
        least, most = similar.least_size(n), n * similar.den // similar.num
        at = np.arange(len(self.levels[-1][1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high = self.levels[depth]
            at = at[(high[at] >= least) & (low[at] <= most)]
            bound = np.minimum(top[at], vector).sum(1, dtype=np.int64)
            good = bound >= similar.least_overlap(n + np.maximum(low[at], least))
            at, bound = at[good], bound[good]
            if depth:
                at = (at[:, None] * self.FAN + np.arange(self.FAN)).ravel()
                at = at[at < len(self.levels[depth - 1][1])]
        return self.order[at], 2 * bound / (n + self.levels[0][1][at])


def _folded(vector: bytes, groups: int) -> np.ndarray:
    v = np.frombuffer(vector, np.uint8)
    return v.astype(np.uint16) if len(v) == groups else v.reshape(-1, groups).sum(0, dtype=np.uint16)


def proposals(
    uids: np.ndarray, sizes: np.ndarray, points: list[bytes], parts: np.ndarray, similar: Similarity, quota: int | None,
    sides: np.ndarray | None = None, before: list[frozenset[int]] | None = None,
):
    """(pairs, whether there are more): of points in different ``parts`` whose bound holds.
    Without a quota those of each point and its nearest. ``before``: each point's groups
    that come before this one; points that share one of those are its pair to tell."""
    if before is not None and not any(before):
        before = None
    if len(uids) == 2:
        if before is not None and not before[0].isdisjoint(before[1]):
            return [], False
        g = min(len(points[0]), len(points[1]))
        a, b = _folded(points[0], g), _folded(points[1], g)
        small, large = sorted(sizes.tolist())
        fits = parts[0] != parts[1] and small >= similar.least_size(large) and np.minimum(a, b).sum() >= similar.least_overlap(small + large)
        return ([tuple(sorted(uids.tolist()))] if fits else []), False
    widths = np.array([len(p) for p in points])
    pairs, more = [], False
    for width in np.unique(widths):
        inside = np.flatnonzero((widths == width) | (widths == 2 * width))
        vectors = np.stack([_folded(points[i], width) for i in inside])
        tree = CountTree(sizes[inside], vectors)
        for q in np.flatnonzero(widths[inside] == width):
            i = inside[q]
            found, near = tree.search(int(sizes[i]), vectors[q], similar)
            found = inside[found]
            keep = (parts[found] != parts[i]) & ((widths[found] > width) | (found > i) | (quota is None))
            if sides is not None:
                keep &= sides[found] != sides[i]
            found, near = found[keep], near[keep]
            if before is not None and len(found):
                keep = np.fromiter((before[i].isdisjoint(before[j]) for j in found), bool, len(found))
                found, near = found[keep], near[keep]
            if quota is None:
                found = found[np.lexsort((uids[found], -near))[:NEAREST]]
            elif len(pairs) + len(found) > quota:
                found, more = found[: quota - len(pairs)], True
            pairs += [(min(uids[i], uids[j]), max(uids[i], uids[j])) for j in found]
            if more:
                return pairs, True
    return pairs, False


class _Propose:
    """Pairs of each group, of a stream sorted by unit."""

    def __init__(self, similar: Similarity, quota: int | None) -> None:
        self.similar, self.quota = similar, quota

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple] = set()
        for table in self.units(batches):
            uids, first = np.unique(table.column("uid").to_numpy(), return_index=True)
            if len(uids) < 2:
                continue
            parts = table.column("part").to_numpy()[first]
            if (parts == parts[0]).all():
                continue
            points = table.column("point").to_pylist()
            gid, gids = table.column("gid")[0].as_py(), table.column("gids").to_pylist()
            before = [frozenset(g for g in gids[i] if g < gid) for i in first]
            side = table.column("side").to_numpy(zero_copy_only=False)[first]
            pairs, more = proposals(
                uids, table.column("n").to_numpy()[first], [points[i] for i in first], parts, self.similar,
                None if self.quota is None else self.quota * len(uids), side if (side != side[0]).any() else None, before,
            )
            pairs = [p for p in pairs if p not in done]
            if len(done) > _REMEMBERED:
                done.clear()
            done.update(pairs)
            if pairs or more:
                a, b = zip(*pairs) if pairs else ([], [])
                rows = [[*a, *[0] * more], [*b, *[0] * more], [*[False] * len(pairs), *[True] * more]]
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.bool_())], names=["a", "b", "more"])

    @staticmethod
    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        now, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = list(zip(batch.column("gid").to_pylist(), batch.column("unit").to_pylist()))
            cuts = [0, *[i for i in range(1, len(unit)) if unit[i] != unit[i - 1]], len(unit)]
            for i, j in zip(cuts, cuts[1:]):
                if unit[i] != now:
                    if held:
                        yield pa.Table.from_batches(held)
                    now, held = unit[i], []
                held.append(batch.slice(i, j - i))
        if held:
            yield pa.Table.from_batches(held)


class _Verify:
    """Whether the whole sets of each pair link."""

    def __init__(self, width: int, similar: Similarity) -> None:
        self.width, self.similar = width, similar

    def sets(self, packed: dict[int, bytes]) -> dict[int, np.ndarray]:
        open_ = zstandard.ZstdDecompressor()
        words, at = hash_words([open_.decompress(x) for x in packed.values()])
        return {u: shingle_set(words[i:j], self.width) for u, i, j in zip(packed, at[:-1], at[1:])}

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "packed_b", 1 << 20):
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            held = self.sets(dict(zip(a, batch.column("packed_a").to_pylist())) | dict(zip(b, batch.column("packed_b").to_pylist())))
            fits = []
            for x, y in zip(a, b):
                s, t = held[x], held[y]
                if len(s) > len(t):
                    s, t = t, s
                overlap = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
                fits.append(self.similar.links(overlap, len(s) + len(t)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(fits, pa.bool_())], names=["a", "b", "links"])


# ------------------------------------------------------------------------------- the join


def _merged(groups: DataFrame) -> DataFrame:
    """(gid, uid) of the groups (gid, least, uid), those with the same least member as one
    where its pairs are no more than theirs together. All pairs of a group stay in one."""
    sizes = groups.groupBy("gid").agg(F.first("least").alias("least"), F.count("*").alias("__m"))
    apart = sizes.groupBy("least").agg(F.sum(F.col("__m") * F.col("__m")).alias("__apart"))
    one = groups.select("least", "uid").distinct().groupBy("least").agg(F.count("*").alias("__n"))
    fewer = one.join(apart, "least").where("__n * __n <= __apart").select("least", F.lit(True).alias("__one"))
    # members are dealt by group, as one set can be the least of very many
    named = sizes.join(fewer, "least", "left").select("gid", F.when(F.col("__one"), F.col("least")).otherwise(F.col("gid")).alias("__name"))
    return groups.join(named, "gid").select(F.col("__name").alias("gid"), "uid").distinct()


def _units(members: DataFrame) -> DataFrame:
    """Members with their unit of work: the group, or for a group above the limit every
    pair of its blocks (``side`` tells the two blocks apart)."""
    counted = members.groupBy("gid").agg(F.count("*").alias("__m"))
    rows = members.join(counted, "gid")
    blocks = F.ceil(F.col("__m") / GROUP_MOST).cast("int")
    own = F.pmod(F.xxhash64("uid"), blocks).cast("int")
    every = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct((F.least(own, j) * blocks + F.greatest(own, j)).alias("unit"), F.when(j == own, 0).otherwise((own > j).cast("int")).alias("side")))
    return rows.select("*", F.explode(F.when(blocks > 1, every).otherwise(F.array(F.struct(F.lit(0).alias("unit"), F.lit(0).alias("side"))))).alias("__u")).select(
        "gid", "uid", "part", F.col("__u.unit").alias("unit"), F.col("__u.side").alias("side")
    )


def classes(docs: DataFrame, width: int = WIDTH, similarity: tuple[int, int] = SIMILARITY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest id that a document reaches by links."""
    return keyed_classes(docs, width, similarity, text, doc_id).select("doc_id", "n_shingles", "component_id")


def row_key(text: str = "text", doc_id: str = "doc_id") -> Column:
    """Tells rows of different texts apart where ids are null or repeated."""
    return F.xxhash64(F.col(doc_id).cast("bigint"), F.col(text))


def keyed_classes(docs: DataFrame, width: int = WIDTH, similarity: tuple[int, int] = SIMILARITY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``classes`` with their ``key`` (see ``row_key``) and ``class``, the
    component itself (null without shingles): components can have the same smallest id."""
    similar, buckets = Similarity(similarity), bucket_count(docs, 2)
    # a row is found again by its key, as ids may be null or repeated
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).withColumn("key", row_key())
    points = written_table(rows.mapInArrow(_Points(width), "doc_id bigint, key bigint, uid bigint, n bigint, point binary"), "points")
    parcel = "hb int, data binary"
    first = rows.select("text").mapInArrow(_First(width, similar, buckets), parcel)
    shared = in_buckets(first, "hb").mapInArrow(_Shared(buckets), parcel)
    enough = in_buckets(shared, "hb").mapInArrow(_Enough(similar, buckets), parcel)
    groups = written_table(in_buckets(enough, "hb").mapInArrow(_Groups(), "gid bigint, least bigint, uid bigint").distinct(), "groups")
    reached = _reached(rows, written_table(_merged(groups), "members"), points, width, similar)
    named = points.select("doc_id", "key", "uid", "n").join(reached.select(F.col("node").alias("uid"), "component"), "uid", "left")
    named = named.select("doc_id", "key", F.col("n").alias("n_shingles"), F.coalesce("component", "uid").alias("class"))
    least = named.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("component_id"))
    linked = named.where("class is not null").join(least, "class").select("doc_id", "key", "class", "n_shingles", "component_id")
    return linked.unionByName(named.where("class is null").select("doc_id", "key", "class", "n_shingles", F.col("doc_id").alias("component_id")))


def _reached(rows: DataFrame, members: DataFrame, points: DataFrame, width: int, similar: Similarity) -> DataFrame:
    """(node, component) of sets by verified links. ``members``: the sets of every group;
    ``points``: key, set, size and point of every row. Points join the members last, so
    that they are dealt out once a round. What a round links is added to the components
    of the rounds before; without new links they stay, as every job costs the driver memory."""
    sized = members.join(members.groupBy("gid").agg(F.count("*").alias("m")), "gid")
    place = F.struct("m", "gid")
    own = sized.groupBy("uid").agg(
        F.max(place).alias("largest"), F.min(place).alias("rarest"), F.slice(F.sort_array(F.collect_set("gid")), 1, GROUPS_TOLD).alias("gids")
    )
    own = written_table(own.join(points.select("uid", "key", "n", "point"), "uid").dropDuplicates(["uid"]), "own-groups")
    rounds = [own.select("uid", F.col(f"{g}.gid").alias("gid")) for g in ("largest", "rarest")]
    tried, sets, reached, turn, quota = None, None, None, 0, None
    while True:
        if turn < len(rounds):
            state, gids = rounds[turn], F.array().cast("array<bigint>")
        else:
            state, gids, quota = members, F.col("gids"), 32 if quota is None else 2 * quota
        if reached is None:
            state = state.withColumn("part", F.col("uid"))
        else:
            joined = state.join(reached.select(F.col("node").alias("uid"), "component"), "uid", "left")
            joined = joined.withColumn("part", F.coalesce("component", "uid")).drop("component")
            apart = joined.groupBy("gid").agg((F.min("part") != F.max("part")).alias("__apart")).where("__apart").select("gid")
            state = joined.join(apart, "gid", "left_semi")
        units = _units(state).join(own.select("uid", "n", "point", gids.alias("gids")), "uid")
        proposed = units.repartition("gid", "unit").sortWithinPartitions("gid", "unit").mapInArrow(
            _Propose(similar, quota), "a bigint, b bigint, more boolean"
        )
        proposed = written_table(proposed, "proposed")
        more = quota is None or bool(proposed.where("more").take(1))
        pairs = proposed.where("not more").select("a", "b").distinct()
        if tried is not None:
            pairs = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")
        pairs = written_table(pairs, "pairs")
        sets = _sets(rows, own, pairs, sets, width)
        with_a = pairs.join(sets.select(F.col("uid").alias("a"), F.col("packed").alias("packed_a")), "a")
        both = with_a.join(sets.select(F.col("uid").alias("b"), F.col("packed").alias("packed_b")), "b")
        checked = written_table(both.select("a", "b", "packed_a", "packed_b").mapInArrow(_Verify(width, similar), "a bigint, b bigint, links boolean"), "checked")
        tried = checked if tried is None else tried.unionByName(checked)
        links = checked.where("links").select("a", "b")
        if reached is None:
            reached = components(links)
        elif not links.isEmpty():
            reached = components(reached.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(links))
        if not more:
            return reached
        turn += 1


def _sets(rows: DataFrame, own: DataFrame, pairs: DataFrame, known: DataFrame | None, width: int) -> DataFrame:
    """uid and packed text of the sets in any pair, besides those that are known. Rows pass
    a Bloom filter of the wanted keys (of bounded size) before their texts are packed and
    shuffled to the exact join."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct()
    if known is not None:
        wanted = wanted.join(known.select("uid"), "uid", "left_anti")
    wanted = written_table(own.select("key", "uid").join(wanted, "uid"), "wanted-sets")
    n = wanted.count()
    if known is not None and not n:
        return known
    bits = block_bits(n)
    bloom = blocked_bloom(wanted, "key", bits)
    h = F.xxhash64("key")
    near = rows.withColumn("__block", _block(h, bits)).join(F.broadcast(bloom), "__block").where(might_hold(h)).select("text")
    found = near.mapInArrow(_Packed(width), "uid bigint, packed binary").join(wanted.select("uid"), "uid", "left_semi")
    fresh = written_table(found.dropDuplicates(["uid"]), "sets")  # equal rows have equal keys
    return fresh if known is None else known.unionByName(fresh)
