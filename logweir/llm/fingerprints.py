"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into lines, and a line into runs of words that end where a word's hash says
so (or after ``MOST_RUN`` words), so that an edit moves no cuts but those near it. The 64-bit digests of these paragraphs go
into a sketch: each is added to ``HASHES`` of its cells, as a count, a xor of digests and
a xor of their check values. Subtracting two versions' sketches cancels what they share,
and peeling cells that hold one digest recovers those that differ. If peeling gets stuck,
both versions are sketched again with four times the cells, until it succeeds; a pair
larger than ``MOST_CELLS`` is compared digest by digest.

The fingerprint is the sketch in ``BASE_CELLS`` cells with the number of paragraphs, as
text. Likeness is twice the shared paragraphs over all paragraphs of both (0 to 1; two
empty texts are alike). A repeated paragraph counts with its number of occurrence.

Null text is empty. Documents follow each other by id (null ids first), equal ids by
text; rows equal in both are interchangeable. An empty table gives no rows; extra columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import hash_words, in_slices, mix64

HASHES = 3
BASE_CELLS = 24
MOST_CELLS = 24 * 4**6
#: A run of words ends at a word whose hash is a multiple of this, or at the line's end.
RUN = 6
#: Longer runs, as of one word said over and over, are cut after so many words.
MOST_RUN = 16
_CHECK = np.uint64(0xA0761D6478BD642F)
_SEEDS = np.array([0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def paragraph_digests(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit digests of the paragraphs of each text, occurrences numbered, and
    where each text's begin (one more at the end)."""
    lines, per_text = [], np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        own = [x for x in text.split(b"\n") if x.strip()]
        per_text[k] = len(own)
        lines += own
    words, at = hash_words(lines)
    line_text = np.repeat(np.arange(len(texts)), per_text)
    if len(words):
        ends = words % np.uint64(RUN) == 0
        ends[at[1:] - 1] = True  # every line has a word
        start = np.concatenate(([0], np.flatnonzero(ends)[:-1] + 1))
        place = np.arange(len(words)) - np.repeat(start, np.diff(np.append(start, len(words))))
        start, place = np.flatnonzero(place % MOST_RUN == 0), place % MOST_RUN
        with np.errstate(over="ignore"):
            mixed = mix64(words + (place.astype(np.uint64) + np.uint64(1)) * _CHECK)
        digests = mix64(np.add.reduceat(mixed, start))
        owner = line_text[np.searchsorted(at, start, side="right") - 1]
    else:
        digests, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    blank = [k for k, t in enumerate(texts) if t and not per_text[k]]
    if blank:  # nothing but white space
        lone = [np.frombuffer(hashlib.blake2b(texts[k], digest_size=8).digest(), np.uint64)[0] for k in blank]
        digests, owner = np.append(digests, np.array(lone, np.uint64)), np.append(owner, blank)
    order = np.lexsort((digests, owner))
    digests, owner = digests[order], owner[order]
    if len(digests):
        new = np.concatenate(([True], (digests[1:] != digests[:-1]) | (owner[1:] != owner[:-1])))
        nth = (np.arange(len(new)) - np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))).astype(np.uint64)
        with np.errstate(over="ignore"):
            digests = np.where(nth > 0, mix64(digests + nth * _CHECK), digests)
    return digests, np.searchsorted(owner, np.arange(len(texts) + 1))


def _cells(digests: np.ndarray, cells: int) -> np.ndarray:
    """The cell of each digest in each of the equal parts of the sketch."""
    part = cells // HASHES
    with np.errstate(over="ignore"):
        h = mix64(digests[None, :] ^ _SEEDS[:, None])
    return (h % np.uint64(part)).astype(np.int64) + (np.arange(HASHES) * part)[:, None]


def _checks(digests: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(digests + _CHECK)


Sketch = tuple[np.ndarray, np.ndarray, np.ndarray]


def sketches(digests: np.ndarray, owner: np.ndarray, n: int, cells: int) -> Sketch:
    """Counts, digests xored and check values xored, by owner and cell."""
    at = (_cells(digests, cells) + owner * cells).ravel()
    count = np.bincount(at, minlength=n * cells).astype(np.int64)
    keys, checks = np.zeros(n * cells, np.uint64), np.zeros(n * cells, np.uint64)
    np.bitwise_xor.at(keys, at, np.tile(digests, HASHES))
    np.bitwise_xor.at(checks, at, np.tile(_checks(digests), HASHES))
    return count.reshape(n, cells), keys.reshape(n, cells), checks.reshape(n, cells)


def peel(a: Sketch, b: Sketch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Subtract the sketches of pairs, row by row, and recover what differs: (pair,
    digest, sign) of every digest only in ``a`` (1) or only in ``b`` (-1), and which
    pairs are fully recovered."""
    count, keys, checks = (a[0] - b[0]).ravel(), (a[1] ^ b[1]).ravel(), (a[2] ^ b[2]).ravel()
    pairs, cells = a[0].shape
    # hardly an empty cell: far too many digests for this size
    hopeless = np.repeat((count.reshape(pairs, cells) == 0).mean(1) < 0.05, cells)
    got = []
    for _ in range(4 * cells):
        pure = np.flatnonzero((np.abs(count) == 1) & (_checks(keys) == checks) & ~hopeless)
        if not len(pure):
            break
        pair, digest = pure // cells, keys[pure]
        order = np.lexsort((digest, pair))
        first = np.concatenate(([True], (digest[order][1:] != digest[order][:-1]) | (pair[order][1:] != pair[order][:-1])))
        pure, pair, digest = pure[order[first]], pair[order[first]], digest[order[first]]
        sign = count[pure]
        got.append((pair, digest, sign))
        at, own = (_cells(digest, cells) + pair * cells).ravel(), _checks(digest)
        np.subtract.at(count, at, np.tile(sign, HASHES))
        np.bitwise_xor.at(keys, at, np.tile(digest, HASHES))
        np.bitwise_xor.at(checks, at, np.tile(own, HASHES))
    left = (count != 0) | (keys != 0) | (checks != 0)
    found = [np.concatenate(x) if got else np.zeros(0, np.int64) for x in zip(*got)] if got else [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]
    return found[0], found[1], found[2], ~left.reshape(pairs, cells).any(1)


def differences(digests: np.ndarray, at: np.ndarray, pairs: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair of texts the digests only in the first and only in the second: by
    subtracted sketches, four times larger for the pairs that fail."""
    out: list = [None] * len(pairs)
    size = np.diff(at)
    waiting = {BASE_CELLS: list(range(len(pairs)))}
    cells = BASE_CELLS
    while cells <= MOST_CELLS:
        todo, later = waiting.pop(cells, []), waiting.setdefault(4 * cells, [])
        # the numbers alone say how many digests differ at least
        later += [p for p in todo if abs(size[pairs[p][0]] - size[pairs[p][1]]) > cells]
        todo = [p for p in todo if abs(size[pairs[p][0]] - size[pairs[p][1]]) <= cells]
        step = max(1, 600_000 // cells)
        for k in range(0, len(todo), step):
            some = todo[k : k + step]
            texts = sorted({t for p in some for t in pairs[p]})
            row = {t: i for i, t in enumerate(texts)}
            owner = np.repeat(np.arange(len(texts)), size[texts])
            made = sketches(np.concatenate([digests[at[t] : at[t + 1]] for t in texts]), owner, len(texts), cells)
            left, right = [row[pairs[p][0]] for p in some], [row[pairs[p][1]] for p in some]
            pair, digest, sign, done = peel(tuple(m[left] for m in made), tuple(m[right] for m in made))
            order = np.argsort(pair, kind="stable")
            pair, digest, sign = pair[order], digest[order], sign[order]
            cuts = np.searchsorted(pair, np.arange(len(some) + 1))
            for i, p in enumerate(some):
                d, s = digest[cuts[i] : cuts[i + 1]], sign[cuts[i] : cuts[i + 1]]
                if done[i]:
                    out[p] = (d[s > 0], d[s < 0])
                else:
                    later.append(p)
        cells *= 4
    for p in waiting.get(cells, []):
        a, b = (digests[at[t] : at[t + 1]] for t in pairs[p])
        out[p] = (np.setdiff1d(a, b), np.setdiff1d(b, a))
    return out


def likenesses(digests: np.ndarray, at: np.ndarray, pairs: list[tuple[int, int]]) -> list[float]:
    """Twice the shared paragraphs over all paragraphs of both texts."""
    out = []
    for (a, b), (only_a, _) in zip(pairs, differences(digests, at, pairs)):
        n, m = int(at[a + 1] - at[a]), int(at[b + 1] - at[b])
        out.append(2.0 * (n - len(only_a)) / (n + m) if n + m else 1.0)
    return out


def fingerprints(digests: np.ndarray, at: np.ndarray) -> list[str]:
    """The base sketch of each text: its paragraphs, then counts, xors and checks."""
    n = len(at) - 1
    size = np.diff(at)
    count, keys, checks = sketches(digests, np.repeat(np.arange(n), size), n, BASE_CELLS)
    cells = np.concatenate(
        [count.astype("<u2").view(np.uint8).reshape(n, -1), keys.astype("<u8").view(np.uint8).reshape(n, -1), (checks & np.uint64(0xFFFFFFFF)).astype("<u4").view(np.uint8).reshape(n, -1)], 1
    ) if n else np.zeros((0, 0), np.uint8)
    return [f"iblt{BASE_CELLS}-{int(k)}-{row.tobytes().hex()}" for k, row in zip(size, cells)]


# ------------------------------------------------------------------- document by document


def in_order(docs: DataFrame, text: str, doc_id: str) -> tuple[DataFrame, DataFrame]:
    """Documents dealt by ranges of their ids, each range in order and followed by the
    first document of the next (marked ``ahead``); and the first document of all."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = rows.select("doc_id").where("doc_id is not null").stat.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.2 / parts) if parts > 1 else []
    return rows, sorted({int(c) for c in cuts})


def range_of(doc_id: Column, cuts: list[int]) -> Column:
    """How many of the cuts lie below an id, by halving: one literal however many there
    are. A null id is in the first range."""
    if not cuts:
        return F.lit(0)
    held = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
    below = lambda at, step: F.get(held, at + step - 1) < doc_id  # noqa: E731  (null beyond the last)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(below(at, step), at + step).otherwise(at)).cast("int")


def versions(docs: DataFrame, edit=None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Every document with its fingerprint, its edited text's, and how alike it is to the
    edited text and to the next document.

    ``edit(text, next_text)`` makes the edited text; by default the last quarter of the
    code points is replaced by as many, or all, of the start of the next document."""
    edit = edit or replaced_tail
    rows, cuts = in_order(docs, text, doc_id)
    dealt = rows.withColumn("part", range_of(F.col("doc_id"), cuts))
    lead = F.struct(F.col("doc_id").isNotNull().alias("set"), "doc_id")
    # bound: one row per range
    firsts = sorted((r["part"], r["lead"]["doc_id"]) for r in dealt.groupBy("part").agg(F.min(lead).alias("lead")).collect())
    if not firsts:
        return spark_empty(docs.sparkSession)
    # the first document of a range is also sent to the range before, and the first of all to the last
    heading = [(part, lead_id, firsts[k - 1][0]) for k, (part, lead_id) in enumerate(firsts)]
    heading = docs.sparkSession.createDataFrame(heading, "part int, lead_id bigint, to int")
    # bound: one row per range
    leading = dealt.join(F.broadcast(heading), "part").where(F.col("doc_id").eqNullSafe(F.col("lead_id")))
    digest = F.md5("text")
    least = leading.groupBy("part").agg(F.min(digest).alias("__least"))
    heads = leading.join(F.broadcast(least), "part").where(digest == F.col("__least"))  # bound: one row per range
    heads = heads.groupBy("to").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    ahead = heads.select("doc_id", "text", F.col("to").alias("part"), F.lit(1).alias("ahead"))
    both = dealt.select("doc_id", "text", "part", F.lit(0).alias("ahead")).unionByName(ahead)
    ranged = both.repartition("part").sortWithinPartitions("part", "ahead", F.col("doc_id").asc_nulls_first(), digest)
    return ranged.mapInArrow(_Pairs(edit), "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def spark_empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def replaced_tail(text: str, following: str) -> str:
    q = len(text) // 4
    return text[: len(text) - q] + following[:q] if q else text


class _Pairs:
    """Walks a range's documents in order, each with the one after it."""

    def __init__(self, edit) -> None:
        self.edit = edit

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the document that waits for the next: (id, text, part, ahead)
        for batch in in_slices(batches, "text", 2 << 20):
            rows = held + list(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part", "ahead"))))
            held = [] if rows[-1][3] else rows[-1:]
            yield self.pairs(rows)

    def pairs(self, rows: list[tuple]) -> pa.RecordBatch:
        ours = [i for i in range(len(rows) - 1) if not rows[i][3] and rows[i][2] == rows[i + 1][2]]
        edited = [self.edit(rows[i][1], rows[i + 1][1]) for i in ours]
        coded = [t.encode("utf-8", "surrogatepass") for t in (*(r[1] for r in rows), *edited)]
        digests, at = paragraph_digests(coded)
        prints = fingerprints(digests, at)
        n, m = len(rows), len(ours)
        near = likenesses(digests, at, [(i, n + k) for k, i in enumerate(ours)] + [(i, i + 1) for i in ours])
        columns = [
            [rows[i][0] for i in ours], [len(rows[i][1]) for i in ours], [hashlib.sha256(coded[n + k]).hexdigest() for k in range(m)],
            [prints[i] for i in ours], prints[n:], near[:m], near[m:],
        ]
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types)], names=names)
