"""Best-fit packing of tokenized documents into sequences, planned on a histogram of lengths.

A document is its token ids and one end id. One longer than a sequence is cut into full
pieces and a last, maybe shorter, one. Best fit by falling length is then run on the
counts of each length, not on documents: there are at most as many lengths as a sequence
has tokens, so the plan is small whatever the input, and the driver makes it. It says
which stretch of the pieces of a length, numbered from 0, goes to which sequences at
which place. Pieces are numbered within their length in buckets, so a length that very
many documents have is spread over tasks, and each piece takes its slot by its number.

Null and empty texts are a single end id. Repeated rows are packed as rows of their own.
An empty table gives no rows. Texts are tokenized in whole, a batch of documents at a
time, word by word, with the ids of words kept between batches.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import written_table
from .common import as_bytes, digits_for, in_slices, ranked_within

SEQUENCE = 2048
#: Words and pieces whose ids a task keeps (some tens of MB); beyond that it starts anew.
_KEPT_WORDS = 200_000
_KEPT_PIECES = 200_000
#: Words whose normal form is their lower case: printable ASCII and the letters of Latin-1
#: and Latin Extended-A (without the dotted capital I, whose lower case is two characters).
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
#: The file's own split, on such words in lower case.
_LETTERS = "a-z\u00df-\u00f6\u00f8-\u017f"
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\\s0-9{_LETTERS}]+")


def _byte_letters() -> dict[int, int]:
    """Byte-level alphabet: printable Latin-1 stands for itself, other bytes for 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: 256 + i for i, b in enumerate(rest)}


_BYTE_LETTERS = _byte_letters()


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds(dict):
    """UTF-8 word (no ASCII white space) to its ids as unsigned 32-bit little-endian bytes.

    The tokenizer drops white space and never joins across it, so a text's ids are its
    words' ids. Plain words go straight to the merges after the file's own lower casing
    and split, each piece once; others, and those with a special token's mark, through
    all of it.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.pieces: dict[str, bytes] = {}

    def piece(self, text: str) -> bytes:
        ids = self.pieces.get(text)
        if ids is None:
            spelled = text if text.isascii() else text.encode().decode("latin-1").translate(_BYTE_LETTERS)
            ids = self.pieces[text] = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
        return ids

    def learn(self, words: set[bytes]) -> None:
        if len(self.pieces) > _KEPT_PIECES:
            self.pieces.clear()
        rest, piece = [], self.piece
        for w in words:
            text = w.decode("utf-8", "replace")
            if _PLAIN.fullmatch(text) and "<|" not in text:
                low = text.lower()
                if low.isalpha():
                    self[w] = piece(low)
                elif low[:-1].isalpha():  # a word and its comma or full stop
                    self[w] = piece(low[:-1]) + piece(low[-1])
                else:
                    self[w] = b"".join([piece(p) for p in _PIECE.findall(low)])
            else:
                rest.append((w, text))
        coded = self.tokenizer.encode_batch([t for _, t in rest], add_special_tokens=False)
        for (w, _), e in zip(rest, coded):
            self[w] = array("I", e.ids).tobytes()

    def forget(self) -> None:
        self.clear()
        self.pieces.clear()

    def of(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text."""
        split = [t.split() for t in texts]
        words = set().union(*split)
        if len(self) + len(words) > _KEPT_WORDS:
            self.clear()
        self.learn(words - self.keys())
        for words in split:
            yield b"".join(map(self.__getitem__, words))


_IDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _IDS:
        _IDS.clear()
        _IDS[path] = WordIds(path)
    return _IDS[path]


def tokenized_pieces(
    docs: DataFrame, vocabulary: str, sequence: int = SEQUENCE, end_id: int = 0, text: str = "text",
    doc_id: str = "doc_id", with_ids: bool = False,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece of every document."""
    kept = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    ids_type = ", ids array<int>" if with_ids else ""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + ([("ids", pa.list_(pa.int32()))] if with_ids else []))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_ids(vocabulary)
        try:
            for batch in in_slices(batches, "text"):
                rows: list[tuple] = []
                for d, ids in zip(batch.column("doc_id").to_pylist(), known.of(as_bytes(batch.column("text")))):
                    ids += end
                    for k in range(0, len(ids) // 4, sequence):
                        part = ids[4 * k : 4 * (k + sequence)]
                        row = (d, k // sequence, k, len(part) // 4, zlib.crc32(part))
                        rows.append((*row, np.frombuffer(part, "<u4").astype(np.int32)) if with_ids else row)
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
        finally:
            known.forget()  # workers outlive tasks

    return kept.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ids_type)


# ------------------------------------------------------------------------------ the plan


def best_fit_plan(counts: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, int, int, int, int, int]]:
    """Stretches (length, first, n, sequence, each, offset): the ``n`` pieces of this
    length from number ``first`` on go to sequences from ``sequence`` on, ``each`` to a
    sequence, the first of them at ``offset``. Best fit by falling length: a piece goes
    to the sequence with the least room that holds it, and stays with it while it fits.
    """
    room: dict[int, deque[list[int]]] = {}  # free tokens: [first sequence, how many]
    stretches, made = [], 0

    def put(free: int, first: int, many: int) -> None:
        if free and many:
            room.setdefault(free, deque()).append([first, many])

    for length in sorted((k for k in counts if counts[k]), reverse=True):
        if not 0 < length <= sequence:
            raise ValueError(f"a piece has {length} tokens; a sequence has {sequence}")
        left, at = counts[length], 0
        while left:
            free = min((r for r in room if r >= length), default=None)
            if free is None:
                each = sequence // length
                first, many, free = made, -(-left // each), sequence
                made += many
            else:
                span = room[free][0]
                each = free // length
                first, many = span[0], min(span[1], -(-left // each))
                span[0] += many
                span[1] -= many
                if not span[1]:
                    room[free].popleft()
                    if not room[free]:
                        del room[free]
            n = min(left, many * each)
            stretches.append((length, at, n, first, each, sequence - free))
            full, odd = divmod(n, each)
            put(free - each * length, first, full)
            if odd:
                put(free - odd * length, first + full, 1)
            at += n
            left -= n
    return stretches


def packed(
    docs: DataFrame, vocabulary: str | None = None, sequence: int = SEQUENCE, end_id: int = 0, text: str = "text",
    doc_id: str = "doc_id", with_ids: bool = False,
) -> DataFrame:
    """The pieces with their sequence_id and their offset there, gapless from 0."""
    pieces = written_table(
        tokenized_pieces(docs, vocabulary or word_vocabulary(), sequence, end_id, text, doc_id, with_ids), "pieces"
    )
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    stretches = best_fit_plan(histogram, sequence)
    digits = digits_for(sum(histogram.values()))
    key = F.md5(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("piece").cast("string"), F.col("ids_crc32").cast("string")))
    ranked = ranked_within(
        pieces.withColumn("__key", key).withColumn("__bucket", F.substring("__key", 1, digits) if digits else F.lit("")),
        ["length"], "__bucket", ["__key"], rank="__rank",
    ).drop("__key", "__bucket")
    # one entry per length: its stretches in order of their first piece
    by_length: dict[int, list[tuple]] = {}
    for s in stretches:
        by_length.setdefault(s[0], []).append(s[1:])
    fields = [f.name for f in pieces.schema]

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = {k: np.array(v, np.int64) for k, v in by_length.items()}
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("__rank").to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, cuts):
                if len(rows):
                    own = spans[int(length[rows[0]])]
                    s = own[np.searchsorted(own[:, 0], rank[rows], side="right") - 1]
                    nth = rank[rows] - s[:, 0]
                    seq[rows] = s[:, 2] + nth // s[:, 3]
                    off[rows] = s[:, 4] + nth % s[:, 3] * length[rows]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in fields), pa.array(seq), pa.array(off)], names=[*fields, "sequence_id", "offset"]
            )

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(seat, f"{ddl}, sequence_id bigint, offset bigint")
