"""BPE encoding with an index of pair occurrences, and decoding.

A tokenizer file names its special tokens, normalizer, pre-tokenizer, vocabulary and
merges. Texts are cut at special tokens and ASCII white space; each distinct word is
normalized and pre-tokenized by the library into pieces, and the merges run here, over
all new pieces of a slice of a partition at once:

* symbols of all pieces stand in one linked row; pieces are apart in it;
* an index maps each active rank (a pair that may be merged) to all its occurrences;
* ranks are applied in ascending order, each to all its occurrences at once (of those that
  overlap, the leftmost); the occurrence lists of the pairs at both sides are updated. A
  rank whose product is part of a lower rank goes one occurrence at a time, as that lower
  rank then comes first. So every piece is always merged at its lowest rank, leftmost
  first, whatever else is in the row.

A merge costs a few steps, so a text without white space of any length is no special case. Ids of words are kept between slices of one task (``KEPT`` bytes at most) and
dropped with it. Words are cut at ASCII white space only where the tokenizer drops white
space; with another pre-tokenizer (``by_word=False``) whole texts are the unit.

Null and empty texts have no tokens and decode to the empty text; repeated rows are rows
of their own; an empty table gives no rows; other columns, whatever their names, stay
unless they are named as the results are. Truncation and padding of the file are not used.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import as_bytes, in_slices

#: Bytes of word ids that a task keeps.
KEPT = 16 << 20
_WORD_COST = 200
_NONE = -1


class PairIndex:
    """The merges of a vocabulary, applied to many pieces at once."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]) -> None:
        ranks: dict[tuple[int, int], int] = {}
        for rank, (left, right) in enumerate(merges):
            ranks[vocabulary[left], vocabulary[right]] = rank  # of a repeated pair, the last
        self.ranks = ranks
        self.made = [vocabulary[left + right] for left, right in merges]
        self.twins = {rank for (left, right), rank in ranks.items() if left == right}
        # ranks whose product takes part in a lower rank: their merges go one at a time
        lowest: dict[int, int] = {}
        for pair, rank in ranks.items():
            for part in pair:
                lowest[part] = min(rank, lowest.get(part, rank))
        self.early = {rank for rank in ranks.values() if lowest.get(self.made[rank], rank) < rank}
        self.base = 1 + max(vocabulary.values(), default=0)
        told = sorted((left * (self.base + 1) + right, rank) for (left, right), rank in ranks.items())
        self._pairs = np.array([k for k, _ in told] + [2**62], np.int64)
        self._ranks = np.array([r for _, r in told] + [_NONE], np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left * (self.base + 1) + right
        at = self._pairs.searchsorted(pair)
        return np.where(self._pairs[at] == pair, self._ranks[at], _NONE)

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces' symbols one after another, and each piece's number of them, in and
        out. Place ``n`` stands beyond every piece and pairs with nothing."""
        n = len(symbols)
        symbol = np.append(symbols.astype(np.int64), self.base)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[n] = n
        ends = np.cumsum(lengths)
        starts = ends - lengths
        filled = lengths > 0
        after[ends[filled] - 1] = n
        before[starts[filled]] = n
        alive = np.ones(n, bool)
        rank_at = np.append(self._rank(symbol[:n], symbol[after[:n]]), _NONE) if n else np.array([_NONE])
        held = np.flatnonzero(rank_at >= 0)
        held = held[np.argsort(rank_at[held], kind="stable")]
        cuts = np.flatnonzero(np.diff(rank_at[held])) + 1
        first: dict[int, np.ndarray] = {int(rank_at[g[0]]): g for g in np.split(held, cuts) if len(g)}
        added: dict[int, list[int]] = {}  # occurrences that came with merges
        active = list(first)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            places, more = first.pop(rank, None), added.pop(rank, None)
            if more:
                more = np.unique(np.array(more, np.int64))
                places = more if places is None else np.union1d(places, more)
            if places is None:
                continue
            places = places[rank_at[places] == rank]  # elsewhere a symbol has gone into another merge
            if rank in self.twins and len(places) > 1:
                places = _apart(places, after[places])
            if rank in self.early and len(places) > 1:
                added[rank] = places[1:].tolist()
                heapq.heappush(active, rank)
                places = places[:1]
            if not len(places):
                continue
            gone = after[places]
            right = after[gone]
            symbol[places] = self.made[rank]
            after[places], before[right] = right, places
            left = before[places]  # now that occurrences next to each other are joined
            alive[gone] = False
            rank_at[gone] = _NONE
            touched = np.concatenate([left, places])
            new = self._rank(symbol[touched], symbol[after[touched]])
            rank_at[touched] = new
            hit = new >= 0
            for r, at in zip(new[hit].tolist(), touched[hit].tolist()):
                known = added.get(r)
                if known is None:
                    added[r] = [at]
                    if r not in first:
                        heapq.heappush(active, r)
                else:
                    known.append(at)
        kept = np.concatenate([[0], np.cumsum(alive)])
        return symbol[:n][alive], kept[ends] - kept[starts]


def _apart(places: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Of occurrences in a row that share a symbol, the first, third and so on."""
    chained = np.concatenate([[False], places[1:] == gone[:-1]])
    number = np.arange(len(places))
    return places[(number - np.maximum.accumulate(np.where(chained, 0, number))) % 2 == 0]


class Codec:
    """A tokenizer file: splitting by the library, merging by ``PairIndex``."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model = told["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("dropout"):
            raise ValueError("a plain BPE model is expected")
        if told.get("decoder") is not None:
            raise ValueError("a file without decoder is expected: tokens are joined by spaces")
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.vocabulary: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.index = PairIndex(self.vocabulary, [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]])
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        marks = "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True))
        self.marks = re.compile(f"({marks})") if marks else None
        singles = {t: i for t, i in self.vocabulary.items() if len(t) == 1}
        lasts = {t[0]: i for t, i in self.vocabulary.items() if len(t) == 1 + len(self.end) and t.endswith(self.end)}
        size = 2 + max(map(ord, singles | lasts), default=0)  # the last place: any other character
        self.inner, self.outer = np.full(size, _NONE), np.full(size, _NONE)
        for table, known in ((self.inner, singles), (self.outer, lasts)):
            for t, i in known.items():
                table[ord(t)] = i
        self.bulk = bool(self.normalizer and self.splitter) and [p for p, _ in self.splitter.pre_tokenize_str("a b")] == ["a", "b"]
        self.tokens = [""] * (1 + max([*self.vocabulary.values(), *self.special.values()], default=0))
        for token, number in (self.vocabulary | self.special).items():
            self.tokens[number] = token

    def pieces(self, word: str) -> list[str | int]:
        """The pieces of a word to merge, and the ids of special tokens among them."""
        out: list[str | int] = []
        for part in self.marks.split(word) if self.marks else [word]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                plain = self.normalizer.normalize_str(part) if self.normalizer else part
                out += [p for p, _ in self.splitter.pre_tokenize_str(plain)] if self.splitter else [plain]
        return out

    def symbols(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Single characters of the pieces, each piece's last with the mark of a word's
        end, and each piece's number of them; unknown ones go."""
        if not pieces:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        points = np.frombuffer("".join(pieces).encode("utf-32-le"), "<u4")
        ends = np.cumsum([len(p) for p in pieces], dtype=np.int64)
        inside = np.minimum(points, len(self.inner) - 1)
        ids = self.inner[inside]
        ids[ends - 1] = self.outer[inside[ends - 1]]
        kept = np.concatenate([[0], np.cumsum(ids >= 0)])
        return ids[ids >= 0], np.diff(kept[ends], prepend=0)

    def split(self, words: list[str]) -> tuple[list[int], list[str | int], list[int]]:
        """The words in some order (their places), all their pieces in that order, and each
        one's number of pieces. Words that are sure to stay one stretch between spaces go
        through the library together."""
        order: list[int] = []
        flat: list[str | int] = []
        counts: list[int] = []
        together = [k for k, w in enumerate(words) if w and w.isprintable()] if self.bulk else []  # no white space of any kind
        for at in range(0, len(together), 20_000):
            group = together[at : at + 20_000]
            text = " ".join([words[k] for k in group])
            if self.marks and self.marks.search(text):
                group = [k for k in group if not self.marks.search(words[k])]
                text = " ".join([words[k] for k in group])
            text = self.normalizer.normalize_str(text)
            limits = np.cumsum([len(w) + 1 for w in text.split(" ")])
            if len(limits) != len(group):
                continue  # one by one, below
            pieces = self.splitter.pre_tokenize_str(text)
            owners = limits.searchsorted([span[0] for _, span in pieces], side="right")
            order += group
            flat += [piece for piece, _ in pieces]
            counts += np.bincount(owners, minlength=len(group)).tolist()
        for k in sorted(set(range(len(words))).difference(order)):
            own = self.pieces(words[k])
            order.append(k)
            flat += own
            counts.append(len(own))
        return order, flat, counts

    def encode_words(self, words: list[str]) -> tuple[list[int], list[bytes]]:
        """The words in some order (their places) and the ids of each, packed; all different
        pieces are merged together."""
        order, flat, counts = self.split(words)
        different = [p for p in dict.fromkeys(flat) if isinstance(p, str)]
        ids, lengths = self.index.merge(*self.symbols(different))
        packed, limits = ids.astype("<u4").tobytes(), (4 * np.concatenate([[0], np.cumsum(lengths)])).tolist()
        merged: dict[str | int, bytes] = {p: packed[a:b] for p, a, b in zip(different, limits, limits[1:])}
        merged |= {number: number.to_bytes(4, "little") for number in self.special.values()}
        told = list(map(merged.__getitem__, flat))
        ends = np.cumsum(counts, dtype=np.int64).tolist()
        return order, [told[e - 1] if n == 1 else b"".join(told[e - n : e]) for e, n in zip(ends, counts)]


@lru_cache(maxsize=1)
def codec_of(path: str) -> Codec:
    """One codec for each worker process: its size is the file's, whatever the data."""
    return Codec(path)


class WordIds:
    """Ids of words as packed 32-bit numbers, kept up to a number of bytes."""

    def __init__(self, codec: Codec, by_word: bool, kept: int = KEPT) -> None:
        self.codec, self.by_word, self.most = codec, by_word, kept
        self.ids: dict[bytes, bytes] = {}
        self.size = 0

    def of(self, texts: list[bytes]) -> Iterator[bytes]:
        split = [t.split() if self.by_word else ([t] if t else []) for t in texts]
        used = set().union(*split)
        if self.size > self.most:  # only what these texts need stays
            self.ids = {w: self.ids[w] for w in used & self.ids.keys()}
            self.size = sum(map(len, self.ids)) + sum(map(len, self.ids.values())) + _WORD_COST * len(self.ids)
        new = list(used - self.ids.keys())
        order, ids = self.codec.encode_words([w.decode("utf-8", "replace") for w in new])
        self.ids.update(zip([new[k] for k in order], ids))
        self.size += sum(map(len, new)) + sum(map(len, ids)) + _WORD_COST * len(new)
        known = self.ids.__getitem__
        for words in split:
            yield b"".join(map(known, words))


def encoded(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", by_word: bool = True) -> DataFrame:
    """The table with ``ids`` (array of int) in place of ``text``."""
    kept = [c for c in docs.columns if c not in (text, ids)]
    source, ddl = _numbered(docs, [*kept, text])
    last = f"c{len(kept)}"
    ddl = ddl.rpartition(f"{last} ")[0] + f"{last} array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = None
        for batch in in_slices(batches, last, 4 << 20):
            words = words or WordIds(codec_of(vocabulary), by_word)
            packed = list(words.of(as_bytes(batch.column(last))))
            limits = [0]
            for p in packed:
                limits.append(limits[-1] + len(p) // 4)
            flat = pa.Array.from_buffers(pa.int32(), limits[-1], [None, pa.py_buffer(b"".join(packed))])
            lists = pa.ListArray.from_arrays(pa.array(limits, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=batch.schema.names)

    return source.mapInArrow(run, ddl).toDF(*kept, ids)


def _numbered(df: DataFrame, names: list[str]) -> tuple[DataFrame, str]:
    """The named columns as c0, c1, ... and their types: a task sees no clashing names."""
    plain = df.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)])
    return plain, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema)


def _in_parts(batch: pa.RecordBatch, lists: pa.Array, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch cut so that each part has about ``most`` tokens, or one row."""
    first = total = 0
    for row, n in enumerate(pc.list_value_length(lists).fill_null(0).to_pylist()):
        if total and total + n > most:
            yield batch.slice(first, row - first)
            first, total = row, 0
        total += n
    if first < batch.num_rows:
        yield batch.slice(first)


def decoded(coded: DataFrame, vocabulary: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """The table with ``text`` beside ``ids``: tokens joined by spaces, special ones too.
    Numbers that name no token are left out, as the library does; null ids are none."""
    kept = [c for c in coded.columns if c != text]
    source, ddl = _numbered(coded, kept)
    at = kept.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = known = None
        for batch in batches:
            if tokens is None:
                codec = codec_of(vocabulary)
                tokens = pa.array(codec.tokens)
                known = pa.array([t in codec.vocabulary or t in codec.special for t in codec.tokens])
            for part in _in_parts(batch, batch.column(at)):
                lists = part.column(at)
                lists = pc.if_else(lists.is_null(), pa.scalar([], lists.type), lists) if lists.null_count else lists
                flat, lengths = lists.flatten(), pc.list_value_length(lists)
                held = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(tokens))).fill_null(False)
                inside = pc.if_else(held, flat, 0)
                named = pc.and_(held, known.take(inside)) if len(flat) else held
                names = tokens.take(inside)
                if len(flat) and not pc.all(named).as_py():
                    parents = pc.list_parent_indices(lists).filter(named)
                    counts = {v["values"]: v["counts"] for v in parents.value_counts().to_pylist()}
                    lengths, names = pa.array([counts.get(k, 0) for k in range(len(lists))], pa.int32()), names.filter(named)
                limits = pa.array([0, *pc.cumulative_sum(lengths.cast(pa.int32())).to_pylist()], pa.int32())
                joined = pc.binary_join(pa.ListArray.from_arrays(limits, names), " ")
                yield pa.RecordBatch.from_arrays([*part.columns, joined], names=[*part.schema.names, "told"])

    return source.mapInArrow(run, f"{ddl}, told string").toDF(*kept, text)
