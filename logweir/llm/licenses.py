"""License scans: MinHash bands over overlapping windows, then exact containment.

A template is a license's notice. Words are runs of letters and digits in lower case, and
a template and a text are seen as their shingles of ``width`` words. Templates of about
the same number of shingles, ``m``, share windows: ``m + m // 2`` shingles, each starting
``m // 2 + 1`` after the one before, so a notice lies in some window as a whole. A window that holds the
share ``containment`` of a template has at least the Jaccard similarity
``containment * m / (m + slack + (1 - containment) * m)`` with it, and ``bands`` bands of
``rows`` MinHashes are chosen so that such a pair meets in no band with probability at
most ``MISS``. Windows that meet a template in a band are compared with it shingle by
shingle; only exact containment counts.

Templates are a short list of the caller's, so tasks carry them and nothing is shuffled.
Null and empty texts hold nothing. A template shorter than ``width`` words is one shingle
of its own length. Rows are scanned one by one, whole, so repeated rows give repeated
results; extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import hash_words, in_slices, mix64, window_hashes

WIDTH = 5
CONTAINMENT = 0.75
MISS = 1e-6
ROWS = 1
#: Notices by which licenses are declared.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit", "Released under the MIT License."),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("bsd-header", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
)
_SEPARATORS = re.compile(r"[\W_]+")


def plain_words(text: str) -> bytes:
    """Runs of letters and digits, lower case, parted by blanks."""
    return _SEPARATORS.sub(" ", text.lower()).encode("utf-8", "surrogatepass")


def bands_for(similarity: float, rows: int, miss: float = MISS) -> int:
    """Bands that a pair of this similarity avoids with probability ``miss`` at most."""
    hit = similarity**rows
    return 1 if hit >= 1 else math.ceil(math.log(miss) / math.log1p(-hit))


class _Class:
    """Templates that share window sizes: from ``m`` shingles to less than twice as many."""

    def __init__(self, width: int, names: list[str], sets: list[np.ndarray], containment: float, rows: int) -> None:
        self.width, self.names, self.sets, self.rows = width, names, sets, rows
        m = max(map(len, sets))
        self.stride, self.span = m // 2 + 1, m + m // 2
        self.run = 1 << (self.span.bit_length() - 1)  # two runs of this size cover a window
        held = [math.ceil(containment * len(s)) for s in sets]
        self.bands = bands_for(min(h / (self.span + len(s) - h) for h, s in zip(held, sets)), rows)

    def learn(self, minima: list[np.ndarray]) -> None:
        """``minima``: for each MinHash, those of the templates."""
        bands = _banded(minima, self.bands, self.rows)
        self.table, self.known = [], np.zeros((self.bands, 1 << 16), bool)
        for b, own in enumerate(bands):
            order = np.argsort(own, kind="stable")
            self.table.append((own[order], order))
            self.known[b, (own >> np.uint64(48)).astype(np.int64)] = True  # a first test by 16 bits

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of every window, over the shingles of texts laid end to
        end; the last window of a text ends with it."""
        begin, count = at[:-1], np.maximum(np.diff(at) - self.width + 1, 0)
        many = np.where(count > 0, 1 + np.maximum(-(-(count - self.span) // self.stride), 0), 0)
        text = np.repeat(np.arange(len(count)), many)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
        start = np.minimum(nth * self.stride, np.maximum(count[text] - self.span, 0))
        return begin[text] + start, begin[text] + np.minimum(start + self.span, count[text]), text

    def met(self, minima: list[np.ndarray]) -> set[tuple[int, int]]:
        """(window, template) that share a band."""
        pairs = set()
        for b, own in enumerate(_banded(minima, self.bands, self.rows)):
            maybe = np.flatnonzero(self.known[b, (own >> np.uint64(48)).astype(np.int64)])
            if len(maybe):
                values, who = self.table[b]
                left, right = np.searchsorted(values, own[maybe], "left"), np.searchsorted(values, own[maybe], "right")
                for i in np.flatnonzero(right > left).tolist():
                    pairs.update((int(maybe[i]), int(t)) for t in who[left[i] : right[i]])
        return pairs


def _banded(minima: list[np.ndarray], bands: int, rows: int) -> Iterator[np.ndarray]:
    for b in range(bands):
        key = np.zeros_like(minima[0])
        with np.errstate(over="ignore"):
            for low in minima[b * rows : (b + 1) * rows]:
                key = mix64(key * np.uint64(31) + low)
        yield key


class LicenseIndex:
    """Templates, by class of length, with their bands."""

    def __init__(self, templates: Sequence[tuple[str, str]], width: int = WIDTH, containment: float = CONTAINMENT, rows: int = ROWS) -> None:
        self.containment = containment
        groups: dict[tuple[int, int], list[tuple[str, np.ndarray]]] = {}
        for name, text in templates:
            words, _ = hash_words([plain_words(text)])
            if len(words):
                own = min(width, len(words))
                shingles = np.unique(window_hashes(words, own, 4))
                groups.setdefault((own, len(shingles).bit_length()), []).append((name, shingles))
        self.classes = [_Class(w, [n for n, _ in g], [s for _, s in g], containment, rows) for (w, _), g in sorted(groups.items())]
        hashes = max((c.bands * rows for c in self.classes), default=0)
        random = np.random.default_rng(5)
        self.factors = random.integers(1, 1 << 62, hashes).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        for c in self.classes:
            c.learn([np.array([h.min() for h in (_hashed(s, f) for s in c.sets)]) for f in self.factors[: c.bands * rows]])

    def scan(self, words: np.ndarray, at: np.ndarray) -> dict[tuple[int, str], tuple[float, int, int]]:
        """``words`` of texts laid end to end, ``at``: where each starts. For each (text,
        template) found: its best containment, the first word of its first window and the
        number of windows that hold it."""
        out: dict[tuple[int, str], tuple[float, int, int]] = {}
        for width in sorted({c.width for c in self.classes}):
            shingles = window_hashes(words, width, 4)
            classes = sorted((c for c in self.classes if c.width == width), key=lambda c: c.run)
            windows = [c.windows(at) for c in classes]
            if not len(shingles):
                continue
            minima: list[list[np.ndarray]] = [[] for _ in classes]
            for k, factor in enumerate(self.factors):
                run, size = _hashed(shingles, factor), 1
                whole = run
                for c, (start, end, _), own in zip(classes, windows, minima):
                    if k >= c.bands * c.rows:
                        continue
                    while size < c.run and len(run) > size:
                        run = np.minimum(run[:-size], run[size:])
                        size *= 2
                    own.append(_least(run, whole, start, end, c.run))
            for c, (start, end, text), own in zip(classes, windows, minima):
                for i, t in sorted(c.met(own)) if len(start) else ():
                    share = float(np.isin(c.sets[t], shingles[start[i] : end[i]]).mean())
                    if share >= self.containment:
                        key, first = (int(text[i]), c.names[t]), int(start[i] - at[text[i]])
                        best, before, n = out.get(key, (0.0, first, 0))
                        out[key] = (max(best, share), min(before, first), n + 1)
        return out


def _hashed(shingles: np.ndarray, factor: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = shingles * factor
    return h ^ (h >> np.uint64(32))


def _least(run: np.ndarray, whole: np.ndarray, start: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """Minima of the windows: two runs cover a full one; those of short texts are scanned."""
    full = end - start >= size
    out = np.zeros(len(start), np.uint64)
    out[full] = np.minimum(run[start[full]], run[end[full] - size])
    if not full.all():
        short = np.flatnonzero(~full)
        ends = np.append(whole, np.uint64(0))  # so that an end may lie behind the last shingle
        out[short] = np.minimum.reduceat(ends, np.stack([start[short], end[short]], 1).ravel())[::2]
    return out


def scan(
    docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH,
    containment: float = CONTAINMENT, rows: int = ROWS,
) -> DataFrame:
    """doc_id, license, containment, first_word, windows: a row for every document and template it holds."""
    templates = list(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = LicenseIndex(templates, width, containment, rows)
        for batch in in_slices(batches, "text", 1 << 20):
            words, at = hash_words([plain_words(t) if t else b"" for t in batch.column("text").to_pylist()])
            ids = batch.column("doc_id").to_pylist()
            found = [(ids[k], name, *v) for (k, name), v in sorted(index.scan(words, at).items())]
            types = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*found) if found else [[]] * 5, types)], names=["doc_id", "license", "containment", "first_word", "windows"]
            )

    kept = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return kept.mapInArrow(run, "doc_id bigint, license string, containment double, first_word bigint, windows bigint")
