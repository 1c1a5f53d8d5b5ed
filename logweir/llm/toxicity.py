"""Toxicity by a classifier chain over hashed word features.

Categories are predicted one after another by linear (logistic) models. Each sees the
features of the text and the log odds that the chain gave the categories before it. In
training these earlier log odds are out-of-fold: each row's come from models that did not
see the row, so later models learn how far to trust them; the last fit of each category
uses all rows. A category that the training rows have only one side of gets a constant.

Features are present or not: every word (letters, lower case) and its beginnings, hashed.
The training rows choose ``FEATURES`` of them. Training uses at most ``TRAIN_ROWS``
labelled documents; scoring reads all words of all texts. Each combination of labels is
sampled on its own, over all labels, by a hash of the id: an equal part of the rows for
each, or the whole combination if it has fewer (what it leaves goes to the others), so
rare labels are all read. Log odds are corrected for the uneven shares.

The threshold of a category is where its out-of-fold predictions, weighted back to all
labels, make the fewest errors, counting both kinds alike (F1), drawn towards even odds
among the training rows where it lies below them: as if ``FEW`` more positive labels of the
whole table said so. The pull fades as positive labels grow in number. Where labels have
one side only, nothing can be told apart, and it is out of reach.

Null and empty texts have no features. Rows are scored one by one; repeated rows score
alike, extra columns stay. Repeated labels count once; labels of one document that
disagree count as rows of their own. Of texts that share a labelled id, one trains. Without labelled rows, or with one side only, nothing is toxic.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import hash_sample, in_slices

TRAIN_ROWS = 6_000
FEATURES = 2_048
FOLDS = 5
#: Positive labels that the pull of thresholds towards even odds weighs as much as.
FEW = 20.0
#: Lengths of the word beginnings that count as features.
BEGINNINGS = (4, 5, 6, 7)
_KEPT_WORDS = 100_000
_LETTERS = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> set[int]:
    """32-bit hashes of a word's letters and their beginnings."""
    out = set()
    for run in _LETTERS.findall(word.lower()):
        out.add(zlib.crc32(("=" + run).encode()))
        for n in BEGINNINGS:
            if len(run) >= n:
                out.add(zlib.crc32((str(n) + run[:n]).encode()))
    return out


class _Words(dict):
    """Word to its features, of those that count; kept up to a number of words."""

    def __init__(self, wanted: dict[int, int] | None = None) -> None:
        super().__init__()
        self.wanted = wanted

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = word_features(word)
        ids = tuple(found) if self.wanted is None else tuple(self.wanted[f] for f in found if f in self.wanted)
        self[word] = ids
        return ids

    def of(self, text: str) -> set[int]:
        if len(self) > _KEPT_WORDS:
            self.clear()
        out: set[int] = set()
        for ids in map(self.__getitem__, set(text.split())):
            if ids:
                out.update(ids)
        return out


class LinearModel:
    """Logistic regression on sparse 0/1 features and a few dense ones, by Adam."""

    def __init__(self, steps: int = 120, penalty: float = 2e-4, rate: float = 0.1) -> None:
        self.steps, self.penalty, self.rate = steps, penalty, rate
        self.weights, self.dense, self.bias = np.zeros(0), np.zeros(0), 0.0

    def fit(self, rows: np.ndarray, columns: np.ndarray, dense: np.ndarray, y: np.ndarray, width: int) -> LinearModel:
        """``rows``, ``columns``: places of the ones; ``dense``: one row per document."""
        p = y.mean() if len(y) else 0.0
        if not 0 < p < 1:
            self.weights, self.dense, self.bias = np.zeros(width), np.zeros(dense.shape[1]), 6.0 if p else -6.0
            return self
        w = np.zeros(width + dense.shape[1] + 1)
        w[-1] = np.log(p / (1 - p))
        m, v = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, self.steps + 1):
            score = np.bincount(rows, w[columns], len(y)) + dense @ w[width:-1] + w[-1]
            error = (1 / (1 + np.exp(-score)) - y) / len(y)
            g = np.concatenate([np.bincount(columns, error[rows], width), error @ dense, [error.sum()]])
            g[:-1] += self.penalty * w[:-1] / np.sqrt(len(y)) * 10
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= self.rate * (1 - t / (self.steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        self.weights, self.dense, self.bias = w[:width], w[width:-1], float(w[-1])
        return self

    def score(self, rows: np.ndarray, columns: np.ndarray, dense: np.ndarray, n: int) -> np.ndarray:
        return np.clip(np.bincount(rows, self.weights[columns], n) + dense @ self.dense + self.bias, -12, 12)


def _ones(docs: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = [len(d) for d in docs]
    rows = np.repeat(np.arange(len(docs)), sizes)
    columns = np.fromiter((c for d in docs for c in d), np.int64, sum(sizes))
    return rows, columns


def _shift(y: np.ndarray, weights: np.ndarray) -> float:
    """What to add to log odds among the training rows for those among all labels."""
    on, off = (y > 0), (y == 0)
    if not on.any() or not off.any() or (weights == weights[0]).all():
        return 0.0
    return float(np.log(weights[on].mean() / weights[off].mean()))


def shares(counts: Sequence[int], rows: int) -> list[int]:
    """How many of each class to read: equal parts of ``rows``, small classes whole."""
    out, left = [0] * len(counts), rows
    for k, i in enumerate(sorted(range(len(counts)), key=lambda i: counts[i])):
        out[i] = min(counts[i], max(1, left // (len(counts) - k)))
        left -= out[i]
    return out


class Chain:
    """The fitted chain: its features, a model and a threshold for each category."""

    def __init__(self, categories: Sequence[str]) -> None:
        self.categories, self.wanted, self.models, self.thresholds, self.folds_f1 = list(categories), {}, [], [], []

    def fit(self, docs: list[np.ndarray], labels: np.ndarray, folds: np.ndarray, weights: np.ndarray | None = None) -> Chain:
        """``docs``: hashed features of each row; ``labels``: a column per category;
        ``weights``: how many labels each row stands for."""
        n = len(docs)
        weights = np.ones(n) if weights is None else weights
        self._choose(docs, labels)
        width = len(self.wanted)
        rows, columns = _ones([[self.wanted[f] for f in d.tolist() if f in self.wanted] for d in docs])
        before = np.zeros((n, 0))
        for c in range(labels.shape[1]):
            y = labels[:, c].astype(float)
            out = np.zeros(n)
            shift = _shift(y, weights)
            for fold in range(FOLDS):
                held = folds == fold
                if not held.any():
                    continue
                index = np.cumsum(~held) - 1
                on = ~held[rows]
                model = LinearModel().fit(index[rows[on]], columns[on], before[~held], y[~held], width)
                index = np.cumsum(held) - 1
                on = held[rows]
                model.bias += shift
                out[held] = model.score(index[rows[on]], columns[on], before[held], int(held.sum()))
            self.models.append(LinearModel().fit(rows, columns, before, y, width))
            self.models[-1].bias += shift
            self.thresholds.append(self._threshold(out, y, weights, shift))
            before = np.concatenate([before, out[:, None]], 1)
        return self

    def _choose(self, docs: list[np.ndarray], labels: np.ndarray) -> None:
        """The features that tell the categories apart best, by the chi-square statistic."""
        if not docs:
            return
        everything = np.concatenate(docs)
        owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        names, at, df = np.unique(everything, return_inverse=True, return_counts=True)
        best = np.zeros(len(names))
        for c in range(labels.shape[1]):
            y = labels[:, c].astype(float)
            p = y.mean()
            if 0 < p < 1:
                positive = np.bincount(at, y[owner], len(names))
                best = np.maximum(best, (positive - df * p) ** 2 / (df * p * (1 - p) + 1e-9) * (df >= min(3, y.sum())))
        order = np.lexsort((names, -best))[:FEATURES]
        self.wanted = {int(f): i for i, f in enumerate(names[order[best[order] > 0]])}

    def _threshold(self, score: np.ndarray, y: np.ndarray, weights: np.ndarray, shift: float) -> float:
        if not 0 < y.sum() < len(y):
            self.folds_f1.append(float("nan"))
            return 20.0
        order = np.argsort(-score, kind="stable")
        ranked, positive = score[order], (weights * y).sum()
        f1 = 2 * np.cumsum((weights * y)[order]) / (np.cumsum(weights[order]) + positive)
        ends = np.flatnonzero(np.append(ranked[1:] != ranked[:-1], True))  # equal scores fall on one side
        k = int(ends[f1[ends].argmax()])
        self.folds_f1.append(float(f1[k]))
        low = ranked[k + 1] if k + 1 < len(y) else ranked[k] - 1
        limit = float((ranked[k] + low) / 2)
        # the fewer positives, the nearer to even odds at least
        return float((positive * limit + FEW * max(limit, shift)) / (positive + FEW))

    def scores(self, words: _Words, texts: Sequence[str | None]) -> np.ndarray:
        """Log odds of each text and category, down the chain."""
        rows, columns = _ones([sorted(words.of(t)) if t else () for t in texts])
        out = np.zeros((len(texts), 0))
        for model in self.models:
            out = np.concatenate([out, model.score(rows, columns, out, len(texts))[:, None]], 1)
        return out


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], doc_id: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> Chain:
    """Fit a chain on at most ``rows`` labelled documents. ``categories``: a condition on
    ``labels`` for each category, in the order of the chain."""
    marked = labels.where(F.col(doc_id).isNotNull()).select(
        F.col(doc_id).alias("__id"), *[F.coalesce(c, F.lit(False)).alias(f"c{i}") for i, c in enumerate(categories.values())]
    ).distinct()
    names, called = [f"c{i}" for i in range(len(categories))], list(categories)
    classes = sorted(tuple(r) for r in marked.groupBy(*names).count().collect())  # bound: combinations of labels
    parts = shares([c[-1] for c in classes], rows)
    most = {c[:-1]: (part, c[-1] / part) for c, part in zip(classes, parts)}
    chosen = marked.limit(0)
    for c, part in zip(classes, parts):
        mine = [F.col(name) == value for name, value in zip(names, c)]
        chosen = chosen.unionByName(hash_sample(marked.where(reduce(and_, mine)), F.col("__id"), part))
    # bound: the number of training rows
    joined = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text")).join(F.broadcast(chosen), "__id")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in in_slices(batches, "text"):
            found = [np.array(sorted(words.of(t or "")), np.uint32).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("__id"), *(batch.column(c) for c in names), pa.array(found, pa.binary())], names=["__id", *names, "f"])

    got = joined.mapInArrow(hashed, "__id bigint, " + "".join(f"{c} boolean, " for c in names) + "f binary")
    got = got.groupBy("__id", *names).agg(F.min("f").alias("f"))  # of documents that repeat an id, one

    def fitted(rows: list[dict]) -> Chain:
        rows = sorted(rows, key=lambda r: (r["__id"], r["f"], *[r[c] for c in names]))
        weights = np.array([most[tuple(r[c] for c in names)][1] for r in rows], float)
        folds = np.array([zlib.crc32(str(r["__id"]).encode()) % FOLDS for r in rows], np.int64)
        y = np.array([[r[c] for c in names] for r in rows], bool).reshape(len(rows), len(names))
        return Chain(called).fit([np.frombuffer(r["f"], np.uint32) for r in rows], y, folds, weights)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [r for batch in batches for r in batch.to_pylist()]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fitted(held))], pa.binary())], names=["chain"])

    # bound: one task reads the rows chosen, and the driver gets the chain only
    chain = got.repartition(1).mapInArrow(fit, "chain binary").collect()
    return pickle.loads(chain[0]["chain"]) if chain else fitted([])


def judged(docs: DataFrame, chain: Chain, rejecting: Sequence[str], text: str = "text", verdict: str = "toxic") -> DataFrame:
    """``docs`` with ``p_<category>`` for each category and the verdict: whether one of the
    ``rejecting`` categories passes its threshold."""
    added = [f"p_{c}" for c in chain.categories]
    keep = [c for c in docs.columns if c not in (*added, verdict)]
    fields = docs.select(*keep).schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    which = [chain.categories.index(c) for c in rejecting]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(chain.wanted)
        limits = np.array([chain.thresholds[i] for i in which])
        for batch in in_slices(batches, "__text"):
            score = chain.scores(words, batch.column("__text").to_pylist())
            toxic = (score[:, which] > limits).any(1)
            odds = 1 / (1 + np.exp(-score))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), *(pa.array(odds[:, i]) for i in range(len(added))), pa.array(toxic)], names=[*keep, *added, verdict]
            )

    more = ", ".join([*(f"`{c}` double" for c in added), f"`{verdict}` boolean"])
    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, f"{ddl}{', ' if keep else ''}{more}")
