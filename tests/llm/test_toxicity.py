from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import words
from logweir.llm.toxicity import LinearModel, Chain, judged, shares, train

INSULTS = ["zorgface", "blunthead", "grimwort", "snarlpig", "muckbrain"]


def categories():
    return {"junk": F.col("quality") == 0, "toxic": F.col("toxic") == 1, "never": F.col("toxic") == 5}


def text_of(seed: int, toxic: bool, junk: bool) -> str:
    r = random.Random(seed)
    w = words(seed % 400, 60)
    if junk:
        w = [x + "%%%" for x in w[:20]] + ["lorem"] * 3
    if toxic:
        for _ in range(r.randint(1, 3)):
            w.insert(r.randrange(len(w)), r.choice(INSULTS) + r.choice(["", ".", "s", ","]))
    return " ".join(w)


def corpus(n: int):
    r = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        toxic, junk = r.random() < 0.15, r.random() < 0.2
        rows.append((i, text_of(i, toxic, junk), "x", toxic))
        if i % 2:
            labels.append((i, 0 if junk else 1, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def fitted(spark):
    rows, labels = corpus(1200)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, p_toxic string, truth boolean")
    chain = train(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), categories())
    return docs, chain


def test_held_out_documents(fitted):
    docs, chain = fitted
    got = [r for r in judged(docs, chain, ["toxic"]).collect() if r["doc_id"] % 2 == 0]
    toxic = [r for r in got if r["truth"]]
    assert sum(r["toxic"] for r in toxic) >= 0.95 * len(toxic)
    assert sum(r["toxic"] for r in got if not r["truth"]) <= 0.01 * len(got)
    junk = chain.categories.index("junk")
    assert chain.folds_f1[junk] > 0.95
    assert all(r["p_never"] < 0.01 for r in got)


def test_order_and_bound_do_not_change_rows(spark, fitted):
    docs, chain = fitted
    rows, labels = corpus(1200)
    again = train(docs.repartition(7), spark.createDataFrame(labels[::-1], "doc_id bigint, quality int, toxic int"), categories())
    assert again.thresholds == chain.thresholds
    small = train(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), categories(), rows=40)
    assert len(small.models) == 3


def test_awkward_rows(spark, fitted):
    _, chain = fitted
    rows = [(1, None, "a"), (1, None, "a"), (2, "", "b"), (None, "muckbrain zorgface", "c"), (3, "word " * 200_000 + "snarlpig", "d")]
    got = judged(spark.createDataFrame(rows, "doc_id bigint, text string, toxic string"), chain, ["toxic"]).collect()
    assert [(r["doc_id"], r["toxic"]) for r in sorted(got, key=lambda r: repr(r["doc_id"]))] == [(1, False), (1, False), (2, False), (3, True), (None, True)]
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    blank = train(empty, none, categories())
    assert not any(r["toxic"] for r in judged(spark.createDataFrame(rows, "doc_id bigint, text string, x string"), blank, ["toxic"]).collect())
    assert judged(empty, blank, ["toxic"]).collect() == []


def test_later_links_use_earlier_ones():
    r = np.random.default_rng(0)
    docs = [np.unique(r.integers(0, 50, 8)).astype(np.uint32) for _ in range(600)]
    first = np.array([5 in d.tolist() or 7 in d.tolist() for d in docs])
    chain = Chain(["a", "b"]).fit(docs, np.stack([first, first], 1), np.arange(600) % 5)
    assert chain.models[1].dense.shape == (1,) and chain.models[1].dense[0] > 0
    assert LinearModel().fit(np.zeros(0, int), np.zeros(0, int), np.zeros((3, 0)), np.zeros(3), 4).bias == -6.0


def test_rare_labels_are_all_read(spark):
    """Hardly any draw of 300 labels in 4,000 would hold five of these eight; nor does a
    small table have five."""
    insult = lambda i: f"{text_of(i, False, False)} zorgface grimwort snarlpig"
    rows = [(i, insult(i) if i % 500 == 3 or i >= 4000 else text_of(i, False, i % 3 == 0)) for i in range(4040)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = [(i, int(i % 3 != 0), int(i % 500 == 3)) for i in range(4000)]
    two = [*labels[500:560], labels[3], labels[503]]
    for given in (labels, two):
        chain = train(docs, spark.createDataFrame(given, "doc_id bigint, quality int, toxic int"), categories(), rows=300)
        got = judged(docs, chain, ["toxic"]).collect()
        assert all(r["toxic"] for r in got if r["doc_id"] >= 4000)
        assert sum(r["toxic"] for r in got if r["doc_id"] < 4000 and r["doc_id"] % 500 != 3) <= 20
    assert shares([9000, 8, 500, 9000], 6000) == [2746, 8, 500, 2746] and shares([3, 4], 100) == [3, 4]


def test_training_rows_stay_off_the_driver(spark, monkeypatch):
    """The driver gets the fitted chain, not the features of the rows that train it."""
    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, p_toxic string, truth boolean")
    given = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    kind, got = type(docs), []
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: got.append(collect(self)) or got[-1])
    chain = train(docs, given, categories())
    assert max(map(len, got)) <= 4  # combinations of labels
    assert chain.wanted and len(chain.models) == 3 and sum(w.any() for w in (m.weights for m in chain.models)) == 2
