from __future__ import annotations

import bisect
import hashlib

import numpy as np
from pyspark.sql import functions as F

from cases import SCHEMA, documents, words
from logweir.llm.fingerprints import BASE_CELLS, differences, likenesses, paragraph_digests, peel, range_of, sketches, versions


def test_rows_against_a_walk(spark):
    docs = [d for d in documents() if d[0] != 4] + [(None, "no id", "en", "a", 1, "x"), (4, documents()[3][1], "en", "a", 1, "x")]
    got = versions(spark.createDataFrame(docs, SCHEMA).repartition(5)).collect()
    order = sorted(((d[0], d[1] or "") for d in docs), key=lambda x: (x[0] is not None, x[0] or 0, hashlib.md5(x[1].encode()).hexdigest()))
    expected = []
    for k, (i, t) in enumerate(order):
        q, after = len(t) // 4, order[(k + 1) % len(order)][1]
        edited = t[: len(t) - q] + after[:q] if q else t
        expected.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=repr) == sorted(expected, key=repr)
    texts = dict(order)
    prints = {}
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        prints.setdefault(texts[r["doc_id"]], set()).add(r["fingerprint"])
        if r["n_chars"] > 200:
            assert r["near_edited"] > 0.5 or r["doc_id"] in (4, 13)  # a tail of one-word lines; one word without blanks
    assert all(len(p) == 1 for p in prints.values())
    assert len({next(iter(p)) for p in prints.values()}) == len(prints)


def test_single_and_empty(spark):
    one = spark.createDataFrame(documents()[:1], SCHEMA)
    row = versions(one).first()
    assert row["near_next"] == 1.0
    assert versions(spark.createDataFrame([], SCHEMA)).collect() == []


def test_differences_are_the_sets(spark):
    r = np.random.default_rng(1)
    pool = r.integers(0, 1 << 62, 60_000).astype(np.uint64)
    sizes = [0, 1, 3, 20, 200, 3000, 25_000]
    lists = [np.unique(pool[: n + 5][5 * (k % 2) :]) for k, n in enumerate(sizes)] + [np.unique(pool[100:25_300])]
    digests, at = np.concatenate(lists), np.concatenate(([0], np.cumsum([len(x) for x in lists])))
    pairs = [(a, b) for a in range(len(lists)) for b in range(len(lists))]
    for (a, b), (left, right) in zip(pairs, differences(digests, at, pairs)):
        assert set(left.tolist()) == set(lists[a].tolist()) - set(lists[b].tolist())
        assert set(right.tolist()) == set(lists[b].tolist()) - set(lists[a].tolist())


def test_peeling_says_when_it_fails(spark):
    a = np.arange(1, 500, dtype=np.uint64)
    made = sketches(a, np.zeros(len(a), np.int64), 1, BASE_CELLS)
    none = sketches(a[:0], np.zeros(0, np.int64), 1, BASE_CELLS)
    assert not peel(made, none)[3][0]
    assert peel(made, made)[3][0]


def test_one_edit_changes_few_paragraphs(spark):
    base = words(9, 400)
    changed = base[:200] + ["new"] + base[201:]
    digests, at = paragraph_digests([" ".join(base).encode(), " ".join(changed).encode(), b"", b"\n \n"])
    assert likenesses(digests, at, [(0, 1), (0, 2), (2, 2), (2, 3)])[0] > 0.9
    assert likenesses(digests, at, [(0, 2), (2, 2), (2, 3)]) == [0.0, 1.0, 0.0]


def test_ranges_however_many_partitions(spark):
    docs = spark.createDataFrame([*documents(), *[(None, f"no id {k % 7}", None, None, 1, "x") for k in range(40)]], SCHEMA)
    few = sorted(map(tuple, versions(docs).collect()), key=repr)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3000")
    try:
        many = sorted(map(tuple, versions(docs.coalesce(2)).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert many == few and len(few) == docs.count()


def test_range_of_an_id(spark):
    for cuts in ([], [5], [-3, 0, 9], list(range(0, 5000, 7))):
        rows = spark.range(-20, 5100, 3).select("id", range_of(F.col("id"), cuts).alias("part")).collect()
        assert all(r["part"] == bisect.bisect_left(cuts, r["id"]) for r in rows)
    null = F.lit(None).cast("bigint")
    assert spark.range(1).select(range_of(null, [1, 2]).alias("p")).first()["p"] == 0


def test_likeness_is_that_of_the_paragraph_sets(spark):
    docs = [(d[0], d[1] or "") for d in documents()[:14]]
    got = {r["doc_id"]: r for r in versions(spark.createDataFrame(documents()[:14], SCHEMA)).collect()}

    def like(a, b):
        digests, at = paragraph_digests([a.encode(), b.encode()])
        left, right = set(digests[at[0] : at[1]].tolist()), set(digests[at[1] : at[2]].tolist())
        return 2.0 * len(left & right) / (len(left) + len(right)) if left or right else 1.0

    for k, (i, text) in enumerate(docs):
        following = docs[(k + 1) % len(docs)][1]
        q = len(text) // 4
        edited = text[: len(text) - q] + following[:q] if q else text
        assert abs(got[i]["near_edited"] - like(text, edited)) < 1e-12
        assert abs(got[i]["near_next"] - like(text, following)) < 1e-12
