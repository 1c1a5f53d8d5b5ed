from __future__ import annotations

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import SCHEMA, documents
from logweir.llm import queries
from logweir.llm.mixing import Mixture, hypergeometric, shard_quotas


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def filled(sizes, weights, epochs, most):
    """Targets by sharing again and again."""
    total, names = epochs * sum(sizes.values()), list(sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped = set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        level = rest / sum(w[s] for s in free) if free else 0
        over = {s for s in free if level * w[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else level * w[s] for s in names}
        capped |= over


@pytest.fixture(scope="module")
def mixed(spark):
    docs = spark.createDataFrame(documents(), SCHEMA)
    return docs, Mixture(docs, keep_text=True, block_words=16, shard_draws=64)


def test_targets_and_words(mixed):
    docs, mixture = mixed
    rows = mixture.taken().collect()
    assert len(rows) == docs.count()
    sizes = {}
    for d in documents():
        sizes[d[3]] = sizes.get(d[3], 0) + size_of(d[1])
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    expected = filled({s: sizes[s] for s in order}, (3, 1, 2), 1.5, 2.0)
    taken = {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(expected[r["source"]])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, n in taken.items():
        assert abs(n - expected[s]) <= 0.5


def test_reruns_agree(spark, mixed):
    docs, mixture = mixed
    again = Mixture(docs.repartition(5), block_words=16, shard_draws=64)
    key = lambda m: sorted((r["doc_id"], r["taken"]) for r in m.taken().collect())
    assert key(mixture) == key(again)


def test_documents_hold_what_is_taken(mixed):
    docs, mixture = mixed
    out = mixture.documents()
    assert out.columns == docs.columns
    rows = out.collect()
    texts = {}
    for d in documents():
        texts.setdefault(d[0], set()).add(d[1])
    total = {}
    for r in rows:
        own = next(iter(texts[r["doc_id"]])).split()
        assert all(w in own for w in r["text"].split()[:50])
        assert r["n_chars"] == len(r["text"])
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + size_of(r["text"])
    planned = {}
    for r in mixture.taken().collect():
        planned[r["doc_id"]] = planned.get(r["doc_id"], 0) + r["taken"]
    assert total == {k: v for k, v in planned.items() if v}


def test_draws_are_disjoint_and_fill_the_shards(mixed):
    _, mixture = mixed
    draws = mixture.shuffled().collect()
    assert len({(r["source_no"], r["draw"]) for r in draws}) == len(draws)
    shards = {}
    for r in draws:
        shards.setdefault(r["shard"], []).append(r["place"])
    assert len(shards) == mixture.shards > 4
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in shards.values())


def test_many_shards_against_sql(spark):
    """The registered SQL with smaller shards, so that the tree has many levels."""
    path = "/root/testdata/sf0.001/documents.parquet"
    sql = queries._OP4_SQL.replace("4095", "15").replace("4096", "16")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{path}'")
    columns = ["doc_id", "size", "source_size", "target", "taken", "n_draws", "places_sha256"]
    expected = con.sql(f"select {', '.join(columns)} from ({sql}) order by doc_id").fetchall()
    mixture = Mixture(spark.read.parquet(path), shard_draws=16)
    assert mixture.shards > 8
    rows = queries.mixing_report(mixture).select(*columns).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == expected


def test_shards_change_the_result(mixed):
    docs, mixture = mixed
    one = Mixture(docs, block_words=16, shard_draws=1 << 20)
    digest = lambda m: sorted((str(r["doc_id"]), r["taken"], r["places_sha256"]) for r in queries.mixing_report(m).collect())
    assert one.shards == 1 and digest(one) != digest(mixture)


def test_hypergeometric_is_the_distribution(spark):
    n = 20_000
    got = spark.range(n).select(hypergeometric(F.lit(30), F.lit(100), F.lit(12), (F.col("id") + 0.5) / n).alias("k")).groupBy("k").count().collect()
    real = np.random.default_rng(0).hypergeometric(30, 70, 12, 400_000)
    for r in got:
        assert abs(r["count"] / n - (real == r["k"]).mean()) < 0.006


def test_quotas_stay_whole(spark):
    quotas = spark.createDataFrame([(1, 1000), (2, 3), (3, 0), (4, 57)], "source_no int, quota bigint")
    rows = shard_quotas(quotas, 7, 1).collect()
    by_source, by_shard = {}, {}
    for r in rows:
        by_source[r["source_no"]] = by_source.get(r["source_no"], 0) + r["n"]
        by_shard[r["shard"]] = by_shard.get(r["shard"], 0) + r["n"]
    assert by_source == {1: 1000, 2: 3, 4: 57}
    assert max(by_shard.values()) - min(by_shard.values()) <= 1


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert Mixture(empty).taken().collect() == []
    only = spark.createDataFrame([(1, None, None, None, None, None)], SCHEMA)
    assert [tuple(r) for r in Mixture(only).taken().select("size", "target", "taken").collect()] == [(0, 0.0, 0)]
