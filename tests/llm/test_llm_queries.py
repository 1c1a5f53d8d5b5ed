"""The registered queries against their SQL, and the pipeline stage by stage."""

from __future__ import annotations

import re

import duckdb
import pytest

import __spark_entry__ as driver
import corpus_pipeline
from logweir.llm import registry
from test_jaccard import brute as brute_classes
from test_packing import check as check_places
from test_substrings import brute as brute_repeats

SF = "/root/testdata/sf0.001"
registry.load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, duck, name):
    df = driver.queries()[name](spark, SF)
    columns = sorted(df.columns)
    relation = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in relation.description]
    assert sorted(names) == columns
    expected = sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in relation.fetchall())
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == expected


def test_every_operator_is_registered():
    names = driver.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13
    assert "pipeline" in names and set(registry.ORACLES) <= set(registry.QUERIES)


def test_pipeline_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    given = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        from logweir.session import written_table

        docs = written_table(stage(spark, docs, SF), "test-stage")
        out = docs.collect()
        if name == "toxicity":
            assert {r["doc_id"] for r in out} < {r["doc_id"] for r in given}
            texts = {r["doc_id"]: r for r in given}
            assert all(r == texts[r["doc_id"]] for r in out)
        elif name == "n-gram Jaccard join":
            keep = {d for d, n, c in brute_classes([(r["doc_id"], r["text"]) for r in given]) if d == c}
            assert sorted(r["doc_id"] for r in out) == sorted(keep)
        elif name == "substring dedup":
            expected = {d: (k.decode(), g) for d, _, g, k in brute_repeats([(r["doc_id"], r["text"]) for r in given], 35)}
            before = {r["doc_id"]: r["text"] for r in given}
            assert {r["doc_id"]: r["text"] for r in out} == {d: k if g else before[d] for d, (k, g) in expected.items()}
        elif name == "mixing":
            n = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in rows)
            assert abs(n(out) - 1.5 * n(given)) <= 0.5 * len({r["source"] for r in given}) + 1
        else:
            check_places(out, 2048)
            assert sum(r["piece"] == 0 for r in out) == len(given)
        if name != "packing":
            assert docs.columns == columns
        given = out


def test_pipeline_takes_awkward_rows(spark, tmp_path):
    from cases import SCHEMA, documents

    folder = str(tmp_path)
    spark.createDataFrame(documents(), SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (4, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() > 5
    empty = str(tmp_path / "none")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_near_copies_of_repeated_ids(spark):
    """Unrelated texts of one id both stay, unless the text is itself a near copy."""
    from cases import words

    one, two, three, four, five = (" ".join(words(seed, 60)) for seed in (301, 302, 303, 305, 306))
    near = " ".join(one.split()[:56] + words(304, 4))
    rows = [(1, one), (5, near), (5, two), (7, three), (7, three), (7, one), (8, three), (9, two), (20, four), (20, five)]
    docs = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in rows], ", ".join(f"{c} {k}" for c, k in zip(corpus_pipeline.COLUMNS, ["bigint", "string", "string", "string", "bigint"])))
    got = corpus_pipeline.drop_near_copies(spark, docs, SF).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted([(1, one), (5, two), (7, three), (20, four), (20, five)])
