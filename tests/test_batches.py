from __future__ import annotations

from collections import Counter

import pytest

from checks import lines as L, stream_queries
from logweir.session import fresh_folder
from logweir.streaming.jobs import each_batch


@pytest.mark.parametrize("rows, parts", [(6, 1), (4000, 7)])
def test_batches_are_ranges_however_many_files_a_table_has(spark, tmp_path, rows, parts):
    table = spark.range(rows).selectExpr("id as doc_id", "cast(id as string) as text")
    table.repartition(parts).write.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    each_batch(
        L.in_batches(spark, str(tmp_path), "documents", "doc_id"),
        lambda batch, _: seen.append(sorted(r.doc_id for r in batch.collect())), f"{fresh_folder(spark, 'c')}/checkpoint",
    ).awaitTermination()
    step = (rows - 1) // L.BATCHES + 1
    assert seen == [list(range(rows))[k * step : (k + 1) * step] for k in range(L.BATCHES)]


def test_word_counts_are_kept_on_disk(spark, tmp_path, monkeypatch):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.createDataFrame([(k, f"w{k % 7}  w{k}") for k in range(40)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(stream_queries, "fresh_folder", lambda spark, label: f"{tmp_path}/{label}")
    got = {r.word: r.n for r in stream_queries.stream_word_count(spark, str(tmp_path)).collect()}
    expected = Counter(w for k in range(40) for w in (f"w{k % 7}", f"w{k}"))
    assert got == expected and spark.conf.get(provider) == before
    state = [p.suffix for p in (tmp_path / "words/checkpoint/state").rglob("[0-9]*.*")]
    assert ".changelog" in state and ".delta" not in state
