from __future__ import annotations

import random

import numpy as np
import pytest

from logweir.operators.bloom import BloomTable, bloom_size, key_bits
from logweir.sinks import generations

SCHEMA = "at bigint, text string, extra string"


def batches(n: int, each: int, values: int, seed: int) -> list[list[tuple]]:
    r = random.Random(seed)
    rows = [(i, "hot" if r.random() < 0.3 else f"m{r.randrange(values)}", f"e{i}") for i in range(n * each)]
    r.shuffle(rows)
    return [rows[k * each : (k + 1) * each] for k in range(n)]


@pytest.mark.parametrize("p,block_bits", [(0.08, 1 << 12), (0.01, 1 << 14), (0.3, 1 << 12)])
def test_no_repeat_passes_and_few_firsts_are_lost(spark, tmp_path, p, block_bits):
    values = 6000
    table = BloomTable(spark, str(tmp_path), values, p, block_bits)
    assert table.blocks > 1
    seen, passed, firsts = set(), [], 0
    for k, rows in enumerate(batches(5, 2500, values, 1)):
        out = table.admit(spark.createDataFrame(rows, SCHEMA), k, "text", ["at"], ["text", "extra"]).collect()
        again = table.admit(spark.createDataFrame(rows, SCHEMA), k, "text", ["at"], ["text", "extra"]).collect()
        assert sorted(out) == sorted(again)  # a replayed batch
        first = {}
        for at, text, extra in sorted(rows):
            first.setdefault(text, (at, text, extra))
        assert {tuple(r) for r in out} <= set(first.values())
        firsts += len(first.keys() - seen)
        seen |= first.keys()
        passed += [r["text"] for r in out]
    assert len(passed) == len(set(passed)) and firsts == len(seen)
    assert (firsts - len(passed)) / firsts < p
    assert 0.2 < np.mean([r["share"] for r in table.filled(5).collect()]) < 0.6


def test_generations_are_folded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(generations, "FOLD", 3)
    table = BloomTable(spark, str(tmp_path), 500, 0.001, 1 << 10)
    passed = []
    for k in [0, 1, 2, 5, 6, 7, 40, 41]:  # ids need not follow each other
        rows = [(i, f"m{i % 60}", "e") for i in range(k * 5, k * 5 + 40)]
        for _ in range(2):
            out = table.admit(spark.createDataFrame(rows, SCHEMA), k, "text", ["at"], ["text"]).collect()
        passed += [r["text"] for r in out]
    assert len(passed) == len(set(passed)) >= 59
    assert len(table.state.numbers("changed")) + len(table.state.numbers("whole")) <= 2 * 3 + 2
    assert len(table.state.kept(100)) <= 4


def test_null_texts_and_empty_batches(spark, tmp_path):
    table = BloomTable(spark, str(tmp_path), 10, 0.01)
    assert table.admit(spark.createDataFrame([], SCHEMA), 0, "text", ["at"]).collect() == []
    rows = [(1, None, "a"), (2, None, "b"), (3, "", "c"), (4, "", "d")]
    got = table.admit(spark.createDataFrame(rows, SCHEMA), 1, "text", ["at"], ["text"]).collect()
    assert sorted(r["at"] for r in got) in ([1], [1, 3])
    assert table.admit(spark.createDataFrame(rows, SCHEMA), 2, "text", ["at"], ["text"]).collect() == []


def test_sizes():
    assert bloom_size(265_569_231, 0.08)[1] == 4
    blocks, probes = bloom_size(1_000_000, 0.01)
    assert probes == 7 and 9 < blocks <= 10
    with pytest.raises(ValueError):
        bloom_size(10, 1.5)
    places = key_bits(np.arange(1000, dtype=np.int64), 7, 1 << 10)
    assert places.shape == (1000, 7) and places.min() >= 0 and places.max() < 1 << 10
