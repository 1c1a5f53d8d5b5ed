from __future__ import annotations

import os
import random
from urllib.parse import urlparse

import pytest

from logweir.session import fresh_folder
from logweir.sinks.keyed import KeyedTable
from logweir.sinks.leveled import LeveledTable

SCHEMA = "at bigint, key string, value string"


def frame(spark, *data):
    return spark.createDataFrame(list(data), SCHEMA)


def made(spark, **options):
    schema = frame(spark).select("key", "value").schema
    return LeveledTable(spark, fresh_folder(spark, "leveled"), schema, "key", **options)


def files(table, ranges, before=None):
    """Data files of the live runs in some ranges."""
    count = 0
    for run in table.runs(before):
        for r in ranges:
            folder = urlparse(f"{table._folder(run)}/__range={r}").path
            count += len([f for f in os.listdir(folder) if f.endswith(".parquet")]) if os.path.isdir(folder) else 0
    return count


def test_same_rows_as_a_table_that_reads_all(spark, rows):
    """Random batches with ties, nulls and keys that come back, over several levels."""
    rng = random.Random(3)
    table = made(spark, ranges=4, fanout=2)
    plain = KeyedTable(spark, fresh_folder(spark, "t"), table.schema, "key")
    for batch in range(9):
        data = [(rng.randrange(3), rng.choice([None, *"abcdefghij"]), rng.choice([None, f"v{batch}"])) for _ in range(rng.choice([0, 1, 12]))]
        new = frame(spark, *data)
        table.upsert(new, batch, ["at"])
        plain.upsert(new, batch, ["at"])
        if batch % 4 == 0:
            assert rows(table.current()) == rows(plain.current())
    assert rows(table.current()) == rows(plain.current())
    assert max(r["level"] for r in table.runs()) == 3
    wanted = frame(spark, (0, "a", ""), (0, None, ""), (0, "zz", ""), (0, "a", ""))
    expected = [r for r in rows(plain.current()) if r[0] in ("a", None)]
    assert rows(table.lookup(wanted)) == expected
    created = rows(table.with_created(wanted), "key", "created")
    assert created == sorted([("a", False), ("a", False), ("zz", True), (None, (None in {r[0] for r in expected}) is False)], key=repr)


def test_files_of_few_keys_do_not_grow(spark):
    """Reads of one key stay within fanout files on each level while batches go on."""
    table = made(spark, ranges=8, fanout=2)
    counts = []
    for batch in range(12):
        table.upsert(frame(spark, *[(0, f"k{i}", f"v{batch}") for i in range(batch, batch + 30)]), batch)
        counts.append(files(table, [3]))
    assert max(counts) <= 4 and counts[7] == 1  # 8 batches are one run of the third level
    one = frame(spark, (0, "k20", ""))
    found = table.lookup(one)
    assert [tuple(r) for r in found.collect()] == [("k20", "v11")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(__range" in plan or "PartitionFilters: [(__range" in plan
    # what no manifest of the last two names is gone
    kept = sum(len(os.listdir(urlparse(f"{table.path}/runs/{level}").path)) for level in os.listdir(urlparse(f"{table.path}/runs").path))
    assert kept <= 8


def test_replays(spark, rows):
    table = made(spark, ranges=2, fanout=2)
    first, second = frame(spark, (0, "a", "x"), (0, "b", "x")), frame(spark, (0, "a", "y"), (0, "c", "y"))
    table.upsert(first, 0)
    table.upsert(second, 1)
    want = [("a", "y"), ("b", "x"), ("c", "y")]
    assert rows(table.with_created(second, before=1), "key", "created") == [("a", False), ("c", True)]
    for batch, new in ((1, second), (0, first)):  # committed before: nothing happens
        table.upsert(new, batch)
        assert rows(table.current()) == want
    # a batch that died before its commit left folders behind
    table._write(frame(spark, (0, "d", "half")).selectExpr("key", "value", "2L as __batch"), 0, 2)
    assert rows(table.current()) == want
    table.upsert(frame(spark, (0, "d", "whole")), 2)
    assert rows(table.current()) == [*want, ("d", "whole")]


def test_empty_and_wrong_options(spark):
    table = made(spark)
    one = frame(spark, (0, "a", "x"))
    assert table.current().collect() == [] and table.lookup(one).collect() == []
    assert [r.created for r in table.with_created(one).collect()] == [True]
    with pytest.raises(ValueError):
        made(spark, ranges=3)
