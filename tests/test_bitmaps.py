from __future__ import annotations

import random
from collections import defaultdict

from logweir.sinks import generations
from logweir.streaming.distinct_bitmaps import DistinctBitmaps

SCHEMA = "year int, month int, unit string"


def test_counts_over_batches_and_replays(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(generations, "FOLD", 3)
    r = random.Random(1)
    table = DistinctBitmaps(spark, str(tmp_path), {"year": "int", "month": "int"})
    months, years = defaultdict(set), defaultdict(set)
    for batch_id in range(6):
        rows = [(2000 + r.randrange(2), r.choice([1, 1, 1, 2, None]), r.choice([None, "hot", f"u{r.randrange(300)}"])) for _ in range(400)]
        if batch_id == 2:
            rows = []
        for _ in range(2):  # a replay numbers and counts the same
            table(spark.createDataFrame(rows, SCHEMA), batch_id)
        for y, m, u in rows:
            if u is not None:
                months[y, m].add(u)
                years[y].add(u)
        assert {(x["year"], x["month"]): x["n_distinct"] for x in table.counts().collect()} == {k: len(v) for k, v in months.items()}
    assert {x["year"]: x["n_distinct"] for x in table.counts(["year"]).collect()} == {k: len(v) for k, v in years.items()}
    numbers = sorted(x["number"] for x in table.numbers.read(100).collect())
    assert numbers == list(range(1, 1 + len(set().union(*years.values()))))
    assert len(table.maps.kept(100)) <= 4


def test_more_units_than_a_bitmap(spark, tmp_path):
    table = DistinctBitmaps(spark, str(tmp_path), {"k": "int"}, unit_type="bigint")
    for batch_id, (low, high) in enumerate([(0, 50_000), (30_000, 90_000)]):
        table(spark.range(low, high).selectExpr("cast(id % 2 as int) as k", "id as unit"), batch_id)
    assert sorted(tuple(x) for x in table.counts().collect()) == [(0, 45_000), (1, 45_000)]
    assert table.maps.read(9).count() == 2 * (2 + 3) and table.counts([]).first()["n_distinct"] == 90_000
