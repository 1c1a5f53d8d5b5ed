"""Exact distinct counts over an unbounded stream, as bitmaps over dense unit numbers.

Each unit gets a number when it is first seen: numbers are dense, so a group's units are
bits, 32,768 of them to a bitmap. The state of a group is its bitmaps by bucket: a unit that
a group has seen costs a bit there, however many groups have seen it, and only the table of
numbers has a row per distinct unit. Bitmaps of batches (or of other streams that share the
numbers) merge by or, so counts of groups of groups (a year from its months) are exact too.

A batch is reduced to its distinct (group, unit) pairs first, on the map side as well; a
group that has a third of all rows is many (group, bucket) pairs and no hot key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.ordering import with_row_index
from ..session import drop_paths
from ..sinks.generations import Generations


class DistinctBitmaps:
    """Distinct ``unit`` per ``keys`` (name -> type) of all micro-batches so far."""

    def __init__(self, spark: SparkSession, folder: str, keys: dict[str, str], units: Callable[[DataFrame], DataFrame] | None = None, unit_type: str = "string"):
        self.spark, self.keys, self.units = spark, list(keys), units or (lambda batch: batch)
        columns = "".join(f"{k} {t}, " for k, t in keys.items())
        self.numbers = Generations(spark, f"{folder}/numbers", f"unit {unit_type}, number bigint")
        self.totals = Generations(spark, f"{folder}/totals", "total bigint")
        self.maps = Generations(spark, f"{folder}/maps", f"{columns}bucket bigint, bits binary")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``: ``units`` of a batch has the keys and a column ``unit``."""
        pairs = self.units(batch).select(*self.keys, "unit").where("unit is not null").distinct()
        known = self.numbers.read(batch_id)
        made: list[str] = []
        fresh = with_row_index(pairs.select("unit").distinct().join(known, "unit", "left_anti"), ["unit"], owned=made)
        before = self.totals.read(batch_id).agg(F.coalesce(F.max("total"), F.lit(0))).first()[0]
        numbered = fresh.select("unit", (F.col("row_idx") + F.lit(before + 1)).alias("number"))
        whole = self.numbers.due(batch_id)
        self.numbers.put(known.unionByName(numbered) if whole else numbered, batch_id, whole)
        total = self.numbers.read(batch_id + 1).agg(F.coalesce(F.max("number"), F.lit(0)).alias("total"))
        self.totals.put(total, batch_id, self.totals.due(batch_id))
        numbers = self.numbers.read(batch_id + 1)
        placed = pairs.join(numbers, "unit").withColumn("bucket", F.bitmap_bucket_number("number"))
        maps = placed.groupBy(*self.keys, "bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))
        whole = self.maps.due(batch_id)
        if whole:
            maps = self._merged(self.maps.read(batch_id).unionByName(maps))
        self.maps.put(maps, batch_id, whole)
        drop_paths(self.spark, made)

    def _merged(self, maps: DataFrame, keys: list[str] | None = None) -> DataFrame:
        by = self.keys if keys is None else keys
        return maps.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))

    def counts(self, keys: list[str] | None = None, out: str = "n_distinct") -> DataFrame:
        """Distinct units per group, or per group of fewer ``keys``."""
        by = self.keys if keys is None else keys
        merged = self._merged(self.maps.read(1 << 62), by)
        return merged.groupBy(*by).agg(F.sum(F.bitmap_count("bits")).alias(out))
