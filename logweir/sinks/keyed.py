"""Keyed tables: a later row replaces the earlier one with the same key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructType


class KeyedTable:
    """An upsert table on plain files.

    Each batch lands in its own ``batch=<id>`` folder, written by overwriting
    it, so a batch that is replayed after a failure leaves the same state. The
    current row of a key is the one of its highest batch, found at read time by a
    grouped maximum; ``compact`` folds old batches into one.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str):
        self.spark, self.path, self.schema, self.key = spark, path, schema, key

    def upsert(self, rows: DataFrame, batch_id: int, order: list[str] = ()) -> None:
        """Write one batch; within it the last row in ``order`` wins."""
        names = self.schema.names
        self._put(last_by_key(rows, self.key, list(order), names), batch_id)

    def _put(self, rows: DataFrame, batch_id: int) -> None:
        rows.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def history(self) -> DataFrame:
        """All rows written, with their ``batch``; none before the first batch."""
        schema = StructType(self.schema.fields).add("batch", LongType())
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(self.path)

    def current(self) -> DataFrame:
        return last_by_key(self.history(), self.key, ["batch"], self.schema.names)

    def with_created(self, rows: DataFrame, before: int | None = None) -> DataFrame:
        """Rows with ``created``: whether their key is new to the table (as it
        stood before batch ``before``)."""
        seen = self.history()
        if before is not None:
            seen = seen.where(F.col("batch") < before)
        known = seen.select(self.key).distinct().withColumn("__known", F.lit(True))
        return rows.join(known, self.key, "left").select(
            *rows.columns, F.col("__known").isNull().alias("created")
        )

    def compacted(self, path: str) -> "KeyedTable":
        """A table at a new path holding only the current rows, as one batch."""
        latest = self.history().agg(F.max("batch")).head()[0]
        table = KeyedTable(self.spark, path, self.schema, self.key)
        if latest is not None:
            table._put(self.current(), latest)
        return table

    def sink(self, order: list[str] = ()):
        """For ``writeStream.foreachBatch``."""
        return lambda batch, batch_id: self.upsert(batch, batch_id, order)


def last_by_key(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The last row per key in ``order``, or any one where no order is given."""
    rest = [c for c in columns if c != key]
    ranks = [F.col(o).alias(f"__o{i}") for i, o in enumerate(order)]
    last = F.max(F.struct(*ranks, *rest)).alias("__last")
    return df.groupBy(key).agg(last).select(
        *[F.col(c) if c == key else F.col("__last")[c].alias(c) for c in columns]
    )


def last_write(value: str, order: list[str]) -> Column:
    """Aggregate: the value written last, for a map that keeps one value per key."""
    if len(order) == 1:
        return F.max_by(value, order[0])
    return F.max_by(F.col(value), F.struct(*order))
