"""State of a stream in files: one generation per micro-batch, folded now and then.

A batch writes its generation by overwriting it and reads only older ones, so a batch that
is replayed after a failure reads and leaves the same state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import drop_paths

FOLD = 16


class Generations:
    """Rows of ``schema`` in ``changed`` generations since the last ``whole`` one."""

    def __init__(self, spark: SparkSession, path: str, schema: str, fold: int | None = None):
        self.spark, self.path, self.schema, self.fold = spark, path, schema, fold or FOLD

    def kept(self, before: int) -> list[str]:
        """Folders of the newest whole generation before a batch, and of the changes since."""
        base = max((g for g in self.numbers("whole") if g < before), default=-1)
        changes = [self._folder("changed", g) for g in self.numbers("changed") if base < g < before]
        return [self._folder("whole", base)] * (base >= 0) + changes

    def read(self, before: int) -> DataFrame:
        """All rows that were written before a batch and are still needed."""
        folders = self.kept(before)
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def due(self, batch_id: int) -> bool:
        """Whether this batch is to write a whole generation."""
        return len(self.kept(batch_id)) >= self.fold

    def put(self, rows: DataFrame, batch_id: int, whole: bool = False) -> None:
        """Write a batch's generation; after a whole one, what no replay reads goes."""
        names = self.spark.createDataFrame([], self.schema).columns
        rows.select(*names).write.mode("overwrite").parquet(self._folder("whole" if whole else "changed", batch_id))
        if whole:
            needed = set(self.kept(batch_id))
            old = [self._folder(k, g) for k in ("whole", "changed") for g in self.numbers(k) if g < batch_id]
            drop_paths(self.spark, [f for f in old if f not in needed])

    def numbers(self, kind: str) -> list[int]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n.partition("-")[2]) for n in names if n.startswith("generation-"))

    def _folder(self, kind: str, generation: int) -> str:
        return f"{self.path}/{kind}/generation-{generation}"
