"""A keyed table whose reads do not grow with its history.

Every batch is a run: its last row per key, in one file for each range of key hashes.
Where a level holds ``fanout`` runs, they are merged into one run of the next level, so a
range has fewer than ``fanout`` files on each of some log(batches) levels, and a row is
rewritten once per level. ``lookup`` and ``with_created`` read the ranges of their keys only.

A batch is committed by its manifest, a small file that names the live runs and appears
by a rename. A batch that is replayed before its commit writes the same folders again;
one that is replayed later changes nothing. Runs go once neither the newest manifest nor
the one before it names them. One writer at a time. Null keys are a key.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from ..session import drop_paths
from .keyed import last_by_key

BATCH, RANGE = "__batch", "__range"


class LeveledTable:
    """``ranges`` (a power of two) is fixed when a table is made: so many that a range of all
    rows is a file of a good size."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, ranges: int = 64, fanout: int = 4):
        if ranges < 1 or ranges & (ranges - 1) or fanout < 2:
            raise ValueError("ranges is a power of two, and fanout is 2 or more")
        self.spark, self.path, self.schema, self.key = spark, path, schema, key
        self.ranges, self.fanout = ranges, fanout
        self.stored = StructType([*schema.fields]).add(BATCH, LongType()).add(RANGE, IntegerType())

    # ------------------------------------------------------------------- writing

    def upsert(self, rows: DataFrame, batch_id: int, order: list[str] = ()) -> None:
        """Write one batch; within it the last row in ``order`` wins."""
        if batch_id <= max(self._versions(), default=-1):
            return
        last = last_by_key(rows, self.key, list(order), self.schema.names)
        runs = [*self.runs(batch_id), self._write(last.withColumn(BATCH, F.lit(batch_id).cast("bigint")), 0, batch_id)]
        level = 0
        while len(full := [r for r in runs if r["level"] == level]) >= self.fanout:
            # the range is the shuffle key, so one shuffle serves the grouping and the files
            dealt = self._read(full).repartition(RANGE)
            columns = [*self.schema.names, BATCH]
            newest = F.max(F.struct(F.col(BATCH), *[c for c in columns if c not in (BATCH, self.key)])).alias("__last")
            merged = dealt.groupBy(RANGE, self.key).agg(newest)
            merged = merged.select(RANGE, *[F.col(c) if c == self.key else F.col("__last")[c].alias(c) for c in columns])
            runs = [r for r in runs if r["level"] != level]
            level += 1
            runs.append(self._write(merged, level, batch_id))
        self._commit(runs, batch_id)

    def sink(self, order: list[str] = ()):
        """For ``writeStream.foreachBatch``."""
        return lambda batch, batch_id: self.upsert(batch, batch_id, order)

    def _write(self, rows: DataFrame, level: int, run: int) -> dict[str, int]:
        if RANGE not in rows.columns:
            rows = rows.withColumn(RANGE, self._range(F.col(self.key))).repartition(RANGE)
        folder = self._folder({"level": level, "run": run})
        rows.sortWithinPartitions(RANGE, self.key).write.mode("overwrite").partitionBy(RANGE).parquet(folder)
        return {"level": level, "run": run}

    def _commit(self, runs: list[dict[str, int]], batch_id: int) -> None:
        fs, manifests = self._files("manifests")
        before = self.runs(batch_id)
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        staged = hadoop.Path(f"{self.path}/staged-{batch_id}")
        out = fs.create(staged, True)
        out.write(bytearray(json.dumps(runs).encode()))
        out.close()
        fs.mkdirs(manifests)
        if not fs.rename(staged, hadoop.Path(manifests, f"batch-{batch_id}")):
            raise OSError(f"batch {batch_id} could not be committed")
        needed = [*runs, *before]
        drop_paths(self.spark, [self._folder(r) for r in self._stored() if r["run"] <= batch_id and r not in needed])

    # ------------------------------------------------------------------- reading

    def runs(self, before: int | None = None) -> list[dict[str, int]]:
        """The live runs, now or as they were before a batch (the newest one at most)."""
        versions = [v for v in self._versions() if before is None or v < before]
        return self._manifest(versions[-1]) if versions else []

    def current(self) -> DataFrame:
        return last_by_key(self._read(self.runs()), self.key, [BATCH], self.schema.names)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The current rows of the keys in ``keys``."""
        wanted = keys.select(self.key).distinct()
        found = self._matching(wanted, self._read(self.runs()), "left_semi")
        return last_by_key(found, self.key, [BATCH], self.schema.names)

    def with_created(self, rows: DataFrame, before: int | None = None) -> DataFrame:
        """Rows with ``created``: whether their key is new to the table (as it stood before
        batch ``before``, the newest one)."""
        seen = self._pruned(self._read(self.runs(before)), rows)
        known = seen.select(F.col(self.key).alias("__key")).distinct().withColumn("__known", F.lit(True))
        return rows.join(known, F.col(self.key).eqNullSafe(F.col("__key")), "left").select(
            *rows.columns, F.col("__known").isNull().alias("created")
        )

    def _matching(self, wanted: DataFrame, stored: DataFrame, how: str) -> DataFrame:
        named = wanted.select(F.col(self.key).alias("__key"))
        return self._pruned(stored, wanted).join(named, F.col(self.key).eqNullSafe(F.col("__key")), how)

    def _pruned(self, stored: DataFrame, wanted: DataFrame) -> DataFrame:
        """Stored rows of the ranges that the wanted keys fall in: at most ``ranges`` numbers
        come to the driver, and the scan lists only their folders."""
        touched = [r[0] for r in wanted.select(self._range(F.col(self.key)).alias("r")).distinct().collect()]
        return stored if len(touched) == self.ranges else stored.where(F.col(RANGE).isin(sorted(touched)))

    def _read(self, runs: list[dict[str, int]]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.stored)
        folders = [self._folder(r) for r in runs]
        reader = self.spark.read.schema(self.stored)
        frames = [reader.option("basePath", f).parquet(f) for f in folders]
        whole = frames[0]
        for frame in frames[1:]:
            whole = whole.unionByName(frame)
        return whole

    def _range(self, key: Column) -> Column:
        bits = self.ranges.bit_length() - 1
        hashed = F.xxhash64(key)
        return (F.shiftrightunsigned(hashed, 64 - bits) if bits else F.lit(0)).cast("int")

    # --------------------------------------------------------------------- files

    def _folder(self, run: dict[str, int]) -> str:
        return f"{self.path}/runs/level-{run['level']}/run-{run['run']}"

    def _files(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _versions(self) -> list[int]:
        fs, path = self._files("manifests")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n.partition("-")[2]) for n in names if n.startswith("batch-"))

    def _stored(self) -> list[dict[str, int]]:
        """All runs whose folders are there, also merged ones and those of a batch that died."""
        fs, path = self._files("runs")
        found = []
        for level in fs.listStatus(path) if fs.exists(path) else []:
            for run in fs.listStatus(level.getPath()):
                found.append({"level": int(level.getPath().getName().partition("-")[2]), "run": int(run.getPath().getName().partition("-")[2])})
        return found

    def _manifest(self, version: int) -> list[dict[str, int]]:
        line = self.spark.read.option("wholetext", True).text(f"{self.path}/manifests/batch-{version}").first()
        return json.loads(line[0])
