"""Approximate de-duplication by a partitioned Bloom filter that lives in a table.

The filter has the bits that ``n`` keys need at a false-drop rate of ``p``, cut into blocks
of ``BLOCK_BITS`` by a hash of the key; all bits of a key lie in one block. A batch is
reduced to its distinct keys first (a message that makes up a third of it is one row per
map task), dealt by block, and each block is held against its bits in one task: keys whose
bits are not all set pass, and their bits are set. So a duplicate never passes, in its
batch or a later one, and a first arrival is dropped with a probability below ``p`` while
at most ``n`` keys are held. A block of a filter for n keys holds about n / blocks of them,
whatever their order or skew.

Every batch writes the blocks it changed as a generation; a block's bits are those of its
newest generation before the batch. Now and then a generation holds all blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sinks.generations import Generations
from .dedup import first_by

BLOCK_BITS = 1 << 20
#: Blocks are not filled evenly; this share of bits more keeps the fullest below ``p``.
_MARGIN = 1.02


def bloom_size(n: int, p: float, block_bits: int = BLOCK_BITS) -> tuple[int, int]:
    """Blocks, and bits set per key, for ``n`` keys at a false-positive rate ``p``."""
    if n < 1 or not 0 < p < 1:
        raise ValueError("a filter has at least one key, and a rate between 0 and 1")
    bits = _MARGIN * n * -math.log(p) / math.log(2) ** 2
    return max(1, math.ceil(bits / block_bits)), max(1, round(-math.log2(p)))


def key_bits(h: np.ndarray, probes: int, block_bits: int) -> np.ndarray:
    """Places of a key's bits in its block, by double hashing; one row per key."""
    h = h.view(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    i = np.arange(probes, dtype=np.uint64)
    return ((low[:, None] + i * high[:, None] + i * i * i) % np.uint64(block_bits)).astype(np.int64)


class BloomTable:
    """A Bloom filter over several batches, in files below ``path``."""

    def __init__(self, spark: SparkSession, path: str, n: int, p: float, block_bits: int = BLOCK_BITS):
        if block_bits % 8:
            raise ValueError("a block is whole bytes")
        self.spark, self.path, self.block_bits = spark, path, block_bits
        self.blocks, self.probes = bloom_size(n, p, block_bits)
        self.state = Generations(spark, f"{path}/bits", "block bigint, bits binary, generation bigint")

    def bits(self, before: int) -> DataFrame:
        """block, bits of the filter as it was before batch ``before``."""
        return self.state.read(before).groupBy("block").agg(F.max_by("bits", "generation").alias("bits"))

    def admit(self, rows: DataFrame, batch_id: int, key: Column | str, order: list[str], keep: list[str] = ()) -> DataFrame:
        """``order`` and ``keep`` of the first row of each key that the filter does not know
        yet. The result is stored; calling again with the same batch gives it again."""
        text = F.col(key) if isinstance(key, str) else key
        names = [*order, *keep]
        firsts = first_by(rows, F.struct(F.xxhash64(text).alias("a"), F.xxhash64(text, F.lit(1)).alias("b")), order, [F.col(k) for k in keep])
        asked = firsts.select(F.pmod("__key.a", F.lit(self.blocks)).alias("block"), F.col("__key.b").alias("h"), *names)
        told = asked.groupBy("block").cogroup(self.bits(batch_id).groupBy("block")).applyInArrow(self._hold(asked.schema.names), self._told(asked))
        path = f"{self.path}/told/batch={batch_id}"
        told.write.mode("overwrite").parquet(path)
        stored = self.spark.read.schema(told.schema).parquet(path)
        changed = stored.where("bits is not null").select("block", "bits", F.lit(batch_id).cast("bigint").alias("generation"))
        whole = self.state.due(batch_id)
        if whole:
            old = self.bits(batch_id).join(changed.select("block"), "block", "left_anti")
            changed = changed.unionByName(old.withColumn("generation", F.lit(batch_id).cast("bigint")))
        self.state.put(changed, batch_id, whole)
        return stored.where("bits is null").select(*names)

    def _told(self, asked: DataFrame) -> str:
        return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema] + ["bits binary"])

    def _hold(self, columns: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
        probes, block_bits = self.probes, self.block_bits

        def hold(rows: pa.Table, held: pa.Table) -> pa.Table:
            schema = rows.schema.append(pa.field("bits", pa.binary()))
            if not rows.num_rows:
                return schema.empty_table()
            bits = np.zeros(block_bits // 8, np.uint8)
            if held.num_rows:
                bits |= np.frombuffer(held.column("bits")[0].as_py(), np.uint8)
            places = key_bits(rows.column("h").to_numpy(), probes, block_bits)
            byte, mask = places >> 3, np.left_shift(1, places & 7).astype(np.uint8)
            known = ((bits[byte] & mask) != 0).all(axis=1)
            np.bitwise_or.at(bits, byte[~known].ravel(), mask[~known].ravel())
            passed = rows.filter(pa.array(~known)).append_column("bits", pa.nulls(int((~known).sum()), pa.binary()))
            if not passed.num_rows:
                return passed
            filled = [pa.array([rows.column("block")[0].as_py() if f.name == "block" else bits.tobytes() if f.name == "bits" else None], f.type) for f in schema]
            return pa.concat_tables([passed, pa.Table.from_arrays(filled, schema=schema)])

        return hold

    def sink(self, out: str, key: Column | str, order: list[str], keep: list[str] = ()) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: rows that pass go to ``out``, a folder for each batch."""

        def write(batch: DataFrame, batch_id: int) -> None:
            self.admit(batch, batch_id, key, order, keep).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

        return write

    def filled(self, before: int) -> DataFrame:
        """block, and the share of its bits that are set: a filter at the number of keys it
        was made for has about half."""
        length = self.block_bits

        def shares(batches):
            for batch in batches:
                share = [float(np.unpackbits(np.frombuffer(b, np.uint8)).sum()) / length for b in batch.column("bits").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(share, pa.float64())], names=["block", "share"])

        return self.bits(before).mapInArrow(shares, "block bigint, share double")
