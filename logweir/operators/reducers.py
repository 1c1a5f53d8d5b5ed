"""A caller's own reducer over groups and time windows, where no built-in aggregate fits.

A reducer says how a state starts, takes in rows (an Arrow batch at a time), merges with
another state, and ends as output values. Each task reduces its rows to one state per
group before anything is shuffled, so a hot group sends one small row from each task.
Sliding windows reduce rows to panes of gcd(length, slide) first; states of panes, not
rows, are then copied into the windows that hold them.

States must not depend on the order of rows and merges, as tasks run in any order, and
should stay small: states of one group are merged one after the other in one task.
"""

from __future__ import annotations

import pickle
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator, Sequence
from math import gcd
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from .windows import floor_div, micros

#: States that a task holds before it hands them on and starts again.
MOST_HELD = 10_000
_STATE = "__state"


class Reducer(ABC):
    """Sent to the tasks as it is, so it must pickle."""

    @abstractmethod
    def init(self) -> Any:
        """The state of no rows."""

    @abstractmethod
    def add(self, state: Any, rows: pa.RecordBatch) -> Any:
        """The state with more rows of one group."""

    @abstractmethod
    def merge(self, left: Any, right: Any) -> Any:
        """The state of both."""

    @abstractmethod
    def finish(self, state: Any) -> Sequence[Any]:
        """Output values, in the order of the output columns."""


def _fields(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema)


def _states(df: DataFrame, keys: list[str], reducer: Reducer) -> DataFrame:
    """keys and pickled state: one row for each task and group, while a task has no more
    than ``MOST_HELD`` groups at a time."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Any] = {}
        kinds: list[pa.DataType] = []

        def flush() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in held], kind) for i, kind in enumerate(kinds)]
            states = pa.array([pickle.dumps(s) for s in held.values()], pa.binary())
            held.clear()
            return pa.RecordBatch.from_arrays([*columns, states], names=[*keys, _STATE])

        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = [batch.schema.field(k).type for k in keys]
            places = pa.table([*(batch.column(k) for k in keys), pa.array(range(batch.num_rows))], names=[*keys, _STATE])
            groups = places.group_by(keys, use_threads=False).aggregate([(_STATE, "list")])
            names = zip(*(groups.column(k).to_pylist() for k in keys))
            for name, at in zip(names, groups.column(f"{_STATE}_list").combine_chunks()):
                held[name] = reducer.add(held[name] if name in held else reducer.init(), batch.take(at.values))
            if len(held) > MOST_HELD:
                yield flush()
        if held:
            yield flush()

    return df.mapInArrow(partial, f"{_fields(df, keys)}, `{_STATE}` binary")


def _merged(states: DataFrame, keys: list[str], reducer: Reducer, made: Callable[[Any], list], schema: str) -> DataFrame:
    """One row per group: its keys and what ``made`` gives of its whole state."""
    out = StructType([*states.select(*keys).schema, *StructType.fromDDL(schema)])
    kinds = states.sparkSession.createDataFrame([], out).toArrow().schema

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, head = reducer.init(), None
        for batch in batches:
            head = batch.slice(0, 1) if head is None and batch.num_rows else head
            for one in batch.column(_STATE).to_pylist():
                state = reducer.merge(state, pickle.loads(one))
        if head is not None:
            group = [head.column(k) for k in keys]
            values = [pa.array([v], kinds.field(len(keys) + i).type) for i, v in enumerate(made(state))]
            yield pa.RecordBatch.from_arrays([*group, *values], names=kinds.names)

    return states.groupBy(*keys).applyInArrow(fold, out)


def reduced_by(df: DataFrame, keys: Sequence[str], reducer: Reducer, schema: str) -> DataFrame:
    """``keys`` and the reducer's output (``schema``, as DDL) for each group. A null key
    is a group of its own; a table without rows gives none."""
    keys = list(keys)
    return _merged(_states(df, keys, reducer), keys, reducer, lambda s: list(reducer.finish(s)), schema)


def reduced_in_time_windows(
    df: DataFrame, ts: str, length: float, slide: float | None, reducer: Reducer, schema: str,
    keys: Sequence[str] = (), offset: float = 0,
) -> DataFrame:
    """window_start, window_end, ``keys`` and the reducer's output for each window of
    ``length`` seconds at every ``slide`` (tumbling if None, gapped if longer) that has
    rows. Rows without a time are in no window."""
    size, step = micros(length), micros(length if slide is None else slide)
    pane, keys = gcd(size, step), list(keys)
    at = F.unix_micros(ts) - F.lit(micros(offset))
    rows = df.where(F.col(ts).isNotNull()).withColumn("__pane", floor_div(at, F.lit(pane)))
    past = F.pmod(F.col("__pane") * pane, F.lit(step))
    states = _states(rows.where(past < size) if step > size else rows, ["__pane", *keys], reducer)
    if step < size:
        states = _merged(states, ["__pane", *keys], reducer, lambda s: [pickle.dumps(s)], f"`{_STATE}` binary")
    start = F.col("__pane") * pane
    first, last = floor_div(start + pane - size + step - 1, F.lit(step)), floor_div(start, F.lit(step))
    placed = states.withColumn("__window", F.explode(F.sequence(first, last))).select("__window", *keys, _STATE)
    done = _merged(placed, ["__window", *keys], reducer, lambda s: list(reducer.finish(s)), schema)
    begin = F.col("__window") * step + micros(offset)
    names = StructType.fromDDL(schema).fieldNames()
    return done.select(F.timestamp_micros(begin).alias("window_start"), F.timestamp_micros(begin + size).alias("window_end"), *keys, *names)
