"""Window aggregates made by the user (2.15), merged in two phases.

A user's aggregate is a small class: an empty state, an update from Arrow columns, a merge of two states, a
result, and both ways between a state and bytes. Tasks fold their rows into one state per (series, window) and
pass on states only; these are brought together by key and merged as a stream. One window may hold a third of all
rows: every task contributes one state to it, not its rows. At most ``STATES`` states are held in a task; beyond that
they are passed on early.

Defined cases: a null key is a key; a window that only holds rows with null values has the result of what ``update`` makes of
them; an empty table has no windows. States may be merged in any order, so ``merge`` must not depend on it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sensorloom.operators.buckets import Origin, assign_windows, fill_gaps, stored_span, window_grid

STATES = 10_000


class WindowAggregate(Protocol):
    """What a user's aggregate has to offer; ``columns`` are the input columns, ``result`` a DDL string of the output."""

    columns: Sequence[str]
    result: str

    def empty(self) -> Any: ...

    def update(self, state: Any, rows: pa.Table) -> Any: ...

    def merge(self, a: Any, b: Any) -> Any: ...

    def finish(self, state: Any) -> tuple: ...

    def pack(self, state: Any) -> bytes: ...

    def unpack(self, data: bytes) -> Any: ...


def _groups(table: pa.Table, keys: Sequence[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, rows) of every key in a batch."""
    codes = np.zeros(len(table), np.int64)
    for name in keys:
        indices = table.column(name).combine_chunks().dictionary_encode().indices
        part = indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        codes = np.unique(codes * (int(part.max(initial=0)) + 1) + part, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(codes, kind="stable")
    starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
    for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(order)]):
        rows = table.take(pa.array(order[start:end]))
        yield tuple(rows.column(k)[0].as_py() for k in keys), rows


def _folded(aggregate: WindowAggregate, keys: Sequence[str]):
    """First phase: rows of a task to packed states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, Any] = {}
        types: list[pa.DataType] = []

        def passed_on() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*states), types)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([aggregate.pack(s) for s in states.values()], pa.binary())], [*keys, "state"])

        for batch in batches:
            types = [batch.schema.field(k).type for k in keys]
            for key, rows in _groups(pa.Table.from_batches([batch]), keys):
                states[key] = aggregate.update(states[key] if key in states else aggregate.empty(), rows)
            if len(states) > STATES:
                yield passed_on()
                states.clear()
        if states:
            yield passed_on()

    return run


def _merged(aggregate: WindowAggregate, keys: Sequence[str], names: Sequence[str], types: Sequence[pa.DataType]):
    """Second phase: states sorted by key to results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done, key_types = None, None, [], []

        def results() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), [*key_types, *types])], [*keys, *names])

        for batch in batches:
            key_types = [batch.schema.field(k).type for k in keys]
            for *key, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if key != now:
                    if now is not None:
                        done.append((*now, *aggregate.finish(state)))
                    now, state = key, aggregate.unpack(packed)
                else:
                    state = aggregate.merge(state, aggregate.unpack(packed))
            if len(done) >= 1000:
                yield results()
                done = []
        if now is not None:
            done.append((*now, *aggregate.finish(state)))
            yield results()

    return run


def aggregate_by_key(df: DataFrame, keys: Sequence[str], aggregate: WindowAggregate) -> DataFrame:
    """(keys..., result columns) of a user's aggregate."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = df.sparkSession
    rows = df.select(*[F.col(f"`{k}`") for k in keys], *[F.col(f"`{c}`") for c in aggregate.columns])
    key_ddl = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    schema = spark.createDataFrame([], aggregate.result).schema
    states = rows.mapInArrow(_folded(aggregate, list(keys)), f"{key_ddl}, state binary")
    placed = states.repartition(*[F.col(f"`{k}`") for k in keys]).sortWithinPartitions(*[F.col(f"`{k}`") for k in keys])
    return placed.mapInArrow(_merged(aggregate, list(keys), schema.names, list(to_arrow_schema(schema).types)), f"{key_ddl}, {aggregate.result}")


def window_aggregate(
    df: DataFrame, ts: str, width: str | int | float, aggregate: WindowAggregate, series: Sequence[str] = (), origin: Origin = "epoch",
    fills: dict[str, float] | None = None,
) -> DataFrame:
    """A user's aggregate per (series, window), empty windows included; usable in place of the built-in window functions."""
    span = stored_span(df, ts, series, origin)
    windowed = assign_windows(df, ts, width, series, origin, span)
    found = aggregate_by_key(windowed, [*series, "win_us"], aggregate)
    return fill_gaps(window_grid(df, ts, width, series, origin, span), found, series, fills or {})


class SmallestHashes:
    """Number of different values, estimated from the ``k`` smallest of their hashes; exact below ``k`` of them.

    ``column`` holds hashes as whole numbers in [0, ``span``).
    """

    def __init__(self, column: str, k: int = 256, span: float = 2.0 ** 52, name: str = "n_distinct"):
        self.columns, self.k, self.span = [column], k, span
        self.result = f"{name} double"

    def empty(self) -> np.ndarray:
        return np.empty(0, np.int64)

    def update(self, state: np.ndarray, rows: pa.Table) -> np.ndarray:
        values = rows.column(self.columns[0]).drop_null().to_numpy()
        return self.merge(state, values.astype(np.int64))

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.union1d(a, b)[: self.k]

    def finish(self, state: np.ndarray) -> tuple:
        return (float(len(state)) if len(state) < self.k else (self.k - 1) * self.span / float(state[-1] + 1),)

    def pack(self, state: np.ndarray) -> bytes:
        return state.tobytes()

    def unpack(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, np.int64)
