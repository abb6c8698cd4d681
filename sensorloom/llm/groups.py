"""Groups of sorted Arrow rows, read one after another inside a task."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def starts_of(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which the values of the key columns change; 0 is the first."""
    change = np.zeros(len(table), bool)
    change[:1] = True
    for name in keys:
        column = table.column(name).combine_chunks()
        values = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        change[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(change)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that hold only whole groups, with the row at which each group starts."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        starts = starts_of(table, keys)
        if len(starts) > 1:
            yield table.slice(0, starts[-1]).combine_chunks(), starts[:-1]
        held = table.slice(starts[-1])
    if held is not None:
        yield held.combine_chunks(), np.zeros(1, np.int64)


class Union:
    """Union-find over row numbers; the smallest row number of a group is its root."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.parent[max(i, j)] = min(i, j)
        return True
