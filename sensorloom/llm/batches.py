"""Arrow plumbing of the text operators: bounded slices of texts in, columns out, and memory that workers keep between tasks."""

from __future__ import annotations

import ctypes
import itertools
import sys
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SLICE_BYTES = 1 << 20
BATCH_ROWS = 1000
ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_BYTES = 4 << 20
BYTES_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bytes_of(setting: str) -> int:
    """A size setting as a number; -1 if it is written with a unit."""
    digits = setting.lower().removesuffix("b")
    return int(digits) if digits.lstrip("-").isdigit() else -1


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's rows and bytes per Arrow batch: rows here are whole texts or vectors, and a batch exists several times."""
    if not 0 < int(spark.conf.get(ROWS_SETTING)) <= BATCH_ROWS:
        spark.conf.set(ROWS_SETTING, str(BATCH_ROWS))
    if not 0 < bytes_of(spark.conf.get(BYTES_SETTING, str(1 << 30))) <= BATCH_BYTES:
        spark.conf.set(BYTES_SETTING, str(BATCH_BYTES))


# What the operator of the last task keeps in this worker, and how to let go of it.
KEPT: dict[str, Callable[[], None]] = {}


def keep_only(owner: str, drop: Callable[[], None]) -> None:
    """Called by tasks that keep tables or caches for later tasks: those of other operators go.

    A worker serves many stages; without this it would hold the tables of all operators it has ever run.
    """
    others = [name for name in KEPT if name != owner]
    for name in others:
        KEPT.pop(name)()
    KEPT[owner] = drop
    if others:
        give_back()


def give_back() -> None:
    """Returns freed memory to the system, where the allocators can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def slices(texts: Sequence, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text, one row at least."""
    sizes = pc.binary_length(texts).to_pylist() if isinstance(texts, pa.Array) else [len(x) for x in texts]
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def map_texts(df: DataFrame, keep: Sequence[tuple[str, str | Column]], text: str | Column,
              compute: Callable[[list[bytes]], list], columns: str, binary: bool = False) -> DataFrame:
    """Kept columns (name, source) plus the columns that ``compute`` derives from each text.

    Only the kept columns and the text reach Python, under fixed names, so other columns of ``df``
    cannot clash. A null text is an empty one. ``compute`` gets the UTF-8 texts of a slice and
    returns one list or array per name of the DDL string ``columns``. ``binary``: the column holds bytes.
    """
    bound_batches(df.sparkSession)
    content = F.col(f"`{text}`") if isinstance(text, str) else text
    content = content if binary else F.encode(F.coalesce(content, F.lit("")), "UTF-8")
    source = df.select(
        *[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(n) for n, c in keep],
        content.alias("_text"),
    )
    names = [n for n, _ in keep]
    schema = ", ".join([*(f"`{n}` {source.schema[n].dataType.simpleString()}" for n in names), columns])
    made = [x.strip().split(" ")[0] for x in columns.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(names))
            for start, end in slices(texts):
                out = compute(texts.slice(start, end - start).to_pylist())
                kept = [batch.column(i).slice(start, end - start) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*kept, *(x if isinstance(x, pa.Array) else pa.array(x) for x in out)], [*names, *made])

    return source.mapInArrow(run, schema)


class BoundedCache(dict):
    """A cache of bounded size in bytes; when it is full, the older half of its entries goes.

    ``make(keys)`` computes many missing values at once; ``fill`` is called with a set of keys
    before they are looked up, and afterwards every one of them is present.
    """

    SLOT = 60  # bytes of a dictionary entry

    def __init__(self, make: Callable[[list], list], limit: int):
        super().__init__()
        self.make, self.limit, self.held = make, limit, 0

    def fill(self, keys: set) -> None:
        missing = keys.difference(self)
        if not missing:
            return
        if self.held > self.limit:
            kept = dict(itertools.islice(self.items(), len(self) // 2, None))
            self.clear()
            self.update(kept)
            self.held //= 2
            missing = keys.difference(self)
        fresh = list(missing)
        values = self.make(fresh)
        self.held += sum(map(sys.getsizeof, fresh)) + sum(map(sys.getsizeof, values)) + self.SLOT * len(fresh)
        self.update(zip(fresh, values))
