"""Putting the sources side by side on the window start."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from sensorloom.operators.cleaning import quoted, suffix_shared_columns


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keeps the first row of every key in the given order.

    A min_by combines map-side, so a key with very many rows never meets in one task unreduced.
    """
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*[quoted(c) for c in rest]), F.struct(*[quoted(c) for c in order])).alias("_row")
    return df.groupBy(*keys).agg(first).select(
        *keys, *[F.col("_row").getField(c).alias(c) for c in rest]
    )


def fuse(frames: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """N-way full outer join on the window keys (J1); shared columns get the source as suffix.

    All inputs are hash-partitioned on the same keys, so each side is shuffled once and the
    running result keeps its partitioning.
    """
    renamed = suffix_shared_columns(frames, keys)
    return reduce(lambda left, right: left.join(right, list(keys), "full"), renamed.values())


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all inputs by column name; missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def label_side(frames: Mapping[str, DataFrame], keys: Sequence[str], label: str = "label") -> DataFrame:
    """(keys, label) rows of every source, one per source and window, before any renaming."""
    return union_sources([f.select(*keys, label) for f in frames.values()])


def attach_labels(fused: DataFrame, labels: DataFrame, keys: Sequence[str], fanout: bool = False) -> DataFrame:
    """Full outer join with the label rows.

    By default a window keeps one row per distinct label; ``fanout`` repeats it once per
    label row, as a join with the raw label rows does.
    """
    side = labels if fanout else labels.distinct()
    return fused.join(side, list(keys), "full")


def attach_calls(fused: DataFrame, calls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join with window means of encoded system calls."""
    return fused.join(calls, list(keys), "full")
