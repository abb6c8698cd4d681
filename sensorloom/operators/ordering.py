"""Global order without a single-partition window: row index, contiguous shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sensorloom.operators.lookup import join_lookup
from sensorloom.session import materialise

_ROW_BITS = 33  # rows of a partition are numbered in the low 33 bits of a generated id


def with_row_index(df: DataFrame, order: Sequence[str], name: str = "row_index") -> DataFrame:
    """Adds the 0-based position in the total order of ``order`` (must identify a row).

    Range partitions are sorted independently; writing the rows fixes them with their partition,
    and the rows per partition (one row each) give the offsets.
    """
    placed = materialise(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_rid", F.monotonically_increasing_id())
    )
    part = F.shiftright("_rid", _ROW_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    # One row per partition: a window over all of them is small.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    local = F.col("_rid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1).cast("long"))
    indexed = join_lookup(placed.withColumn("_part", part), offsets, ["_part"])
    return indexed.withColumn(name, (F.col("_offset") + local).cast("long")).drop("_part", "_rid", "_offset")


def contiguous_shard(index: Column, n: Column, k: int) -> Column:
    """0-based shard of row ``index`` of ``n``: the first n mod k shards hold one row more."""
    small = F.floor(n / F.lit(k)).cast("long")
    large = n % F.lit(k)
    in_large = index < large * (small + 1)
    rest = large + F.floor((index - large * (small + 1)) / F.greatest(small, F.lit(1))).cast("long")
    return F.when(in_large, F.floor(index / (small + 1)).cast("long")).otherwise(rest).cast("int")


def contiguous_shards(df: DataFrame, order: Sequence[str], k: int, name: str = "shard") -> DataFrame:
    """Splits the ordered rows into k contiguous shards of nearly equal size."""
    indexed = with_row_index(df, order, "_index")
    total = indexed.agg(F.count("*")).scalar()
    return indexed.withColumn(name, contiguous_shard(F.col("_index"), total, k)).drop("_index")
