"""Splits and shard assignment for distributed learners."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from sensorloom.functions.numeric import hash_order, hash_unit
from sensorloom.operators.cleaning import quoted
from sensorloom.operators.lookup import join_lookup
from sensorloom.operators.ordering import contiguous_shard, with_row_index

HASH_BUCKETS = 10_000


def _key(columns: Sequence[str]):
    return F.concat_ws("-", *[quoted(c) for c in columns])


def hash_split(df: DataFrame, key: Sequence[str], train_share: float = 0.8, seed: int = 133) -> DataFrame:
    """Adds ``split`` train/test from a hash of the row key: stable under any partitioning (M1)."""
    limit = int(round(train_share * HASH_BUCKETS))
    return df.withColumn(
        "split", F.when(hash_unit(_key(key), seed, HASH_BUCKETS) < limit, "train").otherwise("test")
    )


def device_shards(df: DataFrame, device: str, k: int, seed: int) -> DataFrame:
    """Adds ``shard``: devices in seeded order, cut into k contiguous groups."""
    devices = df.select(quoted(device).alias(device)).distinct().withColumn("_h", hash_order(F.col(device), seed))
    indexed = with_row_index(devices, ["_h", device], "_index")
    total = indexed.agg(F.count("*")).scalar()
    table = indexed.select(device, contiguous_shard(F.col("_index"), total, k).alias("shard"))
    return join_lookup(df, table, [device])


def half_device_shards(df: DataFrame, device: str, key: Sequence[str], seed: int) -> DataFrame:
    """Adds ``shard``: every device halved by a row hash, halves numbered in seeded order (D3)."""
    halves = df.withColumn("half", (hash_unit(_key(key), seed, 2)).cast("int"))
    pairs = df.select(quoted(device).alias(device)).distinct().select(
        device, F.explode(F.array(F.lit(0), F.lit(1))).alias("half")
    )
    ordered = pairs.withColumn("_h", hash_order(F.concat_ws("/", F.col(device), F.col("half")), seed))
    table = with_row_index(ordered, ["_h", device, "half"], "shard").select(
        device, "half", F.col("shard").cast("int").alias("shard")
    )
    return join_lookup(halves, table, [device, "half"])


def dirichlet_shares(labels: Sequence, k: int, alpha: float, seed: int) -> dict:
    """label -> k shares drawn from a symmetric Dirichlet(alpha)."""
    rng = random.Random(seed)
    shares = {}
    for label in labels:
        draws = [rng.gammavariate(alpha, 1.0) for _ in range(k)]
        total = sum(draws) or 1.0
        shares[label] = [d / total for d in draws]
    return shares


def label_skewed_shards(
    df: DataFrame, label: str, key: Sequence[str], shares: dict, seed: int, name: str = "shard"
) -> DataFrame:
    """Adds ``shard`` by the row's hash position within its label's cumulative shares.

    The share matrix has labels x shards numbers and is part of the expression. A label without
    shares raises.
    """
    k = len(next(iter(shares.values())))
    position = hash_unit(_key(key), seed, 1_000_000).cast("double") / F.lit(1_000_000.0)
    message = F.concat(F.lit("label without shares: "), F.coalesce(quoted(label).cast("string"), F.lit("null")))
    assigned = F.raise_error(message).cast("int")
    for value, parts in shares.items():
        cut, chosen = 0.0, F.lit(0)
        for part in parts[: k - 1]:
            cut += part
            chosen = chosen + F.when(position >= F.lit(cut), 1).otherwise(0)
        assigned = F.when(quoted(label) == F.lit(value), chosen).otherwise(assigned)
    return df.withColumn(name, assigned)


def shard_label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per (shard, split, label)."""
    return df.groupBy("shard", "split", label).agg(F.count("*").alias("n_rows"))
