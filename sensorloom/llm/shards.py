"""Operator 3, sharding through a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size: a start and a
step, both from a hash of its name. The shards take turns, each claiming the first free slot of its
order, until the table is full. A key's hash picks a slot, the slot names the shard. The table has a
fixed size that does not depend on the data, so it travels with the plan as one array and a lookup
is one element access; adding or losing a shard moves few keys.

Defined cases: a null key is placed as the empty string; equal keys share a shard; other columns of
the input are not touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

TABLE_SIZE = 6421  # prime, about 100 slots for each of 64 shards
MAX_TABLE = 1_000_003


def hash_of(text: str) -> int:
    """60 bits of MD5: the same number in Python, Spark and SQL."""
    return int(hashlib.md5(text.encode("utf-8")).hexdigest()[:15], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: Sequence[str], size: int = TABLE_SIZE, turns: Sequence[int] | None = None) -> list[int]:
    """Index of the shard that owns each slot. ``turns`` lets a shard claim several slots a round."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names")
    if not is_prime(size) or not len(shards) <= size <= MAX_TABLE:
        raise ValueError(f"the table size must be a prime between the number of shards and {MAX_TABLE}")
    turns = list(turns or [1] * len(shards))
    if len(turns) != len(shards) or min(turns) < 0 or max(turns) < 1:
        raise ValueError("turns: one number for each shard, none negative, one positive at least")
    order = [(hash_of(f"{s}:start") % size, hash_of(f"{s}:step") % (size - 1) + 1) for s in shards]
    owner, nth, left = [-1] * size, [0] * len(shards), size
    while True:
        for i, (start, step) in enumerate(order):
            for _ in range(turns[i]):
                while owner[slot := (start + nth[i] * step) % size] >= 0:
                    nth[i] += 1
                owner[slot] = i
                left -= 1
                if not left:
                    return owner


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(size).cast("long"))


def assign_shards(df: DataFrame, key: str | Column, shards: Sequence[str], size: int = TABLE_SIZE,
                  turns: Sequence[int] | None = None, slot_column: str = "slot", shard_column: str = "shard") -> DataFrame:
    """The rows with their slot and the shard's name."""
    owners = fill_table(shards, size, turns)
    key = F.col(f"`{key}`") if isinstance(key, str) else key
    names = F.array(*[F.lit(s) for s in shards])
    table = F.expr("array(" + ",".join(map(str, owners)) + ")")
    slot = slot_of(key, size)
    return df.withColumn(slot_column, slot).withColumn(
        shard_column, F.element_at(names, F.element_at(table, F.col(f"`{slot_column}`").cast("int") + 1) + 1))


def shard_sql(shards: Sequence[str], size: int, table: str, key: str) -> str:
    """The same placement in SQL: one claim per step of a recursion, then a lookup."""
    number = "('0x' || substr(md5({}), 1, 15))::BIGINT"
    n = len(shards)
    starts = ", ".join(f"{number.format(repr(s + ':start'))} % {size}" for s in shards)
    steps = ", ".join(f"{number.format(repr(s + ':step'))} % {size - 1} + 1" for s in shards)
    names = ", ".join(map(repr, shards))
    return f"""
WITH RECURSIVE preference AS MATERIALIZED (SELECT [{starts}] AS starts, [{steps}] AS steps),
claim AS (
    SELECT 0 AS turn, list_transform(range({size}), lambda x: -1) AS owner, list_transform(range({n}), lambda x: 0::BIGINT) AS nth, 0::BIGINT AS slot
    UNION ALL
    SELECT turn + 1, list_concat(list_concat(owner[:found], [turn % {n}]), owner[found + 2:]),
        list_concat(list_concat(nth[:turn % {n}], [j + 1]), nth[turn % {n} + 2:]), found
    FROM (
        SELECT *, (starts[turn % {n} + 1] + j * steps[turn % {n} + 1]) % {size} AS found FROM (
            SELECT claim.*, starts, steps, list_filter(range(nth[turn % {n} + 1], {size}),
                lambda j: owner[(starts[turn % {n} + 1] + j * steps[turn % {n} + 1]) % {size} + 1] < 0)[1] AS j
            FROM claim, preference WHERE turn < {size}))
),
filled AS MATERIALIZED (SELECT owner FROM claim WHERE turn = {size})
SELECT {key}, slot, [{names}][(SELECT owner FROM filled)[slot + 1] + 1] AS shard
FROM (SELECT {key}, {number.format(f"coalesce({key}::VARCHAR, '')")} % {size} AS slot FROM {table})"""
