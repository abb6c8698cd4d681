"""Joining all rows with a small table of per-key values (origins, units, brackets, catalog attributes).

The planner cannot know that such a table is small: its size estimate follows the data it was
aggregated from, and a shuffle join would bring all rows of a key (a series, a feature, a file)
into one task. The table is therefore stored and measured. Up to ``BROADCAST_BYTES`` it is broadcast,
beyond that both sides are shuffled and the keys of many rows are salted, a table of terms (which grows
with the corpus) by document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sensorloom.session import materialise

BROADCAST_BYTES = 16 << 20
SALTS = 64
TERM_SALTS = 16
HEAVY_ROWS = 1 << 18  # a key of so many rows is salted


def text_bytes(table: DataFrame) -> int:
    """Size of all rows as text, arrays included: an upper bound of what a broadcast holds, but for object headers."""
    return table.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0


def join_lookup(rows: DataFrame, table: DataFrame, keys: Sequence[str], stored: bool = False, how: str = "inner") -> DataFrame:
    """Join on the keys ("inner" or "left"); ``stored`` says that the table is already a written one."""
    small = table if stored else materialise(table)
    if text_bytes(small) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(small), list(keys), how)
    return salted_join(rows, small, keys, F.monotonically_increasing_id(), SALTS, how)


def join_terms(
    rows: DataFrame, terms: DataFrame, keys: Sequence[str], spread: Column, how: str = "inner", stored: bool = False,
    heavy: DataFrame | None = None,
) -> DataFrame:
    """Join with a table that has one row per term: measured, then broadcast, or salted by ``spread``."""
    table = terms if stored else materialise(terms)
    if text_bytes(table) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table), list(keys), how)
    return salted_join(rows, table, keys, spread, how=how, heavy=heavy)


def salted_join(
    rows: DataFrame, table: DataFrame, keys: Sequence[str], spread: Column, salts: int = TERM_SALTS, how: str = "inner",
    heavy: DataFrame | None = None,
) -> DataFrame:
    """Join in which the rows of a heavy key go to up to ``salts`` tasks, by ``spread``; each gets a copy of the key's entry.

    Heavy are the keys of at least ``HEAVY_ROWS`` rows, so there are few of them; ``heavy`` names them where they are
    known, else the rows are counted. All other keys keep one entry. The hint keeps the planner from broadcasting the
    table, which it takes for as small as its files, copies and decompression left out.
    """
    if heavy is None:
        heavy = rows.groupBy(*keys).agg(F.count("*").alias("_rows")).filter(F.col("_rows") >= HEAVY_ROWS)
    named = materialise(heavy.select(*keys).distinct().withColumn("_salts", F.lit(salts).cast("long")))
    many = F.broadcast(named)
    copies = table.join(many, list(keys), "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_salts", F.lit(1).cast("long")) - 1))).drop("_salts")
    # The salt only spreads the rows: every copy of the table holds the same values. Rows without a key find nothing and are spread too.
    absent = " OR ".join(f"`{k}` IS NULL" for k in keys)
    salt = F.when(F.col("_salts").isNotNull() | F.expr(absent), F.pmod(spread, F.lit(salts).cast("long"))).otherwise(F.lit(0).cast("long"))
    placed = rows.join(many, list(keys), "left").withColumn("_salt", salt).drop("_salts")
    return placed.join(copies.hint("merge"), [*keys, "_salt"], how).drop("_salt")
