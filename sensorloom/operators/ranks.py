"""Exact quantiles of many groups at once by rank selection.

Rows are (keys, value, weight). A group of few values is sorted by a window. A crowded group (one window
may hold a third of all packets) never meets in a task: its values are counted in ``CELLS`` stretches between
the smallest and the largest one, the stretch that holds the wanted rank becomes the next bracket, and
so on until few values are left; these are sorted. All crowded groups and ranks go through a round together,
and a round is one aggregation with map-side combining. Brackets are real values with exact counts before them, so
a rank cannot fall outside.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from sensorloom.operators.lookup import join_lookup
from sensorloom.session import materialise

FEW = 4096  # different values that one task sorts
CELLS = 1024


def _order(keys: Sequence[str], tail: str = "") -> str:
    return f"OVER (PARTITION BY {', '.join(f'`{k}`' for k in keys)} {tail})"


def _positions(probs: Sequence[float]) -> str:
    """Array of (probability number, rank) of the order statistics that the probabilities lie between."""
    parts = []
    for i, p in enumerate(probs):
        place = f"((total - 1) * {float(p)!r}D)"
        parts += [f"named_struct('q', {2 * i}, 'rank', CAST(floor({place}) AS LONG))",
                  f"named_struct('q', {2 * i + 1}, 'rank', CAST(least(floor({place}) + 1, total - 1) AS LONG))"]
    return f"array({', '.join(parts)})"


def _at_rank(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, q, x, total): the value at ``rank`` among rows (keys, q, rank, before, x, w, total) of few values per (keys, q)."""
    upto = f"before + sum(w) {_order([*keys, 'q'], 'ORDER BY x')}"
    return rows.withColumn("_upto", F.expr(upto)).filter("rank < _upto AND rank >= _upto - w").select(*keys, "q", "x", "total")


def _refined(rows: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One round: the stretch of each bracket that holds its rank."""
    inside = join_lookup(rows, state, keys, stored=True).filter("x >= lo AND x <= hi")
    share = "(x / 2 - lo / 2) / (hi / 2 - lo / 2)"
    # An infinite end gives no share; such values wait in the middle for ends that are finite.
    cell = f"CASE WHEN x = lo THEN 0 WHEN x = hi THEN {CELLS - 1} WHEN isnan({share}) THEN {CELLS // 2} ELSE CAST(least({share} * {CELLS}, {CELLS - 1}) AS INT) END"
    counted = inside.withColumn("cell", F.expr(cell)).groupBy(*keys, "q", "rank", "before", "total", "cell").agg(
        F.sum("w").alias("w"), F.count(F.lit(1)).alias("left"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    upto = f"before + sum(w) {_order([*keys, 'q'], 'ORDER BY cell')}"
    return materialise(counted.withColumn("_upto", F.expr(upto)).filter("rank < _upto AND rank >= _upto - w").select(
        *keys, "q", "rank", F.expr("_upto - w AS before"), "total", "lo", "hi", "left"))


def group_quantiles(
    rows: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], weight: str | None = None, combined: bool = False,
) -> DataFrame:
    """(keys..., q0, q1, ...): linear-interpolation quantiles per group; nulls and NaN are ignored.

    ``weight`` is how often a value counts. A group without a value has no row. Equal values of a group may stand in several
    rows, unless ``combined`` says that ``rows`` is a stored table with one row for each of them.
    """
    known = rows.select(*keys, F.col(value).cast("double").alias("x"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("w")).filter(
        "x IS NOT NULL AND NOT isnan(x) AND w > 0")
    if not combined:
        known = materialise(known.groupBy(*keys, "x").agg(F.sum("w").alias("w")))
    sizes = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("left"), F.sum("w").alias("total"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    crowded = materialise(sizes.filter(f"left > {FEW}"))
    positions = F.expr(f"inline({_positions(probs)})")
    if crowded.isEmpty():
        few, parts = known, []
    else:
        marks = crowded.select(*keys, F.lit(True).alias("_crowded"))
        marked = join_lookup(known, marks, keys, how="left")
        few = marked.filter("_crowded IS NULL").drop("_crowded")
        many = materialise(marked.filter("_crowded").drop("_crowded"))
        state = materialise(crowded.select(*keys, "lo", "hi", "left", "total", F.lit(0).cast("long").alias("before"), positions))
        while not state.filter(f"left > {FEW} AND lo < hi").isEmpty():
            state = _refined(many, state, keys)
        left = join_lookup(many, state, keys, stored=True).filter("x >= lo AND x <= hi")
        parts = [_at_rank(left, keys)]
    sized = few.withColumn("total", F.expr(f"sum(w) {_order(keys)}"))
    parts.append(_at_rank(sized.select(*keys, "x", "w", "total", F.lit(0).cast("long").alias("before"), positions), keys))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    at = [F.expr(f"max(IF(q = {q}, x, NULL)) AS _x{q}") for q in range(2 * len(probs))]
    return found.groupBy(*keys).agg(F.max("total").alias("total"), *at).select(*keys, *[F.expr(_between(i, p)).alias(f"q{i}") for i, p in enumerate(probs)])


def _between(i: int, p: float) -> str:
    low, high, place = f"_x{2 * i}", f"_x{2 * i + 1}", f"((total - 1) * {float(p)!r}D)"
    share = f"({place} - floor({place}))"
    return f"IF({low} = {high} OR {share} = 0, {low}, {low} + ({high} - {low}) * {share})"
