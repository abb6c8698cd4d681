"""Exact linear-interpolation quantiles of whole columns.

The built-in exact percentile keeps one value->count map per group in one task. Here a
sketch first brackets every wanted rank; then all rows are combined to (values inside a
bracket, one row per zone between brackets), and running counts over that short table
give the exact order statistics. Should a rank lie outside its bracket, the column's ranks are
selected round by round instead (``ranks``).

The short table grows with the data, so no task counts through all of it: a bracket is cut into
``CELLS`` equal stretches of values, running counts inside a cell start from the sum of the cells
before it, and the table of cells has a fixed number of rows per key.

The bracket of a value is found once, by a search among the sorted ends, and all else follows from its two
ends. This keeps the generated method below the size beyond which the JVM interprets it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from sensorloom.operators.lookup import join_lookup
from sensorloom.operators.ranks import group_quantiles
from sensorloom.session import materialise

SKETCH_ACCURACY = 10_000
CELLS = 256


def bracketed(rows: DataFrame, keys: Sequence[str], probs: Sequence[float], accuracy: int) -> DataFrame:
    """(keys, b, n): the ends of all brackets in ascending order, two for each probability, and the number of values.

    Brackets do not overlap: one begins where the one before it ends, if the sketch has it begin earlier.
    """
    margin, m = 2.0 / accuracy, len(probs)
    ends = [max(0.0, p - margin) for p in probs] + [min(1.0, p + margin) for p in probs]
    sketch = f"percentile_approx(x, array({', '.join(f'{e!r}D' for e in ends)}), {accuracy})"
    sketched = rows.groupBy(*keys).agg(F.expr(sketch).alias("e"), F.expr("count(*)").alias("n"))
    order = sorted(range(m), key=lambda i: probs[i])
    low = [f"e[{i}]" if k == 0 else f"greatest(e[{i}], e[{m + order[k - 1]}])" for k, i in enumerate(order)]
    pairs = ", ".join(f"{lo}, greatest({lo}, e[{m + i}])" for lo, i in zip(low, order))
    return sketched.select(*keys, F.expr(f"array({pairs})").alias("b"), "n")


def join_brackets(rows: DataFrame, brackets: DataFrame, keys: Sequence[str]) -> DataFrame:
    if keys:
        return join_lookup(rows, brackets, keys)
    whole = brackets.select(F.struct("b", "n")).scalar()
    return rows.withColumn("_s", whole).select("*", F.expr("_s.b AS b"), F.expr("_s.n AS n")).drop("_s")


def _search(low: int, high: int) -> str:
    """How many of the ends ``b[low]`` .. ``b[high - 1]`` lie before x; a bracket holds both of its ends."""
    if low == high:
        return str(low)
    middle = (low + high) // 2
    beyond = ">=" if middle % 2 == 0 else ">"
    return f"IF(x {beyond} b[{middle}], {_search(middle + 1, high)}, {_search(low, middle)})"


def _ranked(
    long: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], accuracy: int, by: Sequence[str] = ()
) -> DataFrame:
    """Short table (keys, by, v, mn, mx, c, n, start, upto): rows in value order with their rank range.

    ``v`` is set for a value inside a bracket; other rows stand for a whole zone between two
    brackets and for its smallest and largest value only. Zones and cells are disjoint stretches of
    values: a value counts for the first bracket that holds it, and brackets do not overtake each
    other. Zones are numbered from -1 downwards, cells from 0 upwards.
    """
    rows = long.select(*keys, *by, F.col(value).cast("double").alias("x")).filter("x IS NOT NULL AND NOT isnan(x)")
    tagged = join_brackets(rows, bracketed(rows, keys, probs, accuracy), keys)
    place = tagged.select(*keys, *by, "n", "x", "b", F.expr(_search(0, 2 * len(probs))).alias("place"))
    # An odd place is inside a bracket, an even one in the zone before the next.
    cell = f"coalesce(CAST(least(floor(try_divide(x - b[place - 1], b[place] - b[place - 1]) * {CELLS}), {CELLS - 1}) AS INT), 0)"
    located = place.select(
        *keys, *by, "n", "x", F.expr("IF(place % 2 = 1, x, NULL) AS v"),
        F.expr(f"IF(place % 2 = 1, (place div 2) * {CELLS} + {cell}, -1 - place div 2) AS cell"))
    short = materialise(
        located.groupBy(*keys, *by, "v", "cell")
        .agg(F.expr("count(*) AS c"), F.expr("min(x) AS mn"), F.expr("max(x) AS mx"), F.expr("max(n) AS n")))
    part = ", ".join(f"`{k}`" for k in keys) or "0"
    cells = short.groupBy(*keys, "cell").agg(F.expr("min(mn) AS low"), F.expr("sum(c) AS in_cell"))
    before = F.expr(f"coalesce(sum(in_cell) OVER (PARTITION BY {part} ORDER BY low ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before")
    rows = join_lookup(short, cells.select(*keys, "cell", before), [*keys, "cell"])
    if not by:
        upto = F.expr(f"before + sum(c) OVER (PARTITION BY {part}, cell ORDER BY mn)")
        return rows.withColumn("upto", upto).withColumn("start", F.expr("upto - c")).drop("before", "cell")
    # Rows of one zone overlap across ``by``; only the zone as a whole has a rank range.
    whole = f"OVER (PARTITION BY {part}, cell, v)"
    zoned = rows.select(
        *keys, *by, "v", "cell", "c", "n", "before", F.expr(f"sum(c) {whole} AS zc"), F.expr(f"min(mn) {whole} AS mn"), F.expr(f"max(mx) {whole} AS mx")
    )
    upto = F.expr(f"before + sum(c) OVER (PARTITION BY {part}, cell ORDER BY mn RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    return zoned.withColumn("upto", upto).withColumn("start", F.expr("upto - zc")).drop("before", "cell")


def _edge(p: float) -> str:
    """Interpolated quantile: the order statistics at the two neighbouring ranks.

    A zone row stands for many values, only its two ends are known; null if a rank is none of them.
    """
    position = f"((n - 1) * {float(p)!r}D)"

    def at(rank: str) -> str:
        return (
            f"max(CASE WHEN {rank} < start OR {rank} >= upto THEN NULL WHEN v IS NOT NULL THEN v WHEN {rank} = start THEN mn "
            f"WHEN {rank} = upto - 1 THEN mx END)"
        )

    low = f"floor({position})"
    share = f"max({position} - {low})"
    lo, hi = at(low), at(f"least({low} + 1, n - 1)")
    return f"({lo} + ({hi} - {lo}) * {share})"


def _edges(long: DataFrame, ranked: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Stored (keys..., n, q0, q1, ...); keys with a rank outside its bracket go through rank selection."""
    edges = materialise(ranked.groupBy(*keys).agg(F.expr("max(n) AS n"), *[F.expr(f"{_edge(p)} AS q{i}") for i, p in enumerate(probs)]))
    names = [f"q{i}" for i in range(len(probs))]
    missed = F.expr(" OR ".join(f"{q} IS NULL" for q in names))
    again = edges.filter(missed & (F.col("n") > 0))
    if again.isEmpty():
        return edges
    rows = join_lookup(long, again.select(*keys), keys) if keys else long
    held = materialise(rows.select(F.lit(0).alias("_all"), *keys, value))
    exact = group_quantiles(held, ["_all", *keys], value, probs)
    sizes = edges.select(*keys, "n")
    mended = exact.drop("_all").join(sizes, list(keys)) if keys else exact.drop("_all").crossJoin(sizes)
    return materialise(edges.filter(~missed).unionByName(mended.select(*edges.columns)))


def exact_quantiles(
    long: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], accuracy: int = SKETCH_ACCURACY
) -> DataFrame:
    """(keys..., n, q0, q1, ...): one column per probability, nulls and NaN ignored."""
    return _edges(long, _ranked(long, keys, value, probs, accuracy), keys, value, probs)


def quantile_bin_counts(
    long: DataFrame, keys: Sequence[str], value: str, by: Sequence[str], bins: int, accuracy: int = SKETCH_ACCURACY
) -> DataFrame:
    """(keys..., by..., bin, n): rows per quantile bin, bin = number of inner edges below the value.

    All rows of a zone lie between the same two edges, so the short table already holds the
    counts and the data is not read again for them. The edges are one row per key.
    """
    probs = [i / bins for i in range(1, bins)]
    ranked = materialise(_ranked(long, keys, value, probs, accuracy, by))
    edges = _edges(long, ranked, keys, value, probs)
    listed = edges.select(*keys, F.array(*[f"q{i}" for i in range(len(probs))]).alias("edges"))
    with_edges = join_lookup(ranked, listed, keys)
    index = " + ".join(f"IF(mn > edges[{i}], 1, 0)" for i in range(len(probs)))
    return with_edges.groupBy(*keys, *by, F.expr(f"{index} AS bin")).agg(F.expr("sum(c) AS n"))


def melt(df: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(ids..., feature, x) in double; the shared narrow form of all per-feature statistics.

    Null and NaN both mean "no value" and give no row.
    """
    narrow = df.unpivot(list(ids), [F.col(f"`{f}`").cast("double").alias(f) for f in features], "feature", "x")
    return narrow.filter("x IS NOT NULL AND NOT isnan(x)")


def feature_quantiles(df: DataFrame, features: Sequence[str], probs: Sequence[float], ids: Sequence[str] = ()) -> DataFrame:
    return exact_quantiles(melt(df, ids, features), [*ids, "feature"], "x", probs)
