"""Column min-max scaling to [0, 1] (F1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sensorloom.operators.cleaning import drop_iqr_outliers, escaped, quoted
from sensorloom.operators.lookup import join_lookup


def unit_scaled(x: Column, lo: Column, hi: Column) -> Column:
    """(x - lo) / (hi - lo); 0 for a constant column; null and NaN give null."""
    scaled = F.try_divide(x - lo, hi - lo)
    return F.when(x.isNotNull() & ~F.isnan(x), F.coalesce(scaled, F.lit(0.0)))


def minmax_columns(
    df: DataFrame,
    columns: Sequence[str],
    drop_outliers: bool = False,
    fit_on: Column | None = None,
) -> DataFrame:
    """Scales ``columns`` and carries all others along on the same row. NaN counts as null.

    ``drop_outliers`` applies the whisker filter first. ``fit_on`` restricts the rows that
    set the limits (for example the training split).
    """
    rows = drop_iqr_outliers(df, columns) if drop_outliers else df
    fitted = rows if fit_on is None else rows.filter(fit_on)
    ends = []
    for i, c in enumerate(columns):
        x = f"nanvl(CAST({escaped(c)} AS DOUBLE), NULL)"
        ends += [f"min({x}) AS lo{i}", f"max({x}) AS hi{i}"]
    limits = fitted.agg(*[F.expr(e) for e in ends]).select(F.struct("*")).scalar()
    position = {c: i for i, c in enumerate(columns)}
    out = []
    for c in df.columns:
        q = escaped(c)
        if c in position:
            lo, hi = f"_limits.lo{position[c]}", f"_limits.hi{position[c]}"
            x = f"nanvl(CAST({q} AS DOUBLE), NULL)"
            scaled = f"coalesce(try_divide({x} - {lo}, {hi} - {lo}), 0D)"
            out.append(f"IF({x} IS NULL, NULL, {scaled}) AS {q}")
        else:
            out.append(q)
    return rows.withColumn("_limits", limits).selectExpr(*out)


def minmax_by_group(df: DataFrame, group: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Scaling inside every group; the limits are one row per group."""
    ends = []
    for i, c in enumerate(columns):
        x = F.nanvl(quoted(c).cast("double"), F.lit(None))
        ends += [F.min(x).alias(f"_lo{i}"), F.max(x).alias(f"_hi{i}")]
    limits = df.groupBy(*group).agg(*ends)
    position = {c: i for i, c in enumerate(columns)}
    joined = join_lookup(df, limits, group)
    return joined.select(
        *[
            unit_scaled(quoted(c).cast("double"), F.col(f"_lo{position[c]}"), F.col(f"_hi{position[c]}")).alias(c)
            if c in position
            else quoted(c)
            for c in df.columns
        ]
    )
