"""Origin-anchored tumbling windows, gap filling and the plain window aggregates.

Every function takes ``series``: the columns that separate independent time lines. A
window row is keyed by (series, ``win_us``); ``win_us`` is the window start in
microseconds. Reshaping to TIMESTAMP happens in ``with_win_start`` at the edge.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from sensorloom.functions.timeparts import bucket_of, instant_micros, micros_of, timestamp_of, width_micros
from sensorloom.operators.lookup import join_lookup
from sensorloom.session import materialise

# Windows emitted per generated row of the grid; keeps every sequence array small.
GRID_CHUNK = 4096
DAY_US = 86_400_000_000

Origin = str | datetime | int | float


def series_span(df: DataFrame, ts: str, series: Sequence[str] = ()) -> DataFrame:
    """(series..., lo_us, hi_us): reads the time and series columns only, combines map-side."""
    us = micros_of(F.col(ts))
    return df.filter(F.col(ts).isNotNull()).groupBy(*series).agg(F.min(us).alias("lo_us"), F.max(us).alias("hi_us"))


def _fixed_origin(df: DataFrame, ts: str, origin: Origin, lo_us: Column | None) -> Column:
    if origin == "epoch":
        return F.lit(0).cast("long")
    if origin == "global":
        # One scalar for the whole input, evaluated as a subquery of the same plan.
        return df.agg(F.min(micros_of(F.col(ts)))).scalar()
    if origin == "start":
        return lo_us
    if origin == "start_day":
        return lo_us - F.pmod(lo_us, F.lit(DAY_US).cast("long"))
    return F.lit(instant_micros(origin)).cast("long")


def _per_series(origin: Origin) -> bool:
    return origin in ("start", "start_day")


def stored_span(df: DataFrame, ts: str, series: Sequence[str], origin: Origin) -> DataFrame | None:
    """The written span table when windows hang on each series' own start, else None.

    Callers that need windows and grid make it once and pass it to both.
    """
    return materialise(series_span(df, ts, series)) if _per_series(origin) else None


def anchored_span(df: DataFrame, ts: str, series: Sequence[str], origin: Origin) -> DataFrame:
    """Stored (series..., lo_us, hi_us, anchor): the instant from which a series counts its windows; one read of the times."""
    span = series_span(df, ts, series)
    if origin == "global":
        span = materialise(span)
        return span.withColumn("anchor", span.agg(F.min("lo_us")).scalar())
    return materialise(span.withColumn("anchor", _fixed_origin(df, ts, origin, F.col("lo_us"))))


def assign_windows(
    df: DataFrame, ts: str, width: str | int | float, series: Sequence[str] = (), origin: Origin = "epoch",
    span: DataFrame | None = None,
) -> DataFrame:
    """Adds ``ts_us`` and ``win_us``. Rows without a timestamp are dropped.

    origin: "epoch", "global" (first row of the input), "start" (first row of each
    series), "start_day" (midnight before it), or an explicit instant.
    """
    width_us = width_micros(width)
    rows = df.filter(F.col(ts).isNotNull()).withColumn("ts_us", micros_of(F.col(ts)))
    if not _per_series(origin):
        anchor = _fixed_origin(df, ts, origin, None)
        return rows.withColumn("win_us", bucket_of(F.col("ts_us"), anchor, width_us))
    span = (stored_span(df, ts, series, origin) if span is None else span).drop("hi_us")
    if series:
        rows = join_lookup(rows, span, series, stored=True)
        anchor = _fixed_origin(df, ts, origin, F.col("lo_us"))
        return rows.withColumn("win_us", bucket_of(F.col("ts_us"), anchor, width_us)).drop("lo_us")
    return rows.withColumn("win_us", bucket_of(F.col("ts_us"), _fixed_origin(df, ts, origin, span.scalar()), width_us))


def window_grid(
    df: DataFrame, ts: str, width: str | int | float, series: Sequence[str] = (), origin: Origin = "epoch",
    span: DataFrame | None = None,
) -> DataFrame:
    """Every window from the first to the last one of each series.

    Built in two steps (chunk starts, then the windows inside a chunk) so that a long
    series is spread over rows instead of one huge array.
    """
    width_us = width_micros(width)
    span = series_span(df, ts, series) if span is None else span
    anchor = _fixed_origin(df, ts, origin, F.col("lo_us"))
    bounds = span.filter(F.col("lo_us").isNotNull()).select(
        *series,
        bucket_of(F.col("lo_us"), anchor, width_us).alias("_first"),
        bucket_of(F.col("hi_us"), anchor, width_us).alias("_last"),
    )
    return sequence_rows(bounds, series, "win_us", width_us)


def sequence_rows(bounds: DataFrame, keep: Sequence[str], name: str, step: int = 1) -> DataFrame:
    """The numbers from ``_first`` to ``_last`` of every row, in chunks so that no array is long."""
    whole, one = F.lit(step * GRID_CHUNK).cast("long"), F.lit(step).cast("long")
    chunks = bounds.select(*keep, "_last", F.explode(F.sequence("_first", "_last", whole)).alias("_chunk"))
    return chunks.select(*keep, F.explode(F.sequence(F.col("_chunk"), F.least(F.col("_last"), F.col("_chunk") + whole - one), one)).alias(name))


def fill_gaps(grid: DataFrame, aggregated: DataFrame, series: Sequence[str], fills: Mapping[str, float]) -> DataFrame:
    """Left join on the grid; ``fills`` gives the value of an empty window per column (absent = null).

    Only windows without any row are filled: a null computed from rows stays null.
    """
    keys = [*series, "win_us"]
    marked = aggregated.withColumn("_hit", F.lit(True))
    joined = grid.join(marked, keys, "left")
    out = []
    for field in aggregated.schema.fields:
        name = f"`{field.name}`"
        if field.name in fills and field.name not in keys:
            out.append(f"IF(_hit, {name}, CAST({fills[field.name]} AS {field.dataType.simpleString()})) AS {name}")
        else:
            out.append(name)
    return joined.selectExpr(*out)


def with_win_start(df: DataFrame) -> DataFrame:
    """``win_us`` -> ``win_start`` TIMESTAMP in first place."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != "win_us"]
    return df.select(timestamp_of(F.col("win_us")).alias("win_start"), *rest)


def window_agg(
    df: DataFrame,
    ts: str,
    width: str | int | float,
    aggs: Sequence[Column],
    series: Sequence[str] = (),
    origin: Origin = "epoch",
    fills: Mapping[str, float] | None = None,
    keep_gaps: bool = True,
) -> DataFrame:
    """Any aggregates per (series, window), optionally with the empty windows."""
    span = stored_span(df, ts, series, origin)
    windowed = assign_windows(df, ts, width, series, origin, span)
    aggregated = windowed.groupBy(*series, "win_us").agg(*aggs)
    if not keep_gaps:
        return aggregated
    return fill_gaps(window_grid(df, ts, width, series, origin, span), aggregated, series, fills or {})


def window_mean(
    df: DataFrame,
    ts: str,
    width: str | int | float,
    values: Sequence[str],
    series: Sequence[str] = (),
    origin: Origin = "epoch",
) -> DataFrame:
    """Mean of every value column per window; empty windows are null rows (A1)."""
    return window_agg(df, ts, width, [F.avg(F.col(f"`{v}`")).alias(v) for v in values], series, origin)


def window_mean_long(
    df: DataFrame,
    ts: str,
    width: str | int | float,
    values: Sequence[str],
    series: Sequence[str] = (),
    origin: Origin = "epoch",
) -> DataFrame:
    """The same means in long form (series, win_us, feature, value).

    For sources with hundreds of counters: one aggregate expression instead of hundreds,
    so the generated code stays below the method limit. No gap rows.
    """
    windowed = assign_windows(df, ts, width, series, origin)
    long = windowed.unpivot(
        [*series, "win_us"], [F.col(f"`{v}`").cast("double").alias(v) for v in values], "feature", "x"
    )
    return long.groupBy(*series, "win_us", "feature").agg(F.avg("x").alias("value"))


def window_count(
    df: DataFrame,
    ts: str,
    width: str | int | float,
    series: Sequence[str] = (),
    origin: Origin = "epoch",
    cells_per_row: int = 1,
) -> DataFrame:
    """Rows per window, zero for empty ones (A8). ``cells_per_row`` counts cells instead."""
    n = (F.count("*") * F.lit(cells_per_row)).cast("long").alias("n_rows")
    return window_agg(df, ts, width, [n], series, origin, {"n_rows": 0})


def window_sum_with_first(
    df: DataFrame,
    ts: str,
    width: str | int | float,
    value: str,
    group: str,
    order: Sequence[str],
    series: Sequence[str] = (),
    origin: Origin = "epoch",
) -> DataFrame:
    """Sum of pre-counted vectors per window with the first group name."""
    first = F.min_by(F.col(group), F.struct(F.col("ts_us"), *[F.col(c) for c in order]))
    return window_agg(
        df, ts, width, [F.sum(value).alias("vector_count"), first.alias("first_group")], series, origin,
        {"vector_count": 0},
    )


def time_density(df: DataFrame, ts: str, width: str | int | float, group: str, origin: Origin = "epoch") -> DataFrame:
    """Rows per (group value, window): the table behind the density plots."""
    return window_agg(df, ts, width, [F.count("*").alias("n_rows")], [group], origin, keep_gaps=False)


def file_spans(df: DataFrame, ts: str, file_cols: Sequence[str]) -> DataFrame:
    """Min and max timestamp per file plus the global origin of all files."""
    spans = series_span(df, ts, file_cols)
    start = series_span(df, ts).select("lo_us").scalar()
    return spans.withColumn("origin_us", start)
