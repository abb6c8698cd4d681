"""Timestamp resolution, coercion and epoch-unit detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sensorloom.operators.lookup import join_lookup

# Accepted timestamp columns, the first one present is used.
TIMESTAMP_COLUMNS = ("timestamp", "time", "Time")


def timestamp_column(columns: Sequence[str]) -> str:
    """The first present of the accepted names; a choice per table, not per row."""
    for name in TIMESTAMP_COLUMNS:
        if name in columns:
            return name
    raise ValueError(f"no timestamp column among {list(columns)}")


def coerce_timestamps(df: DataFrame) -> DataFrame:
    """Adds ``raw_ts`` DOUBLE and drops the source columns; non-numeric text becomes null."""
    chosen = timestamp_column(df.columns)
    parsed = F.expr(f"try_cast(`{chosen}` as double)")
    parsed = F.when(F.isnan(parsed), F.lit(None).cast("double")).otherwise(parsed)
    return df.withColumn("raw_ts", parsed).drop(*[c for c in TIMESTAMP_COLUMNS if c in df.columns])


def normalise_timestamps(df: DataFrame, file_cols: Sequence[str], now_epoch: float | Column) -> DataFrame:
    """Replaces the raw timestamp by ``ts`` TIMESTAMP.

    A file whose largest value lies after ``now_epoch`` counts in milliseconds and is
    floored to whole seconds; otherwise the values are seconds. The unit is a property
    of the file, so the maxima (one row per file) are joined back.
    """
    coerced = coerce_timestamps(df)
    now = F.lit(float(now_epoch)) if not isinstance(now_epoch, Column) else now_epoch
    kept = coerced.filter(F.col("raw_ts").isNotNull())
    units = kept.groupBy(*file_cols).agg((F.max("raw_ts") > now).alias("_is_ms"))
    seconds = F.when(F.col("_is_ms"), F.floor(F.col("raw_ts") / 1000).cast("double")).otherwise(F.col("raw_ts"))
    return (
        join_lookup(kept, units, file_cols)
        .withColumn("ts", F.timestamp_micros(F.round(seconds * 1_000_000).cast("long")))
        .drop("raw_ts", "_is_ms")
    )


def rejected_timestamps(df: DataFrame, file_cols: Sequence[str]) -> DataFrame:
    """Rows dropped for an unreadable timestamp, counted per file."""
    coerced = coerce_timestamps(df)
    return coerced.groupBy(*file_cols).agg(
        F.count_if(F.col("raw_ts").isNull()).alias("n_rejected"), F.count("*").alias("n_rows")
    )
