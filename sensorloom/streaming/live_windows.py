"""The window mean and the high-entropy count as streaming aggregations.

The batch operators anchor windows at an origin; here a fixed origin becomes the start
offset of the built-in window. A window is emitted once the watermark has passed its end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from sensorloom.functions.timeparts import instant_micros, width_micros
from sensorloom.operators.entropy import HIGH_ENTROPY


def _window(ts: str, width: str, origin: str | int | float):
    width_us = width_micros(width)
    offset = 0 if origin == "epoch" else instant_micros(origin) % width_us
    return F.window(F.col(ts), f"{width_us} microseconds", startTime=f"{offset} microseconds").alias("w")


def live_window_mean(
    stream: DataFrame, ts: str, width: str, values: Sequence[str], series: Sequence[str], delay: str = "1 minute",
    origin: str | int | float = "epoch",
) -> DataFrame:
    grouped = stream.withWatermark(ts, delay).groupBy(_window(ts, width, origin), *series)
    return grouped.agg(*[F.avg(v).alias(v) for v in values]).select(F.col("w.start").alias("win_start"), *series, *values)


def live_high_entropy_files(
    stream: DataFrame, ts: str, width: str, series: Sequence[str], delay: str = "1 minute",
    path: str = "file_path", entropy: str = "entropy", threshold: float = HIGH_ENTROPY,
    origin: str | int | float = "epoch",
) -> DataFrame:
    """Distinct files at or above the limit, approximate: exact distinct counts need unbounded state."""
    grouped = stream.withWatermark(ts, delay).groupBy(_window(ts, width, origin), *series)
    hits = F.approx_count_distinct(F.when(F.col(entropy) >= threshold, F.col(path)), 0.01)
    return grouped.agg(hits.alias("entropy_file_count")).select(F.col("w.start").alias("win_start"), *series, "entropy_file_count")
