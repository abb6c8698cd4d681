"""File-entropy window features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sensorloom.operators.buckets import Origin, assign_windows, stored_span, window_agg, window_grid
from sensorloom.operators.text import tfidf_from_counts

# Entropy limits of the two features.
HIGH_ENTROPY = 6.0
FILETYPE_ENTROPY = 5.0
NO_FILETYPE = "no_filetype"


def file_type(path: Column) -> Column:
    """Extension of the last path part; a name that only starts with a dot has none."""
    base = F.regexp_extract(path, r"([^/]*)/*$", 1)
    suffix = F.regexp_extract(base, r"[^.]\.([^.]+)$", 1)
    return F.when(suffix == "", F.lit(NO_FILETYPE)).otherwise(suffix)


def high_entropy_files(
    df: DataFrame,
    ts: str,
    width: str | int | float = "10s",
    series: Sequence[str] = (),
    origin: Origin = "epoch",
    path: str = "file_path",
    entropy: str = "entropy",
    threshold: float = HIGH_ENTROPY,
) -> DataFrame:
    """Distinct files at or above the entropy limit per window.

    The limit sits inside the aggregate, so windows without a hit survive with 0.
    """
    hits = F.countDistinct(F.when(F.col(entropy) >= threshold, F.col(path))).alias("entropy_file_count")
    return window_agg(df, ts, width, [hits], series, origin, {"entropy_file_count": 0})


def filetype_profile(
    df: DataFrame,
    ts: str,
    width: str | int | float = "10s",
    label: str = "label",
    origin: Origin = "start_day",
    path: str = "file_path",
    entropy: str = "entropy",
    threshold: float = FILETYPE_ENTROPY,
    kind: Column | None = None,
) -> DataFrame:
    """TF-IDF of file types per (label, window), long form.

    Every window between a label's first and last row is a document, also an empty one;
    that is the document count of the IDF.
    """
    span = stored_span(df, ts, [label], origin)
    windowed = assign_windows(df, ts, width, [label], origin, span)
    kind = file_type(F.col(path)) if kind is None else kind
    counts = (
        windowed.filter(F.col(entropy) >= threshold)
        .groupBy(label, "win_us", kind.alias("term"))
        .agg(F.count("*").alias("n"))
    )
    documents = window_grid(df, ts, width, [label], origin, span)
    return tfidf_from_counts(counts, [label, "win_us"], documents.agg(F.count("*")).scalar())


def filetype_totals(profile: DataFrame, k: int = 10) -> DataFrame:
    """File types by total weight, the k largest."""
    return profile.groupBy("term").agg(F.sum("tfidf").alias("total")).orderBy(F.desc("total"), "term").limit(k)
