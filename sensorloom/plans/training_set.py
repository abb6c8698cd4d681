"""Cleaned training table and the width comparison."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from sensorloom.operators.cleaning import drop_any_null, quoted, shuffled, to_numeric
from sensorloom.operators.membership import encode_labels
from sensorloom.operators.models import MAX_EPOCHS, assembled, evaluate, fit_linear
from sensorloom.operators.scaling import minmax_columns
from sensorloom.operators.shards import hash_split
from sensorloom.schema import LABELS
from sensorloom.session import materialise


def clean_training_set(
    fused: DataFrame, selected: Sequence[str], labels: Sequence[str] = tuple(LABELS), label: str = "label",
    key: Sequence[str] = (), dropna_scope: str = "all", seed: int | None = None, strict: bool = False,
    position: str | None = None,
) -> DataFrame:
    """dropna -> select -> encode label -> numeric -> scale -> shuffle.

    ``dropna_scope="all"`` drops on every column before the selection, ``"selected"`` only on
    the kept ones. ``strict`` requires all selected features to be present. ``key`` columns are
    carried for splits and the seeded shuffle, whose order ``position`` makes a column.
    """
    present = sorted(set(selected) & set(fused.columns))
    missing = sorted(set(selected) - set(fused.columns))
    if strict and missing:
        raise ValueError(f"selected features are missing: {missing}")
    rows = drop_any_null(fused) if dropna_scope == "all" else fused
    rows = drop_any_null(rows.select(*[quoted(k) for k in key], *[quoted(c) for c in present], label))
    encoded = encode_labels(rows, labels, label)
    scaled = minmax_columns(to_numeric(encoded, key), present)
    return shuffled(scaled, list(key) or present, seed, position) if seed is not None else scaled


def windows_by_width(table: DataFrame, widths: Sequence[int], features: Sequence[str], label: str, labels: Sequence[str]) -> dict[str, DataFrame]:
    """Window tables of ``network_features_at_widths`` as training rows, one table per width (microseconds), scaled by itself.

    The windows of all widths are one stored table; a width is a filter on it.
    """
    rows = drop_any_null(table.select("width_us", "win_us", label, *[quoted(f) for f in features]))
    stored = materialise(encode_labels(rows, labels, label).withColumnRenamed(label, "label"))
    return {str(w // 1_000_000): minmax_columns(stored.filter(F.col("width_us") == w), features) for w in widths}


def compare_widths(
    tables: Mapping[str, DataFrame], features: Sequence[str], key: Sequence[str], classes: Sequence[int],
    label: str = "label", max_iter: int = MAX_EPOCHS,
) -> DataFrame:
    """Macro metrics of the linear classifier per window width (M8); the width is a column."""
    out = None
    for width, rows in tables.items():
        vectors = materialise(assembled(hash_split(rows, key), features).select("features", label, "split"))
        model = fit_linear(vectors.filter("split = 'train'"), label, max_iter)
        result = evaluate(model, vectors.filter("split = 'test'"), classes, label).withColumn("width", F.lit(width))
        out = result if out is None else out.unionByName(result)
    return out
