"""Per-device fusion job: raw sources -> one wide window table with labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from sensorloom.operators.buckets import Origin, assign_windows, fill_gaps, series_span, stored_span, window_grid, window_mean
from sensorloom.operators.cleaning import keep_selected, to_numeric
from sensorloom.operators.entropy import high_entropy_files
from sensorloom.operators.fusion import attach_calls, attach_labels, first_per_key, fuse, label_side
from sensorloom.operators.network import network_features
from sensorloom.schema import SourceRegistry
from sensorloom.session import materialise

TAGS = ["label", "device", "data_source"]
KEYS = ["device", "win_us"]
TIME_LINE = ["device", "label", "data_source", "origin_path"]


def window_source(
    rows: DataFrame, source: str, selected: Sequence[str], width: str, origin: Origin, ts: str = "ts",
    series: Sequence[str] = tuple(TIME_LINE),
) -> DataFrame:
    """Window features of one source, one time line per file, the way its kind requires."""
    if source == "network_data":
        features = network_features(rows, ts, width, series, origin)
    elif source == "entropy_data":
        features = high_entropy_files(rows, ts, width, series, origin)
    else:
        values = sorted(set(rows.columns) & set(selected))
        features = window_mean(to_numeric(rows, [*series, ts, "row_seq"]), ts, width, values, series, origin)
    return keep_selected(features, selected, [*series, "win_us"])


def merge_device(
    sources: Mapping[str, DataFrame],
    selected: Sequence[str],
    width: str,
    registry: SourceRegistry | None = None,
    calls: DataFrame | None = None,
    call_documents: DataFrame | None = None,
    fanout: bool = False,
    origin: Origin | None = None,
    ts: str = "ts",
) -> DataFrame:
    """All sources of all devices on a common window grid.

    The origin is the first timestamp of all sources. Sources without a selected feature are
    not scanned. ``calls`` is the encoded system-call table (device, doc, ts, term, value),
    ``call_documents`` (device, doc, ts) the list of all its documents.
    """
    registry = registry or SourceRegistry()
    if origin is None:
        # One scalar over the first timestamps of the sources.
        starts = None
        for rows in sources.values():
            one = series_span(rows, ts).select("lo_us")
            starts = one if starts is None else starts.union(one)
        origin = (starts.agg(F.min("lo_us")).first()[0]) / 1_000_000
    frames = {}
    for name, rows in sources.items():
        if not registry.wanted(name, selected, rows.columns):
            continue
        if name == "entropy_data" and "entropy_file_count" not in selected:
            continue
        # Stored once: both the label side and the fused values read the window table.
        frames[name] = materialise(window_source(rows, name, selected, width, origin, ts))
    labels = label_side(frames, KEYS)
    single = {
        name: first_per_key(frame, KEYS, ["origin_path"]).drop("label", "data_source", "origin_path")
        for name, frame in frames.items()
    }
    merged = attach_labels(fuse(single, KEYS), labels, KEYS, fanout)
    if calls is not None:
        terms = sorted(set(selected) - set(merged.columns))
        merged = attach_calls(merged, call_means(calls, terms, width, origin, ts, documents=call_documents), KEYS)
    return merged


def call_means(
    calls: DataFrame, terms: Sequence[str], width: str, origin: Origin, ts: str = "ts", doc: Sequence[str] = ("device", "doc"),
    documents: DataFrame | None = None,
) -> DataFrame:
    """Window means of encoded documents, wide over the selected terms.

    A document without a term counts as 0, so the mean is the sum over the window's documents divided
    by their number. ``documents`` (doc keys, ts) lists all of them, also those without any encoded
    term; by default those of ``calls``.
    """
    series = [doc[0]]
    listed = (calls if documents is None else documents).select(*doc, ts).distinct()
    span = stored_span(listed, ts, series, origin)
    counted = assign_windows(listed, ts, width, series, origin, span).groupBy(*series, "win_us").agg(F.count("*").alias("_docs"))
    names = {t: f"_sum{i}" for i, t in enumerate(terms)}
    sums = assign_windows(calls.filter(F.col("term").isin(list(terms))), ts, width, series, origin, span).groupBy(*series, "win_us").agg(
        *[F.sum(F.when(F.col("term") == t, F.col("value"))).alias(n) for t, n in names.items()])
    means = counted.join(sums, [*series, "win_us"], "left").select(
        *series, "win_us", *[(F.coalesce(n, F.lit(0.0)) / F.col("_docs")).alias(t) for t, n in names.items()])
    return fill_gaps(window_grid(listed, ts, width, series, origin, span), means, series, {})
