"""Selection job and window-width ablation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from sensorloom.operators.cleaning import drop_any_null, quoted
from sensorloom.operators.network import INTERVAL_FEATURES, LENGTH_FEATURES, network_features_at_widths
from sensorloom.operators.quantiles import melt
from sensorloom.operators.ranking import filter_score_table, selected_features, top_per_label
from sensorloom.operators.scoring import rank_values
from sensorloom.session import materialise

# Widths of the network ablation, in seconds.
ABLATION_WIDTHS = [20, 40, 60, 120, 240, 480, 960]


def select_univariate(
    scores: DataFrame, k: int = 200, labels: Sequence[str] | None = None, dropped_sources: Sequence[str] = (),
    single_source: str | None = None, pair_source: str | None = None,
) -> DataFrame:
    """Score table -> filters -> top k per label and score -> distinct features."""
    kept = filter_score_table(scores, dropped_sources, single_source, pair_source)
    return selected_features(top_per_label(kept, k, labels=labels))


def network_width_ablation(
    packets: DataFrame, ts: str, label: str, widths: Sequence[int] = tuple(ABLATION_WIDTHS),
    columns: dict[str, str] | None = None, features: Sequence[str] | None = None, tcp: str = "TCP", udp: str = "UDP",
) -> DataFrame:
    """(width_s, feature, label, scores): the network ranking at every window width.

    The packets are read for all widths at once, and a feature at a width is a feature of its own in one ranking.
    """
    names = list(features or LENGTH_FEATURES + INTERVAL_FEATURES)
    table = network_features_at_widths(packets, ts, widths, [label], "start", columns, tcp, udp)
    # The window table is small against the packets and the ranking reads it several times.
    rows = drop_any_null(materialise(table.select(label, "width_us", *[quoted(n) for n in names])))
    long = melt(rows.withColumnRenamed(label, "_label"), ["_label", "width_us"], names)
    named = long.select("_label", F.concat_ws("@", "feature", "width_us").alias("feature"), "x")
    width = F.substring_index("feature", "@", -1)
    scores = rank_values(named).withColumn("width_s", (width.cast("long") / 1_000_000).cast("int"))
    return scores.withColumn("feature", F.expr("left(feature, length(feature) - length(substring_index(feature, '@', -1)) - 1)"))


def ablation_top(scores: DataFrame, k: int = 10) -> DataFrame:
    """The k best features per (width, label, score)."""
    return top_per_label(scores.withColumn("feature", F.concat_ws("@", "feature", "width_s")), k)
