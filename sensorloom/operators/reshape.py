"""Long/wide forms of score tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from sensorloom.operators.cleaning import quoted
from sensorloom.operators.ranking import with_mean_score
from sensorloom.operators.scaling import minmax_by_group, minmax_columns
from sensorloom.operators.scoring import SCORES


def wide_to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), [quoted(v) for v in values], name, value)


def score_heatmap(scores: DataFrame, score: str, labels: Sequence[str]) -> DataFrame:
    """feature x label table of one scaled score (R2); ``labels`` fixes the columns."""
    scaled = minmax_columns(scores, SCORES)
    return scaled.groupBy("feature").pivot("label", list(labels)).agg(F.first(score))


def feature_heatmap(scores: DataFrame, feature: str, labels: Sequence[str]) -> DataFrame:
    """score type x label table of one feature; scaling runs over all features."""
    scaled = minmax_columns(scores, SCORES).filter(F.col("feature") == feature)
    long = wide_to_long(scaled, ["label"], SCORES, "score_type", "score_value")
    return long.groupBy("score_type").pivot("label", list(labels)).agg(F.first("score_value"))


def score_profile(scores: DataFrame, feature: str | None = None) -> DataFrame:
    """Scaled scores as a line table.

    With ``feature`` the rows are filtered before scaling, without it all are scaled together.
    """
    rows = scores if feature is None else scores.filter(F.col("feature") == feature)
    return with_mean_score(minmax_columns(rows, SCORES))


def top_profile_by_label(top: DataFrame) -> DataFrame:
    """Scores scaled within each label, their mean, duplicates removed."""
    return with_mean_score(minmax_by_group(top.distinct(), ["label"], SCORES))
