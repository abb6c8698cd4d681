"""Top-k selections over scores and weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from sensorloom.functions.numeric import ratio
from sensorloom.operators.cleaning import quoted
from sensorloom.operators.scaling import unit_scaled
from sensorloom.operators.scoring import SCORES


def with_mean_score(scores: DataFrame, columns: Sequence[str] = tuple(SCORES)) -> DataFrame:
    """Mean of the scores that are present in a row (nulls skipped)."""
    total, present = F.lit(0.0), F.lit(0)
    for c in columns:
        total = total + F.coalesce(F.col(c), F.lit(0.0))
        present = present + F.when(F.col(c).isNotNull(), 1).otherwise(0)
    return scores.withColumn("mean_score", ratio(total, present))


def sorted_by_mean(scores: DataFrame, columns: Sequence[str] = tuple(SCORES)) -> DataFrame:
    """Best mean score first (K2)."""
    return with_mean_score(scores, columns).orderBy(F.desc_nulls_last("mean_score"), "feature")


def scores_long(scores: DataFrame, ids: Sequence[str], columns: Sequence[str] = tuple(SCORES)) -> DataFrame:
    return scores.unpivot(list(ids), list(columns), "score_type", "score")


def top_per_label(
    scores: DataFrame, k: int, ids: Sequence[str] = ("feature",), labels: Sequence[str] | None = None,
    columns: Sequence[str] = tuple(SCORES),
) -> DataFrame:
    """The k best features per label and score, nulls last, ties by feature name (K3)."""
    rows = scores if labels is None else scores.filter(F.col("label").isin(*labels))
    long = scores_long(rows, ["label", *ids], columns)
    order = Window.partitionBy("label", "score_type").orderBy(F.desc_nulls_last("score"), *[F.col(c) for c in ids])
    return long.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def selected_features(top: DataFrame) -> DataFrame:
    """Union of all top lists as a set."""
    return top.select("feature").distinct()


def filter_score_table(
    scores: DataFrame,
    dropped_sources: Sequence[str] = (),
    single_source: str | None = None,
    pair_source: str | None = None,
) -> DataFrame:
    """Score-table filters (P22): non-robust runs, unwanted sources, pair terms that are single terms."""
    rows = scores.filter(~F.col("is_robust")) if "is_robust" in scores.columns else scores
    if single_source and pair_source:
        known = (
            rows.filter(F.col("data_source") == single_source)
            .select("feature", F.lit(pair_source).alias("data_source"))
            .distinct()
        )
        rows = rows.join(known, ["feature", "data_source"], "left_anti")
    return rows.filter(~F.col("data_source").isin(*dropped_sources)) if dropped_sources else rows


def best_feature(scores: DataFrame, score: str) -> DataFrame:
    """The single best row (K4)."""
    return scores.orderBy(F.desc_nulls_last(score), "feature").limit(1)


def ranked_weights(weights: DataFrame, by: str = "abs") -> DataFrame:
    """(class_id, feature, weight, rank): rank within the class by size or by signed value."""
    key = F.abs("weight") if by == "abs" else F.col("weight")
    order = Window.partitionBy("class_id").orderBy(F.desc_nulls_last(key), "feature")
    return weights.withColumn("rank", F.row_number().over(order))


def top_weights(weights: DataFrame, k: int = 4, by: str = "signed") -> DataFrame:
    """Features among the k largest weights of any class (K5)."""
    return ranked_weights(weights, by).filter(F.col("rank") <= k).select("feature").distinct()


def mean_scaled_weights(weights: DataFrame) -> DataFrame:
    """(feature, mean_weight): weights scaled per feature across classes, then averaged (M9)."""
    feature = Window.partitionBy("feature")  # one row per class
    scaled = unit_scaled(F.col("weight"), F.min("weight").over(feature), F.max("weight").over(feature))
    return weights.withColumn("scaled", scaled).groupBy("feature").agg(F.avg("scaled").alias("mean_weight"))


def top_mean_weights(weights: DataFrame, k: int = 50) -> DataFrame:
    """The k features of the largest mean scaled weight (K6)."""
    return mean_scaled_weights(weights).orderBy(F.desc("mean_weight"), "feature").limit(k)


def top_values(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    """The k most frequent values, ties by value (K8)."""
    counts = df.filter(quoted(column).isNotNull()).groupBy(quoted(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(k)


def preview(df: DataFrame, n: int, seed: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """First n rows of an order, or n random rows (K9)."""
    if seed is not None:
        return df.orderBy(F.rand(seed)).limit(n)
    return df.orderBy(*order).limit(n) if order else df.limit(n)


def in_order_of(scores: DataFrame, listed: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows of ``scores`` for the features of another table, in that table's order."""
    best = listed.groupBy("feature").agg(F.min(F.struct(*[F.col(c) for c in order])).alias("_o"))
    return scores.join(best, "feature").orderBy("_o").drop("_o")
