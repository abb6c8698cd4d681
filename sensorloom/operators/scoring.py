"""Univariate feature scores against class labels.

Everything derives from one narrow aggregation per (feature, label): count, sum, mean,
variance, minimum and maximum. One-vs-rest scores use "rest = all - label", so scoring
each label costs no further pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sensorloom.functions.numeric import ratio
from sensorloom.operators.cleaning import drop_iqr_outliers, quoted
from sensorloom.operators.neighbors import neighbour_information, neighbour_information_by_label
from sensorloom.operators.quantiles import melt, quantile_bin_counts

SCORES = ["chi2", "f_classif", "mutual_info_classif"]


def labelled_values(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """(_label, feature, x) of every value that is present."""
    return melt(df.withColumn("_label", quoted(label)), ["_label"], features)


def class_moments(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """(feature, label, n, s, mean, var, lo, hi): features x labels rows."""
    return moments_of(labelled_values(df, label, features))


def moments_of(long: DataFrame) -> DataFrame:
    return long.groupBy("feature", F.col("_label").alias("label")).agg(
        F.count("*").alias("n"), F.sum("x").alias("s"), F.avg("x").alias("mean"), F.var_pop("x").alias("var"),
        F.min("x").alias("lo"), F.max("x").alias("hi"),
    )


def _with_totals(moments: DataFrame) -> DataFrame:
    """Adds the feature's totals to each class row (at most one row per class in a partition)."""
    feature = Window.partitionBy("feature")
    total = moments.withColumn("n_all", F.sum("n").over(feature)).withColumn("s_all", F.sum("s").over(feature))
    total = total.withColumn("mean_all", ratio(F.col("s_all"), F.col("n_all")))
    gap = F.col("mean") - F.col("mean_all")
    return total.withColumn("ss_all", F.sum(F.col("n") * (F.col("var") + gap * gap)).over(feature)).withColumn(
        "k", F.count("*").over(feature)
    )


def _chi2_term(observed: Column, expected: Column) -> Column:
    return ratio((observed - expected) * (observed - expected), expected)


def chi2_scores(moments: DataFrame) -> DataFrame:
    """Mass of a non-negative feature per class against the class shares (F2)."""
    t = _with_totals(moments)
    expected = ratio(F.col("n"), F.col("n_all")) * F.col("s_all")
    return t.groupBy("feature").agg(F.sum(_chi2_term(F.col("s"), expected)).alias("chi2"))


def f_scores(moments: DataFrame) -> DataFrame:
    """One-way analysis-of-variance F per feature."""
    t = _with_totals(moments)
    gap = F.col("mean") - F.col("mean_all")
    sums = t.groupBy("feature").agg(
        F.sum(F.col("n") * gap * gap).alias("between"), F.sum(F.col("n") * F.col("var")).alias("within"),
        F.max("k").alias("k"), F.max("n_all").alias("n"),
    )
    score = ratio(ratio(F.col("between"), F.col("k") - 1), ratio(F.col("within"), F.col("n") - F.col("k")))
    return sums.select("feature", score.alias("f_classif"))


def one_vs_rest_scores(moments: DataFrame) -> DataFrame:
    """(feature, label, chi2, f_classif) of every label against all others."""
    t = _with_totals(moments)
    n, s, n_all, s_all = (F.col(c) for c in ("n", "s", "n_all", "s_all"))
    rest_n, rest_s = n_all - n, s_all - s
    share = ratio(n, n_all)
    chi2 = _chi2_term(s, share * s_all) + _chi2_term(rest_s, ratio(rest_n, n_all) * s_all)
    gap = F.col("mean") - F.col("mean_all")
    rest_gap = ratio(rest_s, rest_n) - F.col("mean_all")
    between = n * gap * gap + rest_n * rest_gap * rest_gap
    score = ratio(between, ratio(F.col("ss_all") - between, n_all - 2))
    return t.select("feature", "label", chi2.alias("chi2"), score.alias("f_classif"))


def bin_counts(df: DataFrame, label: str, features: Sequence[str], bins: int = 10) -> DataFrame:
    """(feature, label, bin, n): values cut at the exact quantiles of the feature.

    bin = number of inner edges below the value, so equal edges simply leave bins empty.
    """
    return bin_counts_of(labelled_values(df, label, features), bins)


def bin_counts_of(long: DataFrame, bins: int = 10) -> DataFrame:
    return quantile_bin_counts(long, ["feature"], "x", ["_label"], bins).withColumnRenamed("_label", "label")


def binned_information(counts: DataFrame) -> DataFrame:
    """(feature, mutual_info_classif): plug-in mutual information of bin and label, in nats."""
    feature = Window.partitionBy("feature")
    joint = counts.withColumn("n_all", F.sum("n").over(feature)).withColumn(
        "n_bin", F.sum("n").over(Window.partitionBy("feature", "bin"))
    ).withColumn("n_label", F.sum("n").over(Window.partitionBy("feature", "label")))
    p = F.col("n") / F.col("n_all")
    term = p * F.log(F.col("n") * F.col("n_all") / (F.col("n_bin") * F.col("n_label")))
    return joint.groupBy("feature").agg(F.greatest(F.sum(term), F.lit(0.0)).alias("mutual_info_classif"))


def one_vs_rest_information(counts: DataFrame) -> DataFrame:
    """(feature, label, mutual_info_classif) of every label against all others, from the same counts.

    Bins without a row of the label still contribute through "rest": there the term depends on
    the bin's size only, so all of them together follow from the sizes of the bins that do
    hold the label.
    """
    joint = (
        counts.withColumn("n_all", F.sum("n").over(Window.partitionBy("feature")))
        .withColumn("n_bin", F.sum("n").over(Window.partitionBy("feature", "bin")))
        .withColumn("n_label", F.sum("n").over(Window.partitionBy("feature", "label")))
    )

    def term(n: Column, n_class: Column) -> Column:
        return F.when(n > 0, n / F.col("n_all") * F.log(n * F.col("n_all") / (F.col("n_bin") * n_class))).otherwise(0.0)

    both = term(F.col("n"), F.col("n_label")) + term(F.col("n_bin") - F.col("n"), F.col("n_all") - F.col("n_label"))
    sums = joint.groupBy("feature", "label").agg(
        F.sum(both).alias("present"), F.sum("n_bin").alias("covered"),
        F.max("n_all").alias("n_all"), F.max("n_label").alias("n_label"),
    )
    open_share = (F.col("n_all") - F.col("covered")) / F.col("n_all")
    absent = F.when(open_share > 0, open_share * F.log(F.col("n_all") / (F.col("n_all") - F.col("n_label")))).otherwise(0.0)
    return sums.select("feature", "label", F.greatest(F.col("present") + absent, F.lit(0.0)).alias("mutual_info_classif"))


def feature_scores(
    df: DataFrame, label: str, features: Sequence[str], bins: int = 10, method: str = "binned", neighbours: int = 3
) -> DataFrame:
    """(feature, chi2, f_classif, mutual_info_classif) over all classes."""
    moments = class_moments(df, label, features)
    if method == "knn":
        information = neighbour_information(df, label, features, neighbours)
    else:
        information = binned_information(bin_counts(df, label, features, bins))
    return chi2_scores(moments).join(f_scores(moments), "feature").join(information, "feature")


def information_by_label(
    df: DataFrame, label: str, features: Sequence[str], bins: int = 10, method: str = "binned", neighbours: int = 3
) -> DataFrame:
    """(feature, label, mutual_info_classif) against the rest, from quantile bins or from nearest neighbours ("knn")."""
    if method == "knn":
        return neighbour_information_by_label(df, label, features, neighbours)
    return one_vs_rest_information(bin_counts(df, label, features, bins))


def feature_scores_by_label(
    df: DataFrame, label: str, features: Sequence[str], bins: int = 10, method: str = "binned", neighbours: int = 3
) -> DataFrame:
    """(feature, label, chi2, f_classif, mutual_info_classif), each label against the rest."""
    moments = class_moments(df, label, features)
    information = information_by_label(df, label, features, bins, method, neighbours)
    return one_vs_rest_scores(moments).join(information, ["feature", "label"])


def information_gain(df: DataFrame, label: str, features: Sequence[str], bins: int = 10) -> DataFrame:
    """Mutual information per feature, best first."""
    return binned_information(bin_counts(df, label, features, bins)).orderBy(F.desc("mutual_info_classif"), "feature")


def unit_scaled_moments(moments: DataFrame) -> DataFrame:
    """Moments of the min-max-scaled features without reading the data again: scaling is linear.

    Constant features are left out.
    """
    feature = Window.partitionBy("feature")
    ends = moments.withColumn("a", F.min("lo").over(feature)).withColumn("w", F.max("hi").over(feature) - F.col("a"))
    return ends.filter("w > 0").select(
        "feature", "label", "n", ((F.col("s") - F.col("n") * F.col("a")) / F.col("w")).alias("s"),
        ((F.col("mean") - F.col("a")) / F.col("w")).alias("mean"), (F.col("var") / (F.col("w") * F.col("w"))).alias("var"),
        ((F.col("lo") - F.col("a")) / F.col("w")).alias("lo"), ((F.col("hi") - F.col("a")) / F.col("w")).alias("hi"),
    )


def rank_features(
    df: DataFrame,
    label: str,
    features: Sequence[str],
    scale: bool = True,
    drop_outliers: bool = False,
    bins: int = 10,
    method: str = "binned",
    neighbours: int = 3,
) -> DataFrame:
    """One source's ranking job (F8): outlier filter, min-max scaling, constant columns dropped, every label scored.

    Scaling is applied to the moments; quantile bins and neighbours do not change under it.
    """
    rows = drop_iqr_outliers(df, features) if drop_outliers else df
    moments = varying_moments(class_moments(rows, label, features), scale)
    information = information_by_label(rows, label, features, bins, method, neighbours)
    return one_vs_rest_scores(moments).join(information, ["feature", "label"])


def varying_moments(moments: DataFrame, scale: bool) -> DataFrame:
    """Moments without those of constant features, of the scaled values if asked."""
    if scale:
        return unit_scaled_moments(moments)
    spread = F.max("hi").over(Window.partitionBy("feature")) - F.min("lo").over(Window.partitionBy("feature"))
    return moments.withColumn("_spread", spread).filter("_spread > 0").drop("_spread")


def rank_values(long: DataFrame, scale: bool = True, bins: int = 10) -> DataFrame:
    """The ranking of rows (_label, feature, x), for example with a feature for every window width."""
    information = one_vs_rest_information(bin_counts_of(long, bins))
    return one_vs_rest_scores(varying_moments(moments_of(long), scale)).join(information, ["feature", "label"])
