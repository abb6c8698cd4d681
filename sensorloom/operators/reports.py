"""Count, summary and experiment tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from sensorloom.functions.numeric import ratio
from sensorloom.operators.cleaning import quoted
from sensorloom.operators.lookup import join_lookup
from sensorloom.operators.quantiles import feature_quantiles, melt
from sensorloom.session import materialise


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    """Rows per key."""
    return df.groupBy(*[quoted(k) for k in keys]).agg(F.count("*").alias("n_rows"))


def availability(df: DataFrame, rows: Sequence[str], column: str, values: Sequence[str]) -> DataFrame:
    """Row keys x known column values with counts, 0 where nothing exists."""
    table = df.groupBy(*rows).pivot(column, list(values)).agg(F.count(F.lit(1)))
    return table.fillna(0, subset=list(values))


def missing_cells(table: DataFrame, rows: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The zero cells of an availability table as (row keys, missing)."""
    return table.unpivot(list(rows), list(values), "missing", "n").filter("n = 0").drop("n")


def last_values(log: DataFrame, keys: Sequence[str], value: str = "value", order: Sequence[str] = ("ts", "step")) -> DataFrame:
    """Last non-null value per key in time order."""
    known = log.filter(F.col(value).isNotNull())
    return known.groupBy(*keys).agg(F.max_by(F.col(value), F.struct(*[F.col(c) for c in order])).alias(value))


def experiment_rollup(
    log: DataFrame, participant: str = "participant", tag: str = "tag", value: str = "value",
    order: Sequence[str] = ("ts", "step"), experiment: Sequence[str] = (), prefix: str = "Test/",
) -> DataFrame:
    """Mean (4 digits) and sample deviation (2 digits) over participants of each tag's last value."""
    test = log.filter(F.col(tag).startswith(prefix)) if prefix else log
    last = last_values(test, [*experiment, participant, tag], value, order)
    return last.groupBy(*experiment, tag).agg(
        F.bround(F.avg(value), 4).alias("mean_value"),
        F.bround(F.stddev_samp(value), 2).alias("std_value"),
        F.count("*").alias("n_participants"),
    )


def run_means(log: DataFrame, tag: str = "tag", value: str = "value") -> DataFrame:
    """Mean per tag of one run, 4 digits."""
    return log.groupBy(tag).agg(F.bround(F.avg(value), 4).alias("mean_value"))


def mean_scores(scores: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean of every score per feature over the labels."""
    return scores.groupBy("feature").agg(*[F.avg(c).alias(c) for c in columns])


def box_summary(df: DataFrame, features: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    """Per (ids, feature): quartiles, extremes, whisker ends and rows beyond them.

    A whisker ends at the last value within 1.5 quartile ranges of the box.
    """
    keys = [*ids, "feature"]
    box = feature_quantiles(df, features, [0.0, 0.25, 0.5, 0.75, 1.0], ids).select(
        *keys, F.col("q0").alias("lo"), F.col("q1").alias("q25"), F.col("q2").alias("median"),
        F.col("q3").alias("q75"), F.col("q4").alias("hi"),
    )
    reach = (F.col("q75") - F.col("q25")) * F.lit(1.5)
    box = materialise(box)
    rows = join_lookup(melt(df, ids, features), box, keys, stored=True)
    inside = F.col("x").between(F.col("q25") - reach, F.col("q75") + reach)
    whiskers = rows.groupBy(*keys).agg(
        F.min(F.when(inside, F.col("x"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("x"))).alias("whisker_hi"),
        F.count_if(~inside).alias("n_outliers"),
    )
    return box.join(whiskers, keys)


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins between minimum and maximum, empty ones included (A21); the top edge belongs to the last bin."""
    x = quoted(column).cast("double")
    rows = df.select(x.alias("x")).filter(F.col("x").isNotNull())
    ends = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).select(F.struct("lo", "hi")).scalar()
    placed = rows.withColumn("_e", ends)
    lo, hi = F.col("_e.lo"), F.col("_e.hi")
    # A constant column is centred in a range of width 1.
    left = F.when(lo == hi, lo - 0.5).otherwise(lo)
    width = F.when(lo == hi, F.lit(1.0)).otherwise(hi - lo) / F.lit(float(bins))
    index = F.least(F.floor((F.col("x") - left) / width), F.lit(bins - 1)).cast("int")
    counts = placed.groupBy(index.alias("bin")).agg(F.count("*").alias("n_rows"))
    spark = df.sparkSession
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin")).withColumn("_e", ends)
    return grid.join(counts, "bin", "left").select(
        "bin", (left + width * F.col("bin")).alias("left_edge"), F.coalesce("n_rows", F.lit(0)).alias("n_rows")
    )


def weight_threshold(weights: DataFrame, bins: int = 32, nth: int = 4) -> DataFrame:
    """The nth largest absolute weight and the histogram edge just below it.

    The edges run from the smallest to the largest absolute weight.
    """
    sizes = weights.select(F.abs("weight").alias("size"))
    top = sizes.orderBy(F.desc("size")).limit(nth).agg(F.min("size").alias("cut"))
    ends = sizes.agg(F.min("size").alias("lo"), F.max("size").alias("hi")).select(F.struct("lo", "hi")).scalar()
    placed = top.withColumn("_e", ends)
    width = (F.col("_e.hi") - F.col("_e.lo")) / F.lit(float(bins))
    steps = F.floor(F.try_divide(F.col("cut") - F.col("_e.lo"), width))
    return placed.select("cut", (F.col("_e.lo") + F.coalesce(steps, F.lit(0)) * width).alias("edge_below"))


def distinct_counts(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """One row with the number of distinct non-null values per column."""
    count = F.approx_count_distinct if approx else F.countDistinct
    return df.agg(*[count(quoted(c)).alias(f"n_{c}") for c in columns])


def quality_report(df: DataFrame, expected: dict[str, int]) -> DataFrame:
    """(check, found, expected, ok): distinct counts against the expected numbers."""
    found = distinct_counts(df, list(expected)).unpivot([], [f"n_{c}" for c in expected], "check", "found")
    want = F.lit(None).cast("long")
    for c, n in expected.items():
        want = F.when(F.col("check") == f"n_{c}", F.lit(n).cast("long")).otherwise(want)
    return found.withColumn("expected", want).withColumn("ok", F.col("found") == F.col("expected"))


def confusion(df: DataFrame, label: str, prediction: str, classes: Sequence) -> DataFrame:
    """(label, prediction, n) with all cells, also empty ones (M6).

    A label or prediction outside ``classes`` raises: leaving its rows out would falsify every metric.
    """
    known = df.select(*[
        F.when(quoted(c).isin(list(classes)), quoted(c)).otherwise(
            F.raise_error(F.concat(F.lit(f"{c} is not one of the classes: "), F.coalesce(quoted(c).cast("string"), F.lit("null"))))
            .cast(df.schema[c].dataType)).alias(c)
        for c in dict.fromkeys((label, prediction))
    ])
    counts = known.groupBy(quoted(label).alias("label"), quoted(prediction).alias("prediction")).agg(F.count("*").alias("n"))
    values = F.array(*[F.lit(c) for c in classes])
    one = df.sparkSession.range(1)
    grid = one.select(F.explode(values).alias("label")).withColumn("prediction", F.explode(values))
    return grid.join(counts, ["label", "prediction"], "left").select(
        "label", "prediction", F.coalesce("n", F.lit(0)).alias("n")
    )


def class_metrics(cells: DataFrame) -> DataFrame:
    """Per class: support, accuracy (= recall), precision, recall and F1; undefined ratios are 0."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0))
    by_label = cells.groupBy("label").agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    by_prediction = cells.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("predicted"))
    rows = by_label.join(by_prediction, "label")
    precision = F.coalesce(ratio(F.col("tp"), F.col("predicted")), F.lit(0.0))
    recall = F.coalesce(ratio(F.col("tp"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(ratio(F.lit(2.0) * F.col("tp"), F.col("predicted") + F.col("support")), F.lit(0.0))
    return rows.select(
        "label", "support", "predicted", "tp", precision.alias("precision"), recall.alias("recall"), f1.alias("f1")
    )


def macro_metrics(cells: DataFrame) -> DataFrame:
    """Unweighted class means (M5). A class that occurs neither as label nor as prediction is left out."""
    present = class_metrics(cells).filter((F.col("support") > 0) | (F.col("predicted") > 0))
    return present.agg(
        F.avg("recall").alias("accuracy"), F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
    )


def source_counts(features: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Features per data source and selection list."""
    return features.groupBy(*keys, "data_source").agg(F.count("*").alias("n_features"))
