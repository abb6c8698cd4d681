"""Nearest-neighbour mutual information of a continuous feature with a class (F4, second form).

Estimator of Ross (2014): per point, the distance to its k-th neighbour of the same
class gives a radius, and the points of all classes within it are counted. Equal values
are combined first. The feature's line is cut at stored split points, as many as its values need, into slices;
each slice is sorted on its own, receives the k nearest rows of the slices next to it,
and counts become global through the number of points in the slices before.
No jitter is added, so the result is deterministic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from sensorloom.functions.numeric import digamma
from sensorloom.operators.cleaning import quoted
from sensorloom.operators.lookup import join_lookup
from sensorloom.operators.quantiles import melt
from sensorloom.session import materialise

LEAST_SLICES = 16
SLICE_ROWS = 100_000  # distinct values of a feature and class that one task should sort


def _sliced(points: DataFrame, column: str, splits: DataFrame) -> DataFrame:
    """Adds the slice: the number of split points below the value."""
    placed = join_lookup(points, splits, ["feature"], stored=True)
    return placed.withColumn("slice", F.expr(f"size(filter(splits, s -> `{column}` > s))")).drop("splits")


def neighbour_information(
    df: DataFrame, label: str, features: Sequence[str], neighbours: int = 3, slices: int | None = None
) -> DataFrame:
    """(feature, mutual_info_classif); classes with a single point are left out."""
    long = melt(df.withColumn("_label", quoted(label)), ["_label"], features)
    return _information(long.select(F.struct("feature").alias("feature"), "_label", "x"), neighbours, slices).select("feature.feature", "mutual_info_classif")


def neighbour_information_by_label(
    df: DataFrame, label: str, features: Sequence[str], neighbours: int = 3, slices: int | None = None
) -> DataFrame:
    """(feature, label, mutual_info_classif) of every label against all others.

    Every point is a point of each label's own two-class problem; the labels are few.
    """
    labels = [r[0] for r in df.select(quoted(label)).distinct().collect() if r[0] is not None]
    long = melt(df.withColumn("_label", quoted(label)), ["_label"], features).filter(F.col("_label").isNotNull())
    against = long.withColumn("one", F.explode(F.array(*[F.lit(x) for x in labels])))
    return _information(
        against.select(F.struct("feature", "one").alias("feature"), (F.col("_label") == F.col("one")).alias("_label"), "x"), neighbours, slices
    ).select("feature.feature", F.col("feature.one").alias("label"), "mutual_info_classif")


def _information(long: DataFrame, k: int, slices: int | None) -> DataFrame:
    """(feature, mutual_info_classif) from (feature, _label, x); the feature is any key."""
    # Distinct values with their counts; class sizes, split points and points all start from them.
    combined = materialise(
        long.filter(F.col("x").isNotNull())
        .groupBy("feature", F.col("_label").alias("label"), "x")
        .agg(F.count("*").alias("c"))
    )
    classes = materialise(combined.groupBy("feature", "label").agg(F.sum("c").alias("n_class")).filter("n_class > 1"))
    if slices is None:
        largest = combined.groupBy("feature").count().agg(F.max("count")).first()[0] or 1
        slices = max(LEAST_SLICES, -(-largest // SLICE_ROWS))
    # Split points only balance the work, but all steps must agree on them: they are written once.
    probs = [i / slices for i in range(1, slices)]
    splits = materialise(
        combined.groupBy("feature").agg(F.percentile_approx("x", [float(p) for p in probs], max(1000, 20 * slices)).alias("splits"))
    )
    points = materialise(_sliced(join_lookup(combined, classes, ["feature", "label"], stored=True), "x", splits))

    # 1. Rows that neighbouring slices need: the k lowest and k highest of each (feature, label, slice).
    inner = ["feature", "label", "slice"]
    up = Window.partitionBy(*inner).orderBy("x")
    edges = (
        points.withColumn("_lo", F.lag("x", k).over(up).isNull())
        .withColumn("_hi", F.lead("x", k).over(up).isNull())
        .filter("_lo or _hi")
        .groupBy(*inner)
        .agg(
            F.array_sort(F.collect_list(F.when(F.col("_lo"), F.struct("x", "c")))).alias("low"),
            F.array_sort(F.collect_list(F.when(F.col("_hi"), F.struct("x", "c")))).alias("high"),
        )
    )
    line = Window.partitionBy("feature", "label").orderBy("slice")
    before = F.flatten(F.collect_list("high").over(line.rowsBetween(Window.unboundedPreceding, -1)))
    after = F.flatten(F.collect_list("low").over(line.rowsBetween(1, Window.unboundedFollowing)))
    halo = edges.select(
        *inner,
        F.slice(F.reverse(before), 1, k).alias("left"),
        F.slice(after, 1, k).alias("right"),
    )
    borrowed = halo.select(*inner, F.explode(F.concat("left", "right")).alias("p")).select(
        *inner, F.col("p.x").alias("x"), F.col("p.c").alias("c"), F.lit(False).alias("own")
    )
    lined = points.select(*inner, "x", "c", F.lit(True).alias("own")).unionByName(borrowed)

    # 2. The k-th neighbour of the same class: up to k values to each side, by distance.
    order = Window.partitionBy(*inner).orderBy("x")
    sides = []
    for i in range(1, k + 1):
        for shift in (F.lag, F.lead):
            other = shift("x", i).over(order)
            # Repeated for the copies of that value.
            near = F.struct(F.abs(other - F.col("x")).alias("gap"), other.alias("at"))
            sides.append(F.array_repeat(near, F.least(shift("c", i).over(order), F.lit(k)).cast("int")))
    itself = F.struct(F.lit(0.0).alias("gap"), F.col("x").alias("at"))
    copies = F.array_repeat(itself, F.least(F.col("c") - 1, F.lit(k)).cast("int"))
    gathered = F.filter(F.flatten(F.array_compact(F.array(copies, *sides))), lambda d: d["at"].isNotNull())
    wanted = F.least(F.lit(k).cast("long"), F.col("n_class") - 1)
    radii = (
        join_lookup(lined.withColumn("_near", F.array_sort(gathered)).filter("own"), classes, ["feature", "label"], stored=True)
        .withColumn("k_used", wanted)
        .withColumn("_kth", F.element_at("_near", wanted.cast("int")))
        .withColumn("radius", F.col("_kth.gap"))
        # On its own side the k-th neighbour's value is the exact end, a sum could miss it by one bit.
        .withColumn("upper", F.when(F.col("_kth.at") > F.col("x"), F.col("_kth.at")).otherwise(F.col("x") + F.col("radius")))
        .withColumn("lower", F.when(F.col("_kth.at") < F.col("x"), F.col("_kth.at")).otherwise(F.col("x") - F.col("radius")))
    )

    # 3. Points of all classes inside the radius: running counts at both interval ends.
    # Every slice gets an offset, also one without points: an interval may end there.
    totals = points.groupBy("feature", "slice").agg(F.sum("c").alias("in_slice"))
    grid = splits.select("feature", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    earlier = Window.partitionBy("feature").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = grid.join(totals, ["feature", "slice"], "left").select(
        "feature", "slice", F.coalesce(F.sum("in_slice").over(earlier), F.lit(0)).alias("offset")
    )
    # Points at exactly the radius are outside; with radius 0 the copies of the point are inside.
    open_end = F.col("radius") > 0
    carried = ["feature", "label", "x", "c", "k_used", "n_class"]
    queries = radii.select(
        *carried,
        F.explode(
            F.array(
                F.struct(
                    F.col("upper").alias("at"),
                    F.when(open_end, 0).otherwise(2).alias("rank"), F.lit(1).alias("sign"),
                ),
                F.struct(
                    F.col("lower").alias("at"),
                    F.when(open_end, 2).otherwise(0).alias("rank"), F.lit(-1).alias("sign"),
                ),
            )
        ).alias("q"),
    ).select(*carried, F.col("q.at").alias("at"), F.col("q.rank").alias("rank"), F.col("q.sign").alias("sign"))
    placed = _sliced(queries, "at", splits)
    # Sorted by (position, rank): rank 0 comes before the points at the same position, rank 2 after them.
    events = placed.withColumn("w", F.lit(0).cast("long")).unionByName(
        points.select("feature", "slice", F.col("x").alias("at"), F.lit(1).alias("rank"), F.col("c").alias("w")),
        allowMissingColumns=True,
    )
    sweep = Window.partitionBy("feature", "slice").orderBy("at", "rank").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    ends = events.withColumn("upto", F.sum("w").over(sweep)).filter(F.col("sign").isNotNull())
    counted = join_lookup(ends, offsets, ["feature", "slice"])
    inside = counted.groupBy("feature", "label", "x").agg(
        F.sum(F.col("sign") * (F.col("upto") + F.col("offset"))).alias("m"),
        F.max("c").alias("c"), F.max("k_used").alias("k_used"), F.max("n_class").alias("n_class"),
    )
    sums = inside.groupBy("feature").agg(
        F.sum("c").alias("n"),
        F.sum(F.col("c") * digamma(F.col("k_used"))).alias("s_k"),
        F.sum(F.col("c") * digamma(F.col("n_class"))).alias("s_class"),
        F.sum(F.col("c") * digamma(F.col("m"))).alias("s_m"),
    )
    estimate = digamma(F.col("n")) + (F.col("s_k") - F.col("s_class") - F.col("s_m")) / F.col("n")
    return sums.select("feature", F.greatest(estimate, F.lit(0.0)).alias("mutual_info_classif"))
