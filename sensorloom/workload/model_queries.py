"""Model queries. Fitted numbers have no SQL twin; identities that they must fulfil have one."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sensorloom.operators import models
from sensorloom.operators.fusion import union_sources
from sensorloom.operators.network import INTERVAL_FEATURES, LENGTH_FEATURES, network_features_at_widths
from sensorloom.operators.shards import hash_split
from sensorloom.plans.training_set import compare_widths, windows_by_width
from sensorloom.session import materialise
from sensorloom.workload.registry import query, r, rounded
from sensorloom.workload.table_queries import unit
from sensorloom.workload.time_queries import PACKET_COLUMNS, network_sql, packets

METRICS = ["accuracy", "precision", "recall", "f1"]
N_DIMS = 64
FEATURES = [f"f{i + 1}" for i in range(N_DIMS)]


def wide(t):
    """All dimensions as named features with label and row key."""
    columns = [F.col("embedding")[i].cast("double").alias(f) for i, f in enumerate(FEATURES)]
    return t.embeddings.select("vec_id", "label", *columns)


def classes(t):
    return [row["label"] for row in t.embeddings.select("label").distinct().orderBy("label").collect()]


def vectors(t):
    return hash_split(models.embedded(t.embeddings.select("vec_id", "label", "embedding"), "embedding"), ["vec_id"])


@query("linear_classifier")
def linear_classifier(t):
    """M1, M2, M4, M5: split, fit the linear classifier, macro metrics on the test rows."""
    rows = vectors(t)
    model = models.fit_linear(rows.filter("split = 'train'"))
    return rounded(models.evaluate(model, rows.filter("split = 'test'"), classes(t)), 6, METRICS)


@query("multilayer_classifier")
def multilayer_classifier(t):
    """M3: two hidden layers of 30 units."""
    rows = models.assembled(hash_split(wide(t), ["vec_id"]), FEATURES)
    labels = classes(t)
    model = models.fit_mlp(rows.filter("split = 'train'"), N_DIMS, max(labels) + 1)
    return rounded(models.evaluate(model, rows.filter("split = 'test'"), labels), 6, METRICS)


@query("linear_class_weights")
def linear_class_weights(t):
    """M9: weight table of the fitted linear classifier."""
    rows = models.assembled(wide(t), FEATURES)
    return rounded(models.class_weights(models.fit_linear(rows), rows, FEATURES), 6, ["weight"])


@query("weight_based_selection")
def weight_based_selection(t):
    """Fitted weights, the four largest per class, union."""
    return models.select_by_weights(wide(t), FEATURES)


@query("recursive_elimination")
def recursive_elimination(t):
    """the round in which each feature was dropped, one a round from 64 to 30; the kept ones have no round."""
    kept, dropped = models.eliminate_recursively(wide(t), FEATURES, keep=30)
    rows = [(f, turn) for turn, f in dropped] + [(f, None) for f in kept]
    return t.spark.createDataFrame(rows, "feature string, dropped_in int")


@query("training_protocol")
def training_protocol(t):
    """M4: accuracy on validation rows after every round, with the round whose weights are kept, for both networks."""
    parts = materialise(hash_split(vectors(t).filter("split = 'train'").drop("split"), ["vec_id"], 0.8, 7))
    train, held = (materialise(parts.filter(f"split = '{s}'").select("features", "label")) for s in ("train", "test"))
    n_classes, rows = max(classes(t)) + 1, []
    for name, hidden in (("linear", ()), ("multilayer", models.HIDDEN_LAYERS)):
        done = models.fit_best(train, held, N_DIMS, n_classes, hidden=hidden)
        rows += [(name, i, a, i == done.best_round) for i, a in enumerate(done.accuracies, 1)]
    return rounded(t.spark.createDataFrame(rows, "network string, round int, accuracy double, kept boolean"), 6, ["accuracy"])


@query("pca_explained_variance")
def pca_explained_variance(t):
    """cumulative explained variance for 1..10 components from one fit."""
    model, centred = models.fit_pca(models.embedded(t.embeddings, "embedding"), 10)
    return rounded(models.explained_variance(model, centred), 6, ["explained"])


DIMS_SQL = "(SELECT i, embedding[i]::DOUBLE AS x FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS i))"


@query(
    "pca_identities",
    f"""SELECT 64 AS n_components, {r('sum(v)', 6)} AS variance, 1.0::DOUBLE AS explained, 0.0::DOUBLE AS largest_mean, 0.0::DOUBLE AS largest_covariance
    FROM (SELECT i, var_samp(x) AS v FROM {DIMS_SQL} GROUP BY i)""",
)
def pca_identities(t):
    """all components together hold the variance of all columns, their means are 0, and neighbours do not vary together."""
    model, centred = models.fit_pca(models.embedded(t.embeddings, "embedding"), N_DIMS)
    parts = models.project(model, centred, [], N_DIMS)
    moments = parts.agg(
        sum((F.var_samp(f"pca_{i + 1}") for i in range(N_DIMS)), F.lit(0.0)).alias("variance"),
        F.greatest(*[F.abs(F.avg(f"pca_{i + 1}")) for i in range(N_DIMS)]).alias("largest_mean"),
        F.greatest(*[F.abs(F.covar_samp(f"pca_{i + 1}", f"pca_{i + 2}")) for i in range(N_DIMS - 1)]).alias("largest_covariance"))
    explained = float(sum(model.explainedVariance.toArray()))
    out = moments.withColumns({"n_components": F.lit(N_DIMS), "explained": F.lit(explained)})
    return rounded(out, 6, ["variance", "explained", "largest_mean", "largest_covariance"])


@query("linear_class_totals", "SELECT label::INT AS class_id, count(*)::DOUBLE AS expected_rows FROM embeddings WHERE label IS NOT NULL GROUP BY 1")
def linear_class_totals(t):
    """M2: at the optimum the predicted probabilities of a class sum up to its rows (the gradient of its bias is 0)."""
    rows = models.embedded(t.embeddings.filter("label IS NOT NULL").select("label", "embedding"), "embedding")
    scored = models.fit_linear(rows, max_iter=1000, reg=0.01).transform(rows).select(F.posexplode(vector_to_array("probability")).alias("class_id", "p"))
    return rounded(scored.groupBy("class_id").agg(F.sum("p").alias("expected_rows")).filter("expected_rows > 0.001"), 2, ["expected_rows"])


@query("pca_projection")
def pca_projection(t):
    """Two components next to the label of the same row."""
    model, centred = models.fit_pca(models.embedded(t.embeddings, "embedding"), 2)
    return rounded(models.project(model, centred, ["vec_id", "label"], 2), 6, ["pca_1", "pca_2"])


@query("cross_device_evaluation")
def cross_device_evaluation(t):
    """Features chosen on one half of the rows, evaluated on it, on the other and on both."""
    rows = hash_split(wide(t), ["vec_id"], 0.5, 7)
    source, target = rows.filter("split = 'train'").drop("split"), rows.filter("split = 'test'").drop("split")
    selected = models.select_by_weights(source, FEATURES)
    out = models.cross_device_evaluation(source, target, selected, FEATURES, ["vec_id"], classes(t))
    return rounded(out, 6, METRICS)


# The six widths of the training comparison, 10 to 60 seconds, stretched like those of the ablation.
TRAINING_WIDTHS = [w * 180 for w in (10, 20, 30, 40, 50, 60)]
WINDOW_FEATURES = LENGTH_FEATURES + INTERVAL_FEATURES


def training_windows(t):
    """{width in seconds: training rows} of the packet windows; the packets are read for all widths at once."""
    labels = sorted(row["event_type"] for row in t.events.select("event_type").distinct().collect())
    table = network_features_at_widths(packets(t), "ts", TRAINING_WIDTHS, ["event_type"], "start", PACKET_COLUMNS)
    return windows_by_width(table, [w * 1_000_000 for w in TRAINING_WIDTHS], WINDOW_FEATURES, "event_type", labels), len(labels)


@query("width_comparison")
def width_comparison(t):
    """M8: the same training on packet windows of six widths."""
    tables, n_labels = training_windows(t)
    return rounded(compare_widths(tables, WINDOW_FEATURES, ["label", "win_us"], list(range(n_labels))), 6, METRICS)


def training_rows_sql() -> str:
    """Complete windows per width, label and split."""
    known = " AND ".join(f'"{c}" IS NOT NULL' for c in WINDOW_FEATURES)
    parts = [f"SELECT '{w}' AS width, event_type, win_us FROM ({network_sql(w * 1_000_000, 'lo', 'event_type', False, None)}) WHERE {known}" for w in TRAINING_WIDTHS]
    return f"""WITH w AS ({" UNION ALL ".join(parts)}),
    c AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS label FROM (SELECT DISTINCT event_type FROM events))
    SELECT width, label::INT AS label, CASE WHEN {unit("label || '-' || win_us", 133, 10000)} < 8000 THEN 'train' ELSE 'test' END AS split, count(*) AS n_rows
    FROM w JOIN c USING (event_type) GROUP BY ALL"""


@query("width_training_rows", training_rows_sql())
def width_training_rows(t):
    """M8, M1: training and test rows of every class at every width."""
    tables, _ = training_windows(t)
    return union_sources([
        hash_split(rows, ["label", "win_us"]).groupBy("label", "split").agg(F.count("*").alias("n_rows")).withColumn("width", F.lit(width))
        for width, rows in tables.items()])
