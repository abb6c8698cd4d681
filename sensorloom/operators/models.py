"""Linear and multi-layer classifiers, weight-based and recursive selection, PCA."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.classification import (
    LogisticRegression, LogisticRegressionModel, MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier,
)
from pyspark.ml.feature import PCA, PCAModel, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseMatrix
from pyspark.sql import DataFrame, functions as F

from sensorloom.operators.cleaning import drop_any_null
from sensorloom.operators.membership import in_both
from sensorloom.operators.ranking import top_weights
from sensorloom.operators.reports import confusion, macro_metrics
from sensorloom.operators.scaling import minmax_columns
from sensorloom.operators.shards import hash_split
from sensorloom.session import materialise

# Epochs and hidden layers of the training set-up.
MAX_EPOCHS = 150
HIDDEN_LAYERS = (30, 30)
PATIENCE = 5
# Iterations between two looks at the validation rows.
ROUND_EPOCHS = 5


def assembled(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    """Adds the feature vector; rows with a null feature are dropped."""
    known = drop_any_null(df, features)
    return known.withColumn(out, array_to_vector(F.array(*[F.col(f"`{f}`").cast("double") for f in features])))


def embedded(df: DataFrame, column: str, out: str = "features") -> DataFrame:
    """Array column -> feature vector."""
    return df.withColumn(out, array_to_vector(F.col(column).cast("array<double>")))


def fit_linear(train: DataFrame, label: str = "label", max_iter: int = MAX_EPOCHS, reg: float = 0.0) -> LogisticRegressionModel:
    """Multinomial linear classifier with a bias (M2)."""
    return LogisticRegression(
        featuresCol="features", labelCol=label, family="multinomial", standardization=False,
        maxIter=max_iter, regParam=reg, tol=1e-6,
    ).fit(train)


def fit_mlp(
    train: DataFrame, n_features: int, n_classes: int, label: str = "label", hidden: Sequence[int] = HIDDEN_LAYERS,
    max_iter: int = MAX_EPOCHS, seed: int = 133,
) -> MultilayerPerceptronClassificationModel:
    """Two hidden layers of 30 units (M3); Spark's hidden units are sigmoid."""
    return MultilayerPerceptronClassifier(
        featuresCol="features", labelCol=label, layers=[n_features, *hidden, n_classes], maxIter=max_iter, seed=seed,
    ).fit(train)


class Training(NamedTuple):
    """The best model, its round (from 1) and the validation accuracy after every round."""

    model: MultilayerPerceptronClassificationModel
    best_round: int
    accuracies: list[float]


def accuracy(model, rows: DataFrame, label: str = "label") -> float:
    hits = model.transform(rows).agg(F.avg((F.col("prediction") == F.col(label)).cast("double")))
    return hits.first()[0] or 0.0


def fit_best(
    train: DataFrame, validation: DataFrame, n_features: int, n_classes: int, label: str = "label", hidden: Sequence[int] = HIDDEN_LAYERS,
    max_iter: int = MAX_EPOCHS, round_iter: int = ROUND_EPOCHS, patience: int = PATIENCE, seed: int = 133,
) -> Training:
    """The training protocol (M4): fit for a few iterations, look at the validation rows, go on from the last weights.

    Ends after ``patience`` rounds without a better accuracy, after ``max_iter`` iterations, or when the weights stand still; the model of the
    best round is the result, the earliest among equals. Without hidden layers it is the linear classifier. Both tables are read
    in every round and should be stored.
    """
    learner = MultilayerPerceptronClassifier(
        featuresCol="features", labelCol=label, layers=[n_features, *hidden, n_classes], maxIter=round_iter, seed=seed)
    best, best_round, seen, weights = None, 0, [], None
    for number in range(1, math.ceil(max_iter / round_iter) + 1):
        model = learner.fit(train)
        seen.append(accuracy(model, validation, label))
        if best is None or seen[-1] > seen[best_round - 1]:
            best, best_round = model, number
        still = weights is not None and model.weights == weights
        weights = model.weights
        if number - best_round >= patience or still:
            break
        learner.setInitialWeights(weights)
    return Training(best, best_round, seen)


def class_weights(model: LogisticRegressionModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(class_id, feature, weight): classes x features numbers, read off the fitted model."""
    matrix = model.coefficientMatrix.toArray()
    rows = [(c, f, float(matrix[c][i])) for c in range(matrix.shape[0]) for i, f in enumerate(features)]
    return df.sparkSession.createDataFrame(rows, "class_id int, feature string, weight double")


def evaluate(model, test: DataFrame, classes: Sequence[int], label: str = "label") -> DataFrame:
    """Macro metrics of a fitted classifier on held-out rows (M4, M5)."""
    scored = model.transform(test).select(F.col(label).cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"))
    return macro_metrics(confusion(scored, "label", "prediction", classes))


def select_by_weights(
    df: DataFrame, features: Sequence[str], label: str = "label", k: int = 4, by: str = "signed", max_iter: int = MAX_EPOCHS
) -> DataFrame:
    """Features among the k largest weights of any class of a fitted linear model."""
    train = assembled(df, features)
    model = fit_linear(train, label, max_iter)
    return top_weights(class_weights(model, df, features), k, by)


def eliminate_recursively(
    df: DataFrame, features: Sequence[str], keep: int = 30, step: int = 1, label: str = "label", max_iter: int = MAX_EPOCHS
) -> tuple[list[str], list[tuple[int, str]]]:
    """Recursive elimination (F11): refit, drop the ``step`` features of the smallest squared weights, one by default.

    Returns the kept features and (round, dropped feature). The feature vectors are assembled and stored once: a dropped
    feature stays in them, and its weights are bounded by 0 from then on. The loop is over fits; every
    fit is distributed over the rows.
    """
    vectors = materialise(assembled(df, features).select("features", label))
    classes = (vectors.agg(F.max(label)).first()[0] or 0) + 1
    names, out, dropped, turn = list(features), [], [], 0
    while len(names) - len(out) > keep:
        turn += 1
        matrix = fit_without(vectors, len(names), [names.index(f) for f in out], classes, label, max_iter).coefficientMatrix.toArray()
        order = sorted((float((matrix[:, i] ** 2).sum()), f) for i, f in enumerate(names) if f not in out)
        worst = {f for _, f in order[: min(step, len(names) - len(out) - keep)]}
        dropped += [(turn, f) for f in names if f in worst]
        out += worst
    return [f for f in names if f not in out], dropped


def fit_without(
    train: DataFrame, n_features: int, out: Sequence[int], n_classes: int, label: str = "label", max_iter: int = MAX_EPOCHS, reg: float = 1e-4
) -> LogisticRegressionModel:
    """Multinomial linear classifier in which the features at the positions ``out`` have the weight 0."""
    learner = LogisticRegression(featuresCol="features", labelCol=label, family="multinomial", standardization=False, maxIter=max_iter, regParam=reg, tol=1e-6)
    if out:
        limit = [0.0 if i in set(out) else math.inf for i in range(n_features) for _ in range(n_classes)]
        learner.setUpperBoundsOnCoefficients(DenseMatrix(n_classes, n_features, limit))
        learner.setLowerBoundsOnCoefficients(DenseMatrix(n_classes, n_features, [-x for x in limit]))
    return learner.fit(train)


def fit_pca(df: DataFrame, k: int = 10, vector: str = "features") -> tuple[PCAModel, DataFrame]:
    """PCA on centred vectors (F12); returns the model and the centred table."""
    centred = StandardScaler(inputCol=vector, outputCol="_centred", withMean=True, withStd=False).fit(df).transform(df)
    return PCA(k=k, inputCol="_centred", outputCol="components").fit(centred), centred


def explained_variance(model: PCAModel, df: DataFrame) -> DataFrame:
    """(n_components, explained): cumulative share for 1..k components from one fit."""
    total, rows = 0.0, []
    for i, share in enumerate(model.explainedVariance.toArray()):
        total += float(share)
        rows.append((i + 1, total))
    return df.sparkSession.createDataFrame(rows, "n_components int, explained double")


def project(model: PCAModel, centred: DataFrame, keep: Sequence[str], k: int = 2) -> DataFrame:
    """First k components next to the kept columns of the same row."""
    parts = model.transform(centred).select(*keep, vector_to_array("components").alias("_c"))
    return parts.select(*keep, *[F.col("_c")[i].alias(f"pca_{i + 1}") for i in range(k)])


def cross_device_evaluation(
    source: DataFrame, target: DataFrame, selected: DataFrame, features: Sequence[str], key: Sequence[str],
    classes: Sequence[int], label: str = "label", max_iter: int = MAX_EPOCHS,
) -> DataFrame:
    """Features chosen on one device family, trained and tested on another and on both (M7).

    Each variant scales its own rows, splits 80/20 by row hash and reports macro metrics.
    """
    spark = source.sparkSession
    # The feature list of the other table decides, as it may lack some columns.
    there = spark.createDataFrame([(c,) for c in target.columns if c in features], "feature string")
    shared = sorted(r["feature"] for r in in_both(selected.select("feature").distinct(), there).collect())
    variants = {
        "source": source, "target": target, "both": source.unionByName(target, allowMissingColumns=True),
    }
    out = None
    for name, rows in variants.items():
        scaled = hash_split(minmax_columns(drop_any_null(rows, [*shared, label]), shared), key)
        # The scaled training table is stored, as every iteration and the evaluation read it.
        vectors = assembled(materialise(scaled.select(*[F.col(f"`{f}`") for f in shared], label, "split")), shared)
        model = fit_linear(vectors.filter("split = 'train'"), label, max_iter)
        result = evaluate(model, vectors.filter("split = 'test'"), classes, label).withColumn("variant", F.lit(name))
        out = result if out is None else out.unionByName(result)
    return out
