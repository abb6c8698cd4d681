import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.functions.numeric import digamma, hash_unit
from sensorloom.operators import cleaning, ordering, quantiles, ranking, reports, scaling, scoring, shards
from sensorloom.operators.neighbors import neighbour_information
from sensorloom.schema import LABELS

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


@pytest.mark.parametrize("kind", ["normal", "few", "hot", "tiny"])
def test_exact_quantiles_match_numpy(spark, kind):
    rng = np.random.default_rng(1)
    data = {
        "normal": rng.normal(size=5000), "few": rng.integers(0, 4, 3000).astype(float),
        "hot": np.concatenate([np.full(1500, 2.5), rng.exponential(size=3000)]), "tiny": np.array([3.0, 1.0, 2.0]),
    }[kind]
    df = spark.createDataFrame([("g", float(x)) for x in data] + [("g", None), ("g", float("nan")), ("h", 1.0)], "k string, x double")
    # A coarse sketch makes the brackets wide, the result must stay exact.
    rows = {r["k"]: r for r in quantiles.exact_quantiles(df, ["k"], "x", PROBS, accuracy=50).collect()}
    for i, p in enumerate(PROBS):
        assert rows["g"][f"q{i}"] == pytest.approx(np.quantile(data, p), abs=1e-12)
        assert rows["h"][f"q{i}"] == 1.0
    assert rows["g"]["n"] == len(data)
    whole = quantiles.exact_quantiles(df.filter("k = 'g'"), [], "x", [0.5], accuracy=50).collect()[0]
    assert whole["q0"] == pytest.approx(np.quantile(data, 0.5), abs=1e-12)


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_quantile_bins_match_numpy(spark, accuracy):
    rng = np.random.default_rng(2)
    x = np.concatenate([np.full(700, 1.25), rng.normal(size=1400)])
    y = rng.choice(["a", "b", "c"], len(x))
    df = spark.createDataFrame([("f", float(a), str(b)) for a, b in zip(x, y)], "k string, x double, y string")
    got = {(r["y"], r["bin"]): r["n"] for r in quantiles.quantile_bin_counts(df, ["k"], "x", ["y"], 10, accuracy).collect()}
    edges = np.quantile(x, [i / 10 for i in range(1, 10)])
    bins = (x[:, None] > edges[None, :]).sum(axis=1)
    expected = {}
    for label, b in zip(y, bins):
        expected[(str(label), int(b))] = expected.get((str(label), int(b)), 0) + 1
    assert got == expected


def grouped_values(rng):
    rows = [("few", float(x), 1) for x in rng.random(7)] + [("one", 3.0, 4), ("equal", 2.0, 1), ("equal", 2.0, 5)]
    rows += [("many", float(x), int(w)) for x, w in zip(rng.normal(size=900).round(2), rng.integers(1, 4, 900))]
    rows += [("skewed", float(10.0 ** x), 1) for x in rng.normal(size=800) * 3]
    rows += [("ends", x, 1) for x in [-math.inf, math.inf, 0.0, *map(float, range(200))]]
    return rows + [("few", None, 1), ("few", math.nan, 1), ("none", None, 1), ("many", 9.0, 0)]


@pytest.mark.parametrize("few,cells", [(4096, 1024), (16, 64)])
def test_quantiles_of_groups_match_numpy(spark, monkeypatch, few, cells):
    from sensorloom.operators import ranks

    monkeypatch.setattr(ranks, "FEW", few)
    monkeypatch.setattr(ranks, "CELLS", cells)
    rows = grouped_values(np.random.default_rng(12))
    df = spark.createDataFrame(rows, "g string, v double, w int")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: [r[f"q{i}"] for i in range(5)] for r in ranks.group_quantiles(df, ["g"], "v", probs, "w").collect()}
    assert set(got) == {"few", "one", "equal", "many", "skewed", "ends"}
    for g, values in got.items():
        data = np.repeat([v for k, v, _ in rows if k == g and v is not None and v == v], [w for k, v, w in rows if k == g and v is not None and v == v])
        for p, mine in zip(probs, values):
            expected = {0.0: data.min(), 1.0: data.max()}.get(p)
            assert mine == pytest.approx(np.quantile(data, p) if expected is None else expected, rel=1e-12), (g, p)


def test_a_rank_outside_its_bracket_is_selected_by_rounds(spark, monkeypatch):
    from sensorloom.operators import quantiles

    rng = np.random.default_rng(4)
    data = rng.normal(size=3000)
    df = spark.createDataFrame([("a", float(x)) for x in data] + [("b", float(x)) for x in data[:500]], "g string, x double")
    right = quantiles.bracketed

    def shifted(rows, keys, probs, accuracy):
        moved = F.expr("IF(g = 'a', transform(b, x -> x + 5), b)")
        return right(rows, keys, probs, accuracy).withColumn("b", moved)

    monkeypatch.setattr(quantiles, "bracketed", shifted)
    got = {r["g"]: (r["q0"], r["q1"], r["n"]) for r in quantiles.exact_quantiles(df, ["g"], "x", [0.25, 0.5]).collect()}
    for g, mine in (("a", data), ("b", data[:500])):
        assert got[g][:2] == pytest.approx(tuple(np.quantile(mine, [0.25, 0.5]))) and got[g][2] == len(mine)
    bins = quantiles.quantile_bin_counts(df.withColumn("l", F.lit(1)), ["g"], "x", ["l"], 4).groupBy("g").agg(F.sum("n").alias("n")).collect()
    assert {r["g"]: r["n"] for r in bins} == {"a": 3000, "b": 500}


def test_generated_code_of_the_brackets_is_small_enough_to_be_compiled(spark, monkeypatch):
    import re

    from sensorloom.operators import quantiles

    sizes, store = [], quantiles.materialise

    def watched(frame):
        plan = frame._jdf.queryExecution().executedPlan()
        sizes.extend(map(int, re.findall(r"maxMethodCodeSize:(\d+)", spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(plan))))
        return store(frame)

    monkeypatch.setattr(quantiles, "materialise", watched)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(2000).selectExpr("concat('f', id % 3) AS feature", "id * 1.5D AS x", "id % 2 AS _label")
        assert quantiles.quantile_bin_counts(df, ["feature"], "x", ["_label"], 10).count() > 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sizes and max(sizes) < 8000


def test_iqr_filter_golden(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, 1.0), (100.0, 1.0), (None, 1.0)], "a double, b double")
    assert sorted(r["a"] or 0 for r in cleaning.drop_iqr_outliers(df, ["a", "b"]).collect()) == [0, 1, 2, 3]
    bounds = {r["feature"]: r for r in cleaning.iqr_bounds(df, ["a", "b"]).collect()}
    assert bounds["a"]["lo"] == pytest.approx(1.75 - 1.5 * 25.5)


def test_minmax_constant_and_null(spark):
    df = spark.createDataFrame([(7.0, 0.0, "k"), (7.0, 4.0, "l"), (None, 1.0, "m")], "c double, `x.y` double, id string")
    out = {r["id"]: r for r in scaling.minmax_columns(df, ["c", "x.y"]).collect()}
    assert (out["k"]["c"], out["m"]["c"], out["l"]["x.y"], out["m"]["x.y"]) == (0.0, None, 1.0, 0.25)


def test_row_index_and_shard_sizes(spark):
    df = spark.range(1000).withColumn("k", F.md5(F.col("id").cast("string")))
    rows = ordering.with_row_index(df, ["k"], "i").collect()
    assert [r["k"] for r in sorted(rows, key=lambda r: r["i"])] == sorted(r["k"] for r in rows)
    assert sorted(r["i"] for r in rows) == list(range(1000))
    sizes = ordering.contiguous_shards(spark.range(7), ["id"], 3).groupBy("shard").count().orderBy("shard").collect()
    assert [r["count"] for r in sizes] == [3, 2, 2]


def test_hash_value_and_split_are_fixed(spark):
    assert spark.range(1).select(hash_unit(F.lit(1), 42, 2**32).alias("h")).collect()[0]["h"] == 614422250
    df = spark.range(5000).withColumn("label", F.lit("x"))
    split = shards.hash_split(df, ["id"])
    share = split.filter("split = 'train'").count() / 5000
    assert 0.77 < share < 0.83
    assert split.repartition(3).exceptAll(shards.hash_split(df.repartition(11), ["id"])).isEmpty()


def test_label_skew_keeps_every_row(spark):
    df = spark.range(2000).withColumn("label", F.when(F.col("id") % 3 == 0, "a").otherwise("b"))
    placed = shards.label_skewed_shards(df, "label", ["id"], shards.dirichlet_shares(["a", "b"], 4, 1.0, 5), 5)
    assert placed.filter("shard is null or shard not between 0 and 3").isEmpty() and placed.count() == 2000


def score_rows(spark, rows):
    return spark.createDataFrame(rows, "x double, label string")


def test_chi2_and_f_golden(spark):
    chi = scoring.chi2_scores(scoring.class_moments(score_rows(spark, [(1.0, "p"), (1.0, "p"), (0.0, "q"), (0.0, "q")]), "label", ["x"]))
    assert chi.collect()[0]["chi2"] == pytest.approx(2.0)
    f = scoring.f_scores(scoring.class_moments(score_rows(spark, [(1.0, "p"), (2.0, "p"), (3.0, "q"), (4.0, "q")]), "label", ["x"]))
    assert f.collect()[0]["f_classif"] == pytest.approx(8.0)


def test_one_vs_rest_of_two_classes_equals_all_classes(spark):
    rng = np.random.default_rng(3)
    df = score_rows(spark, [(float(abs(rng.normal(i % 2))), "pq"[i % 2]) for i in range(400)])
    whole = scoring.feature_scores(df, "label", ["x"]).collect()[0]
    for row in scoring.feature_scores_by_label(df, "label", ["x"]).collect():
        for c in scoring.SCORES:
            assert row[c] == pytest.approx(whole[c], rel=1e-9)


def test_one_vs_rest_information_counts_bins_without_the_label(spark):
    rows = [(float(i), "a" if i < 20 else "b" if i < 60 else "c") for i in range(100)]
    df = score_rows(spark, rows)
    got = {r["label"]: r["mutual_info_classif"] for r in scoring.feature_scores_by_label(df, "label", ["x"]).collect()}
    for label in "abc":
        two = df.withColumn("label", F.when(F.col("label") == label, "in").otherwise("out"))
        expected = scoring.information_gain(two, "label", ["x"]).collect()[0]["mutual_info_classif"]
        assert got[label] == pytest.approx(expected, abs=1e-12)


def test_ranking_drops_constants_and_equals_scaled_scores(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame(
        [(float(rng.exponential()), 5.0, float(rng.integers(0, 9)), "abc"[i % 3]) for i in range(300)], "x double, c double, z double, label string"
    )
    got = {(r["feature"], r["label"]): r for r in scoring.rank_features(df, "label", ["x", "c", "z"]).collect()}
    scaled = scaling.minmax_columns(df, ["x", "z"])
    for row in scoring.feature_scores_by_label(scaled, "label", ["x", "z"]).collect():
        for c in scoring.SCORES:
            assert got[(row["feature"], row["label"])][c] == pytest.approx(row[c], rel=1e-8)
    assert len(got) == 6


def psi(m):
    return -0.5772156649015329 + sum(1.0 / i for i in range(1, m))


def test_digamma(spark):
    rows = spark.range(1, 200).select("id", digamma(F.col("id")).alias("p")).collect()
    assert all(r["p"] == pytest.approx(psi(r["id"]), abs=1e-12) for r in rows)


def brute_information(x, y, k):
    keep = np.array([np.sum(y == c) > 1 for c in y])
    x, y = x[keep], y[keep]
    total = psi(len(x))
    for v, c in zip(x, y):
        same = np.sort(np.abs(x[y == c] - v))
        used = min(k, len(same) - 1)
        radius = same[used]
        gaps = np.abs(x - v)
        inside = np.sum(gaps < radius) if radius > 0 else np.sum(gaps == 0)
        total += (psi(used) - psi(len(same)) - psi(int(inside))) / len(x)
    return max(0.0, total)


@pytest.mark.parametrize("kind", ["distinct", "grid", "hot"])
def test_neighbour_information_matches_brute_force(spark, kind):
    rng = np.random.default_rng(7)
    n = 400
    y = rng.choice(["a", "a", "a", "b", "c"], n)
    x = rng.normal(size=n) + (y == "b") * 2
    if kind == "grid":
        x = np.round(x * 8) / 8
    if kind == "hot":
        x = np.where(rng.random(n) < 0.4, 0.5, np.round(x * 16) / 16)
    y[0] = "single"
    df = spark.createDataFrame([(float(a), str(b)) for a, b in zip(x, y)], "x double, label string")
    got = neighbour_information(df, "label", ["x"], 3, slices=8).collect()[0]["mutual_info_classif"]
    assert got == pytest.approx(brute_information(x, y, 3), abs=1e-9)


def test_top_k_ties_and_nulls(spark):
    rows = [("a", "l", 1.0), ("b", "l", 2.0), ("c", "l", 2.0), ("d", "l", None)]
    scores = spark.createDataFrame(rows, "feature string, label string, chi2 double")
    top2 = ranking.top_per_label(scores, 2, columns=["chi2"]).orderBy("rank").collect()
    top4 = ranking.top_per_label(scores, 4, columns=["chi2"]).orderBy("rank").collect()
    assert [r["feature"] for r in top2] == ["b", "c"] and [r["feature"] for r in top4] == ["b", "c", "a", "d"]


def test_last_value_skips_nulls(spark):
    log = spark.createDataFrame([("p", "t", 1, 1.0, 1), ("p", "t", 2, None, 2)], "participant string, tag string, step int, value double, ts int")
    assert reports.last_values(log, ["participant", "tag"]).collect()[0]["value"] == 1.0


def test_histogram_of_a_constant_and_top_edge(spark):
    rows = reports.histogram(spark.createDataFrame([(float(i),) for i in range(11)], "x double"), "x", 5).orderBy("bin").collect()
    assert [r["n_rows"] for r in rows] == [2, 2, 2, 2, 3]
    flat = reports.histogram(spark.createDataFrame([(2.0,), (2.0,)], "x double"), "x", 4).orderBy("bin").collect()
    assert sum(r["n_rows"] for r in flat) == 2 and flat[0]["left_edge"] == 1.5


def test_macro_metrics_leave_out_absent_classes(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "label int, prediction int")
    row = reports.macro_metrics(reports.confusion(df, "label", "prediction", [0, 1, 2])).collect()[0]
    assert row["recall"] == pytest.approx(0.75) and row["precision"] == pytest.approx(0.75) and row["f1"] == pytest.approx(2 / 3)


def test_training_set_codes_and_unknown_label(spark):
    from sensorloom.plans.training_set import clean_training_set

    rows = [(1.0, 5.0, "1_normal"), (3.0, None, "9_xmrig"), (2.0, 6.0, "9_xmrig"), (4.0, 7.0, None)]
    fused = spark.createDataFrame(rows, "x double, other double, label string")
    out = clean_training_set(fused, ["x"], seed=1).collect()
    assert sorted((r["x"], r["label"]) for r in out) == [(0.0, 0), (1.0, 8)]
    wide = clean_training_set(fused, ["x"], dropna_scope="selected").count()
    assert wide == 3 and len(LABELS) == 9
    with pytest.raises(Exception, match="unknown value"):
        clean_training_set(fused.fillna("new", ["label"]), ["x"], dropna_scope="selected").collect()
    with pytest.raises(ValueError, match="missing"):
        clean_training_set(fused, ["x", "absent"], strict=True)


def test_recursive_elimination_keeps_the_informative_feature(spark):
    from sensorloom.operators import models

    rng = np.random.default_rng(8)
    rows = [(float(y + rng.normal(0, 0.05)), float(rng.random()), float(rng.random()), int(y)) for y in rng.integers(0, 2, 200)]
    df = spark.createDataFrame(rows, "good double, noise1 double, noise2 double, label int")
    kept, dropped = models.eliminate_recursively(df, ["good", "noise1", "noise2"], keep=1, step=1, max_iter=15)
    assert kept == ["good"] and len(dropped) == 2
    weights = models.class_weights(models.fit_linear(models.assembled(df, ["good", "noise1"]), max_iter=15), df, ["good", "noise1"])
    assert ranking.top_weights(weights, 1, "abs").collect()[0]["feature"] == "good"
    assert math.isclose(weights.count(), 4)


def test_elimination_by_bounds_equals_refits_without_the_features(spark):
    from pyspark.ml.classification import LogisticRegression

    from sensorloom.operators import models

    rng = np.random.default_rng(5)
    rows = [(*map(float, rng.normal(size=4) + np.array([1, 0.5, 0, 0.2]) * y), int(y)) for y in rng.integers(0, 3, 300)]
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, label int")
    bounded = models.fit_without(models.assembled(df, names), 4, [1, 3], 3).coefficientMatrix.toArray()
    plain = LogisticRegression(family="multinomial", standardization=False, maxIter=150, regParam=1e-4, tol=1e-6).fit(
        models.assembled(df, ["a", "c"])).coefficientMatrix.toArray()
    assert (bounded[:, [1, 3]] == 0).all()
    centred = bounded[:, [0, 2]] - bounded[:, [0, 2]].mean(axis=0)
    assert centred == pytest.approx(plain - plain.mean(axis=0), abs=2e-2)
    kept, dropped = models.eliminate_recursively(df, names, keep=1, max_iter=30)
    assert [n for n, _ in dropped] == [1, 2, 3] and kept == ["a"]


def test_the_best_round_is_kept_and_need_not_be_the_last(spark):
    from sensorloom.operators import models

    rng = np.random.default_rng(7)
    x = rng.normal(size=(120, 6))
    y = (x[:, 0] + rng.normal(size=120) * 1.2 > 0).astype(int)
    rows = [(*map(float, v), int(c)) for v, c in zip(x, y)]
    df = models.assembled(spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double, label int"), list("abcdef")).coalesce(1).cache()
    train, held = df.filter("a > -9").limit(70).cache(), df.subtract(df.limit(70)).cache()
    done = models.fit_best(train, held, 6, 2, max_iter=100, round_iter=5)
    assert done.best_round < len(done.accuracies) <= 20
    assert done.accuracies[done.best_round - 1] == max(done.accuracies) and done.best_round == 1 + done.accuracies.index(max(done.accuracies))
    assert models.accuracy(done.model, held) == max(done.accuracies)
    short = models.fit_best(train, held, 6, 2, hidden=(), max_iter=12, round_iter=5, patience=2)
    assert 1 <= len(short.accuracies) <= 3 and len(short.model.weights) == 6 * 2 + 2


def test_lookup_beyond_the_broadcast_limit_gives_the_same_rows(spark, monkeypatch):
    from sensorloom.operators import lookup

    rows = spark.range(1000).withColumn("k", F.when(F.col("id") < 400, 0).otherwise(F.col("id") % 7))
    table = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    small = lookup.join_lookup(rows, table, ["k"])
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 1)
    salted = lookup.join_lookup(rows, table, ["k"])
    assert salted.columns == small.columns and salted.exceptAll(small).isEmpty() and salted.count() == small.count()


def test_strict_numbers_raise_and_lenient_ones_become_null(spark):
    df = spark.createDataFrame([("1.5", "x"), ("oops", "y")], "v string, keep string")
    assert [r["v"] for r in cleaning.to_numeric(df, ["keep"], lenient=True).collect()] == [1.5, None]
    with pytest.raises(Exception):
        cleaning.to_numeric(df, ["keep"]).collect()
