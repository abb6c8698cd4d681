import os
import re
import sys

import pytest

import __spark_entry__ as entry
from sensorloom import session

WITHOUT_SQL = {
    "linear_classifier", "multilayer_classifier", "linear_class_weights", "weight_based_selection",
    "recursive_elimination", "pca_explained_variance", "pca_projection", "cross_device_evaluation", "width_comparison", "training_protocol",
}
SF = "/root/testdata/sf0.001"


def test_every_query_has_sql_or_is_known_to_have_none():
    names = {n for n in entry.queries() if n != "pipeline" and not re.match(r"op\d+_", n)}  # those have their own tests
    assert names - set(entry.oracle_sql()) == WITHOUT_SQL
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
@pytest.mark.parametrize("name", [
    "window_mean_series_start", "network_features_by_label", "device_merge", "iqr_filter", "feature_scores_by_label", "tfidf",
    "process_term_counts", "contiguous_shards", "clean_training_set", "high_entropy_files_by_label", "experiment_rollup",
])
def test_plans_stay_in_the_engine_and_have_no_unkeyed_window(spark, name, monkeypatch):
    plans = []

    def watched(frame):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return session.materialise(frame)

    for module in list(sys.modules.values()):
        if getattr(module, "__name__", "").startswith("sensorloom.") and module is not session and hasattr(module, "materialise"):
            monkeypatch.setattr(module, "materialise", watched)
    df = entry.queries()[name](spark, SF)
    plans.append(df._jdf.queryExecution().executedPlan().toString())
    for plan in plans:  # those of stored tables, too
        assert "Python" not in plan and "InPandas" not in plan and "CartesianProduct" not in plan
        assert "BroadcastNestedLoopJoin" not in plan
        for window, keys in re.findall(r"Window \[(.*?)\], \[(.*?)\]", plan):
            # Offsets of the partitions of an ordered table: one row per partition.
            assert keys.strip() or "_offset" in window or "_size" in window, f"window without partition keys in {name}"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
