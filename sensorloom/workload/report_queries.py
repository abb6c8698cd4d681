"""Count, summary, histogram, experiment and metric queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sensorloom.operators import reports
from sensorloom.operators.quantiles import feature_quantiles
from sensorloom.session import STORED, ensure_checkpoint_dir
from sensorloom.streaming.live_metrics import current_values, take_new_metrics
from sensorloom.workload.registry import query, r, rounded

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("label_distribution", "SELECT event_type, count(*) AS n_rows FROM events GROUP BY 1")
def label_distribution(t):
    """A12, A13."""
    return reports.counts_by(t.events, "event_type")


@query("counts_by_group", "SELECT lang, source, count(*) AS n_rows FROM documents GROUP BY ALL")
def counts_by_group(t):
    """A12 over two keys."""
    return reports.counts_by(t.documents, "lang", "source")


@query(
    "availability_pivot",
    "SELECT c_nationkey, " + ", ".join(
        f"count(*) FILTER (WHERE c_mktsegment = '{s}') AS {s}" for s in ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    ) + " FROM customer GROUP BY 1",
)
def availability_pivot(t):
    """A14 on customer segments."""
    return reports.availability(
        t.customer, ["c_nationkey"], "c_mktsegment", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    )


LAST_SQL = """last AS (SELECT user_id AS participant, event_type AS tag, arg_max(value, (ts, event_id)) AS value
    FROM events WHERE event_type LIKE 's%' OR event_type LIKE 'e%' OR event_type LIKE 'c%' GROUP BY ALL)"""


def metric_log(t):
    prefixed = F.when(F.col("event_type").isin("signup", "error", "click"), F.concat(F.lit("Test/"), "event_type")).otherwise(
        F.concat(F.lit("Train/"), "event_type")
    )
    return t.events.select(
        F.col("user_id").alias("participant"), prefixed.alias("tag"), F.col("event_id").alias("step"), "value", "ts"
    )


@query(
    "experiment_rollup",
    f"""WITH {LAST_SQL} SELECT 'Test/' || tag AS tag, round_even(avg(value), 4) AS mean_value, round_even(stddev_samp(value), 2) AS std_value,
    count(*) AS n_participants FROM last GROUP BY tag""",
)
def experiment_rollup(t):
    """Last value per participant and tag, then mean and deviation over participants."""
    return reports.experiment_rollup(metric_log(t))


LIVE_SCHEMA = "participant long, tag string, step long, value double, ts timestamp_ntz, file_ts timestamp_ntz"


@query(
    "experiment_rollup_live",
    f"""WITH {LAST_SQL} SELECT 'Test/' || tag AS tag, round_even(avg(value), 4) AS mean_value, round_even(stddev_samp(value), 2) AS std_value,
    count(*) AS n_participants FROM last GROUP BY tag""",
)
def experiment_rollup_live(t):
    """The same rollup from a file stream that takes the log in three arrivals, the oldest part last."""
    ensure_checkpoint_dir(t.spark)
    folder = f"{t.spark.sparkContext.getCheckpointDir()}/tables/live-{uuid.uuid4().hex}"
    STORED.append(folder)
    log = metric_log(t).withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("file_ts", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    for part in (1, 2, 0):
        log.filter(F.day("ts") % 3 == part).write.mode("append").parquet(f"{folder}/log")
        take_new_metrics(t.spark, f"{folder}/log", LIVE_SCHEMA, f"{folder}/values", f"{folder}/offsets")
    return reports.experiment_rollup(current_values(t.spark, f"{folder}/values"), order=["value"])


@query("run_means", "SELECT event_type AS tag, round_even(avg(value), 4) AS mean_value FROM events GROUP BY 1")
def run_means(t):
    """A17."""
    return reports.run_means(t.events.select(F.col("event_type").alias("tag"), "value"))


@query(
    "feature_quantiles",
    f"""WITH u AS (UNPIVOT (SELECT {', '.join(MEASURES)} FROM lineitem) ON {', '.join(MEASURES)} INTO NAME feature VALUE x)
    SELECT feature, count(*) AS n, {', '.join(r(f'quantile_cont(x, {p})') + f' AS q{i}' for i, p in enumerate([0.01, 0.1, 0.5, 0.9, 0.99]))}
    FROM u GROUP BY feature""",
)
def feature_quantiles_(t):
    """Exact quantiles of whole columns by bracketing, shared by P16, A20 and F4."""
    return rounded(feature_quantiles(t.lineitem, MEASURES, [0.01, 0.1, 0.5, 0.9, 0.99]), 6, [f"q{i}" for i in range(5)])


def box_sql(source: str, ids: str, keys: str) -> str:
    return f"""WITH u AS ({source}),
    q AS (SELECT {keys}, min(x) AS lo, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q75, max(x) AS hi FROM u GROUP BY ALL)
    SELECT {', '.join('q.' + k.strip() for k in keys.split(','))}, {', '.join(f"{r(f'any_value({c})')} AS {c}" for c in ['lo', 'q25', 'median', 'q75', 'hi'])},
    {r('min(x) FILTER (WHERE x >= q25 - 1.5 * (q75 - q25))')} AS whisker_lo, {r('max(x) FILTER (WHERE x <= q75 + 1.5 * (q75 - q25))')} AS whisker_hi,
    count(*) FILTER (WHERE x < q25 - 1.5 * (q75 - q25) OR x > q75 + 1.5 * (q75 - q25)) AS n_outliers
    FROM u JOIN q USING ({keys}) GROUP BY {', '.join('q.' + k.strip() for k in keys.split(','))}"""


BOX = ["lo", "q25", "median", "q75", "hi", "whisker_lo", "whisker_hi"]


@query("box_summary_by_label", box_sql("SELECT event_type, 'value' AS feature, value AS x FROM events", "event_type", "event_type, feature"))
def box_summary_by_label(t):
    """Box-plot numbers per feature and label."""
    return rounded(reports.box_summary(t.events, ["value"], ["event_type"]), 6, BOX)


@query(
    "box_summary",
    box_sql(f"UNPIVOT (SELECT {', '.join(MEASURES)} FROM lineitem) ON {', '.join(MEASURES)} INTO NAME feature VALUE x", "", "feature"),
)
def box_summary(t):
    """Box-plot numbers per feature."""
    return rounded(reports.box_summary(t.lineitem, MEASURES), 6, BOX)


@query(
    "histogram",
    f"""WITH e AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 20 AS w FROM lineitem),
    c AS (SELECT least(floor((l_extendedprice - lo) / w), 19)::INT AS bin, count(*) AS n FROM lineitem, e GROUP BY 1)
    SELECT b.bin, {r('lo + w * b.bin')} AS left_edge, coalesce(n, 0) AS n_rows FROM (SELECT unnest(generate_series(0, 19))::INT AS bin) b LEFT JOIN c USING (bin), e""",
)
def histogram(t):
    """20 equal-width bins, the top edge in the last one."""
    return rounded(reports.histogram(t.lineitem, "l_extendedprice", 20), 6, ["left_edge"])


@query(
    "distinct_counts",
    "SELECT count(DISTINCT user_id) AS n_user_id, count(DISTINCT event_type) AS n_event_type, count(DISTINCT props) AS n_props FROM events",
)
def distinct_counts(t):
    """A23."""
    return reports.distinct_counts(t.events, ["user_id", "event_type", "props"])


@query(
    "quality_report",
    """SELECT 'n_event_type' AS "check", count(DISTINCT event_type) AS found, 5::BIGINT AS expected, count(DISTINCT event_type) = 5 AS ok FROM events
    UNION ALL SELECT 'n_user_id', count(DISTINCT user_id), 9::BIGINT, count(DISTINCT user_id) = 9 FROM events""",
)
def quality_report(t):
    """Distinct counts against expected numbers."""
    return reports.quality_report(t.events, {"event_type": 5, "user_id": 9})


def judged(t):
    predicted = F.when(F.col("n_chars") > 1200, 1).otherwise(0)
    return t.documents.join(t.labels, "doc_id").select(F.col("quality").alias("label"), predicted.alias("prediction"))


JUDGED_SQL = """j AS (SELECT quality AS label, CASE WHEN n_chars > 1200 THEN 1 ELSE 0 END AS prediction FROM documents JOIN labels USING (doc_id)),
    cells AS (SELECT l.label, p.prediction, count(j.label) AS n FROM (SELECT unnest([0, 1, 2])::INT AS label) l CROSS JOIN (SELECT unnest([0, 1, 2])::INT AS prediction) p
      LEFT JOIN j ON j.label = l.label AND j.prediction = p.prediction GROUP BY ALL)"""


@query("confusion_matrix", f"WITH {JUDGED_SQL} SELECT * FROM cells")
def confusion_matrix(t):
    """M6: all cells, also of a class that never occurs."""
    return reports.confusion(judged(t), "label", "prediction", [0, 1, 2])


CLASS_SQL = f"""{JUDGED_SQL}, k AS (SELECT a.label, (SELECT sum(n) FROM cells WHERE label = a.label)::BIGINT AS support,
    (SELECT sum(n) FROM cells WHERE prediction = a.label)::BIGINT AS predicted, (SELECT n FROM cells WHERE label = a.label AND prediction = a.label) AS tp
    FROM (SELECT DISTINCT label FROM cells) a),
    cm AS (SELECT *, coalesce(tp / nullif(predicted, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(support, 0)::DOUBLE, 0) AS recall,
    coalesce(2.0 * tp / nullif(predicted + support, 0)::DOUBLE, 0) AS f1 FROM k)"""


@query("class_metrics", f"WITH {CLASS_SQL} SELECT label, support, predicted, tp, {r('precision')} AS precision, {r('recall')} AS recall, {r('f1')} AS f1 FROM cm")
def class_metrics(t):
    """M5 per class."""
    cells = reports.confusion(judged(t), "label", "prediction", [0, 1, 2])
    return rounded(reports.class_metrics(cells), 6, ["precision", "recall", "f1"]).withColumn("tp", F.col("tp").cast("long"))


@query(
    "macro_metrics",
    f"""WITH {CLASS_SQL} SELECT {r('avg(recall)')} AS accuracy, {r('avg(precision)')} AS precision, {r('avg(recall)')} AS recall, {r('avg(f1)')} AS f1
    FROM cm WHERE support > 0 OR predicted > 0""",
)
def macro_metrics(t):
    """M5: unweighted class means."""
    cells = reports.confusion(judged(t), "label", "prediction", [0, 1, 2])
    return rounded(reports.macro_metrics(cells), 6, ["accuracy", "precision", "recall", "f1"])
