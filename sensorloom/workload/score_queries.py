"""Feature score, ranking, selection and weight queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.operators import ranking, reports, reshape, scoring
from sensorloom.operators.neighbors import neighbour_information
from sensorloom.operators.network import INTERVAL_FEATURES, LENGTH_FEATURES
from sensorloom.plans.feature_selection import ABLATION_WIDTHS as FEATURE_WIDTHS, ablation_top, network_width_ablation, select_univariate
from sensorloom.session import materialise
from sensorloom.workload.registry import query, r, rounded
from sensorloom.workload.time_queries import PACKET_COLUMNS, network_sql, packets

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LABEL = "l_returnflag"
CLASSES = ["A", "N", "R"]

# Shared SQL: narrow form, per-class moments, decile bins.
MOMENTS_SQL = """m AS (SELECT feature, label, count(*)::DOUBLE AS n, sum(x) AS s, avg(x) AS mean, var_pop(x) AS v FROM long GROUP BY ALL),
    a AS (SELECT feature, count(*)::DOUBLE AS n_all, sum(x) AS s_all, avg(x) AS mean_all, var_pop(x) AS v_all FROM long GROUP BY feature)"""


def long_sql(source: str, features: list[str]) -> str:
    """Narrow form of ``source`` (label and feature columns) and its moments."""
    return f"long AS (UNPIVOT ({source}) ON {', '.join(features)} INTO NAME feature VALUE x), {MOMENTS_SQL}"


def scaled_sql(source: str, features: list[str]) -> str:
    """All features of ``source`` min-max-scaled; a constant one is null and so gives no row of the narrow form."""
    scaled = ", ".join(f"({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0) AS {c}" for c in features)
    return f"SELECT label, {scaled} FROM ({source})"


ITEMS_SQL = f"SELECT {LABEL} AS label, {', '.join(FEATURES)} FROM lineitem"
LONG_SQL = long_sql(ITEMS_SQL, FEATURES)
CHI_SQL = "sum((s - n / n_all * s_all) ** 2 / (n / n_all * s_all))"
F_SQL = "(sum(n * (mean - mean_all) ** 2) / (count(*) - 1)) / (sum(n * v) / (max(n_all) - count(*)))"
ONE_SQL = f"""one AS (SELECT feature, label,
      (s - n / n_all * s_all) ** 2 / (n / n_all * s_all)
      + ((s_all - s) - (n_all - n) / n_all * s_all) ** 2 / ((n_all - n) / n_all * s_all) AS chi2,
      (n * (mean - mean_all) ** 2 + (n_all - n) * ((s_all - s) / (n_all - n) - mean_all) ** 2)
      / ((n_all * v_all - n * (mean - mean_all) ** 2 - (n_all - n) * ((s_all - s) / (n_all - n) - mean_all) ** 2) / (n_all - 2)) AS f_classif
      FROM m JOIN a USING (feature))"""


def bins_sql(bins: int = 10) -> str:
    probs = [i / bins for i in range(1, bins)]
    return f"""edges AS (SELECT feature, quantile_cont(x, {probs}) AS e FROM long GROUP BY feature),
    binned AS (SELECT feature, label, len(list_filter(e, lambda q: q < x)) AS bin FROM long JOIN edges USING (feature)),
    cells AS (SELECT feature, label, bin, count(*)::DOUBLE AS n FROM binned GROUP BY ALL),
    full_ AS (SELECT f.feature, l.label, b.bin FROM (SELECT DISTINCT feature FROM cells) f, (SELECT DISTINCT label FROM cells) l,
      (SELECT DISTINCT feature, bin FROM cells) b WHERE b.feature = f.feature),
    tab AS (SELECT full_.*, coalesce(n, 0) AS n FROM full_ LEFT JOIN cells USING (feature, label, bin)),
    t2 AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS na, sum(n) OVER (PARTITION BY feature, bin) AS nb,
      sum(n) OVER (PARTITION BY feature, label) AS nl FROM tab),
    mi AS (SELECT feature, greatest(sum(CASE WHEN n > 0 THEN n / na * ln(n * na / (nb * nl)) ELSE 0 END), 0) AS mutual_info_classif FROM t2 GROUP BY feature),
    mi1 AS (SELECT feature, label, greatest(sum(CASE WHEN n > 0 THEN n / na * ln(n * na / (nb * nl)) ELSE 0 END
      + CASE WHEN nb > n THEN (nb - n) / na * ln((nb - n) * na / (nb * (na - nl))) ELSE 0 END), 0) AS mutual_info_classif FROM t2 GROUP BY ALL)"""


SCORES_SQL = f"{LONG_SQL}, {ONE_SQL}, {bins_sql()}, scores AS (SELECT feature, label, chi2, f_classif, mutual_info_classif FROM one JOIN mi1 USING (feature, label))"
SCORE_OUT = f"{r('chi2', 4)} AS chi2, {r('f_classif')} AS f_classif, {r('mutual_info_classif', 9)} AS mutual_info_classif"


def shown(df):
    return rounded(rounded(rounded(df, 4, ["chi2"]), 6, ["f_classif"]), 9, ["mutual_info_classif"])


def label_scores(t):
    """The score table as the ranking job writes it; later steps read it several times."""
    return materialise(scoring.feature_scores_by_label(t.lineitem, LABEL, FEATURES))


def fresh_scores(t):
    return scoring.feature_scores_by_label(t.lineitem, LABEL, FEATURES)


@query(
    "class_moments",
    f"WITH {LONG_SQL} SELECT m.feature, label, n::BIGINT AS n, {r('s', 2)} AS s, {r('mean')} AS mean, {r('v', 4)} AS var FROM m",
)
def class_moments(t):
    """A-base: one narrow aggregation per (feature, label)."""
    return rounded(rounded(rounded(scoring.class_moments(t.lineitem, LABEL, FEATURES).drop("lo", "hi"), 2, ["s"]), 6, ["mean"]), 4, ["var"])


@query(
    "feature_scores",
    f"WITH {LONG_SQL}, {bins_sql()}, c AS (SELECT feature, {CHI_SQL} AS chi2, {F_SQL} AS f_classif FROM m JOIN a USING (feature) GROUP BY feature)"
    f" SELECT feature, {SCORE_OUT} FROM c JOIN mi USING (feature)",
)
def feature_scores(t):
    """chi2, F and mutual information over all classes."""
    return shown(scoring.feature_scores(t.lineitem, LABEL, FEATURES))


GAP_ITEMS_SQL = f"""SELECT {LABEL} AS label, CASE WHEN l_partkey % 5 <> 0 THEN l_quantity END AS l_quantity,
    CASE WHEN l_suppkey % 3 <> 0 THEN l_extendedprice END AS l_extendedprice, l_discount, l_tax FROM lineitem"""


@query(
    "feature_scores_with_gaps",
    f"WITH {long_sql(GAP_ITEMS_SQL, FEATURES)}, {bins_sql()}, c AS (SELECT feature, {CHI_SQL} AS chi2, {F_SQL} AS f_classif FROM m JOIN a USING (feature) GROUP BY feature)"
    f" SELECT feature, {SCORE_OUT} FROM c JOIN mi USING (feature)",
)
def feature_scores_with_gaps(t):
    """F2-F4 on columns with nulls and NaN: missing values count nowhere."""
    rows = t.lineitem.withColumn("l_quantity", F.expr("IF(l_partkey % 5 <> 0, l_quantity, IF(l_partkey % 2 = 0, NULL, double('NaN')))"))
    rows = rows.withColumn("l_extendedprice", F.expr("IF(l_suppkey % 3 <> 0, l_extendedprice, double('NaN'))"))
    return shown(scoring.feature_scores(rows, LABEL, FEATURES))


@query("feature_scores_by_label", f"WITH {SCORES_SQL} SELECT feature, label, {SCORE_OUT} FROM scores")
def feature_scores_by_label(t):
    """every label against the rest."""
    return shown(fresh_scores(t))


@query("information_gain", f"WITH {LONG_SQL}, {bins_sql()} SELECT feature, {r('mutual_info_classif', 9)} AS mutual_info_classif FROM mi ORDER BY mi.mutual_info_classif DESC")
def information_gain(t):
    """F6."""
    return shown(scoring.information_gain(t.lineitem, LABEL, FEATURES))


@query(
    "rank_features",
    f"WITH {long_sql(scaled_sql(ITEMS_SQL, FEATURES), FEATURES)}, {ONE_SQL}, {bins_sql()} SELECT feature, label, {SCORE_OUT} FROM one JOIN mi1 USING (feature, label)",
)
def rank_features(t):
    """F8: scale, drop constant columns, score; the whole ranking job of one source."""
    rows = t.lineitem.select(LABEL, *FEATURES, F.lit(3.0).alias("same"))
    return shown(scoring.rank_features(rows, LABEL, FEATURES + ["same"]))


@query(
    "mean_scores",
    f"WITH {SCORES_SQL} SELECT feature, {r('avg(chi2)', 4)} AS chi2, {r('avg(f_classif)')} AS f_classif, {r('avg(mutual_info_classif)', 9)} AS mutual_info_classif FROM scores GROUP BY feature",
)
def mean_scores(t):
    """Mean over the labels."""
    return shown(reports.mean_scores(label_scores(t), scoring.SCORES))


@query(
    "scores_sorted_by_mean",
    f"WITH {SCORES_SQL} SELECT feature, label, {r('(chi2 + f_classif + mutual_info_classif) / 3', 4)} AS mean_score FROM scores",
)
def scores_sorted_by_mean(t):
    """K2."""
    return rounded(ranking.sorted_by_mean(label_scores(t)), 4, ["mean_score"]).select("feature", "label", "mean_score")


TOP_SQL = """sl AS (UNPIVOT scores ON chi2, f_classif, mutual_info_classif INTO NAME score_type VALUE score),
    top AS (SELECT *, row_number() OVER (PARTITION BY label, score_type ORDER BY score DESC NULLS LAST, feature) AS rank FROM sl QUALIFY rank <= 2)"""


@query("top_features_per_label", f"WITH {SCORES_SQL}, {TOP_SQL} SELECT label, feature, score_type, rank::INT AS rank, {r('score', 4)} AS score FROM top")
def top_features_per_label(t):
    """K3: best features per label and score."""
    return rounded(ranking.top_per_label(label_scores(t), 2), 4, ["score"])


@query("best_feature", f"WITH {SCORES_SQL} SELECT feature, label, {SCORE_OUT} FROM scores ORDER BY scores.chi2 DESC, feature LIMIT 1")
def best_feature(t):
    """K4."""
    return shown(ranking.best_feature(label_scores(t), "chi2"))


SCORE_TABLE_SQL = """tagged AS (SELECT *, 'SYS_x' || CASE WHEN feature = 'l_tax' THEN '2' ELSE '1' END AS data_source, label = 'N' AS is_robust FROM scores
    UNION ALL SELECT *, 'SYS_x2', false FROM scores UNION ALL SELECT *, 'old', false FROM scores)"""


def score_table(t):
    s = label_scores(t)
    first = s.withColumn("data_source", F.when(F.col("feature") == "l_tax", "SYS_x2").otherwise("SYS_x1")).withColumn("is_robust", F.col("label") == "N")
    pair = s.withColumn("data_source", F.lit("SYS_x2")).withColumn("is_robust", F.lit(False))
    return first.unionByName(pair).unionByName(pair.withColumn("data_source", F.lit("old")))


FILTER_SQL = f"""{SCORE_TABLE_SQL}, kept AS (SELECT * FROM tagged WHERE NOT is_robust),
    f AS (SELECT * FROM kept k WHERE data_source <> 'old' AND NOT (data_source = 'SYS_x2' AND EXISTS
    (SELECT 1 FROM kept s WHERE s.data_source = 'SYS_x1' AND s.feature = k.feature)))"""


@query("score_table_filtered", f"WITH {SCORES_SQL}, {FILTER_SQL} SELECT feature, label, data_source FROM f")
def score_table_filtered(t):
    """Non-robust runs, no pair terms known as single terms, no dropped sources."""
    return ranking.filter_score_table(score_table(t), ["old"], "SYS_x1", "SYS_x2").select("feature", "label", "data_source")


@query(
    "univariate_selection",
    f"""WITH {SCORES_SQL}, {FILTER_SQL}, sl AS (UNPIVOT (SELECT feature, label, chi2, f_classif, mutual_info_classif FROM f)
      ON chi2, f_classif, mutual_info_classif INTO NAME score_type VALUE score)
    SELECT DISTINCT feature FROM (SELECT *, row_number() OVER (PARTITION BY label, score_type ORDER BY score DESC, feature) AS rk FROM sl) WHERE rk <= 1""",
)
def univariate_selection(t):
    """filters, top k of every label and score, union."""
    return select_univariate(score_table(t), 1, None, ["old"], "SYS_x1", "SYS_x2")


SCALED_SQL = "sc3 AS (SELECT feature, label, " + ", ".join(
    f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) AS {c}" for c in scoring.SCORES
) + " FROM scores)"


@query(
    "score_heatmap",
    f"WITH {SCORES_SQL}, {SCALED_SQL} SELECT feature, "
    + ", ".join(r(f"max(f_classif) FILTER (WHERE label = '{c}')") + f" AS {c}" for c in CLASSES) + " FROM sc3 GROUP BY feature",
)
def score_heatmap(t):
    """R2: one scaled score as feature x label."""
    return rounded(reshape.score_heatmap(label_scores(t), "f_classif", CLASSES), 6, CLASSES)


@query(
    "feature_heatmap",
    f"WITH {SCORES_SQL}, {SCALED_SQL}, u AS (UNPIVOT sc3 ON chi2, f_classif, mutual_info_classif INTO NAME score_type VALUE v) SELECT score_type, "
    + ", ".join(r(f"max(v) FILTER (WHERE label = '{c}')") + f" AS {c}" for c in CLASSES) + " FROM u WHERE feature = 'l_tax' GROUP BY score_type",
)
def feature_heatmap(t):
    """Score type x label of one feature."""
    return rounded(reshape.feature_heatmap(label_scores(t), "l_tax", CLASSES), 6, CLASSES)


PROFILE_OUT = ", ".join(f"{r(c)} AS {c}" for c in scoring.SCORES) + f", {r('(chi2 + f_classif + mutual_info_classif) / 3')} AS mean_score"


@query("score_profile", f"WITH {SCORES_SQL}, {SCALED_SQL} SELECT feature, label, {PROFILE_OUT} FROM sc3")
def score_profile(t):
    """Scaled scores as line table."""
    return rounded(reshape.score_profile(label_scores(t)), 6, scoring.SCORES + ["mean_score"])


@query(
    "score_profile_one_feature",
    f"WITH {SCORES_SQL}, {SCALED_SQL.replace('FROM scores', chr(10) + 'FROM scores WHERE feature = ' + chr(39) + 'l_discount' + chr(39))} SELECT feature, label, {PROFILE_OUT} FROM sc3",
)
def score_profile_one_feature(t):
    """R4, single feature: scaled after the filter."""
    return rounded(reshape.score_profile(label_scores(t), "l_discount"), 6, scoring.SCORES + ["mean_score"])


@query(
    "top_profile_by_label",
    f"WITH {SCORES_SQL}, {SCALED_SQL.replace('OVER ()', 'OVER (PARTITION BY label)')} SELECT feature, label, {PROFILE_OUT} FROM sc3",
)
def top_profile_by_label(t):
    """Scaled within each label, duplicates removed."""
    s = label_scores(t)
    return rounded(reshape.top_profile_by_label(s.unionByName(s)), 6, scoring.SCORES + ["mean_score"])


@query(
    "wide_to_long",
    "SELECT l_orderkey, l_linenumber, l_partkey, variable, value FROM (UNPIVOT (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_tax FROM lineitem) ON l_quantity, l_tax INTO NAME variable VALUE value)",
)
def wide_to_long(t):
    """R1."""
    return reshape.wide_to_long(t.lineitem, ["l_orderkey", "l_linenumber", "l_partkey"], ["l_quantity", "l_tax"])


@query(
    "scores_in_listed_order",
    f"WITH {SCORES_SQL} SELECT feature, label, {r('chi2', 4)} AS chi2 FROM scores WHERE feature IN ('l_tax', 'l_quantity')",
)
def scores_in_listed_order(t):
    """Scores of the features another table lists, in its order."""
    s = label_scores(t)
    listed = s.filter(F.col("feature").isin("l_tax", "l_quantity")).withColumn("pos", F.col("label"))
    return rounded(ranking.in_order_of(s, listed, ["pos", "feature"]).select("feature", "label", "chi2"), 4, ["chi2"])


NEIGHBOURS_SQL = f"""WITH l AS (SELECT 'value' AS feature, event_type AS label, round(value * 100) AS x, event_id FROM events
      UNION ALL SELECT 'user_id', event_type, user_id::DOUBLE, event_id FROM events),
    g AS (SELECT *, count(*) OVER (PARTITION BY feature, label) AS nc, list_sort(list_filter([{', '.join(
        f"x - lag(x, {i}) OVER w, lead(x, {i}) OVER w - x" for i in (1, 2, 3))}], lambda d: d IS NOT NULL))[3] AS rad
      FROM l WINDOW w AS (PARTITION BY feature, label ORDER BY x, event_id)),
    a AS (SELECT feature, x, rad, nc, count(*) AS c FROM g GROUP BY ALL), b AS (SELECT feature, x, count(*) AS c FROM l GROUP BY ALL),
    m AS (SELECT a.feature, a.x, a.rad, a.nc, any_value(a.c) AS c, sum(b.c)::BIGINT AS m FROM a JOIN b
      ON a.feature = b.feature AND (abs(b.x - a.x) < a.rad OR b.x = a.x) GROUP BY ALL),
    psi AS (SELECT i, coalesce(sum(1.0::DOUBLE / i) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 0.5772156649015329::DOUBLE AS p
      FROM (SELECT unnest(generate_series(1, (SELECT count(*) FROM events))) AS i)),
    s AS (SELECT feature, sum(c) AS n, sum(c * (SELECT p FROM psi WHERE i = 3)) - sum(c * p1.p) - sum(c * p2.p) AS t
      FROM m JOIN psi p1 ON p1.i = nc JOIN psi p2 ON p2.i = m GROUP BY feature)
    SELECT feature, {r('greatest(psi.p + t / n, 0)', 9)} AS mutual_info_classif FROM s JOIN psi ON psi.i = n"""


@query("information_neighbours", NEIGHBOURS_SQL)
def information_neighbours(t):
    """F4, second form: nearest-neighbour estimate over the whole events table."""
    cents = F.round(F.col("value") * 100).alias("value")
    rows = t.events.select("event_type", cents, F.col("user_id").cast("double").alias("user_id"))
    return rounded(neighbour_information(rows, "event_type", ["value", "user_id"]), 9, ["mutual_info_classif"])


LABEL_NEIGHBOURS_SQL = NEIGHBOURS_SQL.replace("WITH l AS (", "WITH l0 AS (", 1).replace(
    "UNION ALL SELECT 'user_id', event_type, user_id::DOUBLE, event_id FROM events),",
    """UNION ALL SELECT 'user_id', event_type, user_id::DOUBLE, event_id FROM events),
    l AS (SELECT l0.feature || '@' || k.one AS feature, (l0.label = k.one)::VARCHAR AS label, x, event_id FROM l0, (SELECT DISTINCT event_type AS one FROM events) k),""", 1,
)


KNN_SQL = LABEL_NEIGHBOURS_SQL.replace(
    "SELECT feature, (round", "SELECT split_part(feature, '@', 1) AS feature, split_part(feature, '@', 2) AS label, (round")
CENTS_SQL = "SELECT event_type AS label, round(value * 100) AS value, user_id::DOUBLE AS user_id FROM events"


@query(
    "rank_features_knn",
    f"""SELECT o.*, k.mutual_info_classif FROM (WITH {long_sql(scaled_sql(CENTS_SQL, ["value", "user_id"]), ["value", "user_id"])}, {ONE_SQL}
    SELECT feature, label, {r('chi2', 4)} AS chi2, {r('f_classif')} AS f_classif FROM one) o JOIN ({KNN_SQL}) k USING (feature, label)""",
)
def rank_features_knn(t):
    """F8, second form: the whole ranking job with the nearest-neighbour estimate."""
    cents = F.round(F.col("value") * 100).alias("value")
    rows = t.events.select("event_type", cents, F.col("user_id").cast("double").alias("user_id"))
    return shown(scoring.rank_features(rows, "event_type", ["value", "user_id"], method="knn"))


@query("feature_scores_by_label_knn", KNN_SQL)
def feature_scores_by_label_knn(t):
    """F5, second form: every label against the rest by nearest neighbours."""
    cents = F.round(F.col("value") * 100).alias("value")
    rows = t.events.select("event_type", cents, F.col("user_id").cast("double").alias("user_id"))
    scores = scoring.feature_scores_by_label(rows, "event_type", ["value", "user_id"], method="knn")
    return rounded(scores.select("feature", "label", "mutual_info_classif"), 9, ["mutual_info_classif"])


# The seven widths of the ablation, stretched from 20 seconds to an hour as the events are that much sparser.
ABLATION_WIDTHS = [w * 180 for w in FEATURE_WIDTHS]
ABLATION_FEATURES = LENGTH_FEATURES + INTERVAL_FEATURES


def ablation_sql(widths: list[int], features: list[str], out: str) -> str:
    """The ranking SQL over the network SQL, once per width."""
    names = [f'"{c}"' for c in features]
    parts = []
    for width in widths:
        table = network_sql(width * 1_000_000, "lo", "event_type", False, None)
        known = f"SELECT event_type AS label, {', '.join(names)} FROM ({table}) WHERE {' AND '.join(f'{n} IS NOT NULL' for n in names)}"
        parts.append(
            f"SELECT {width}::INT AS width_s, * FROM (WITH {long_sql(scaled_sql(known, names), names)}, {ONE_SQL}, {bins_sql()}"
            f" SELECT feature, label, {out} FROM one JOIN mi1 USING (feature, label))"
        )
    return " UNION ALL ".join(parts)


@query("network_width_ablation", ablation_sql(ABLATION_WIDTHS, ABLATION_FEATURES, SCORE_OUT))
def network_width_ablation_(t):
    """the network ranking at several window widths in one query."""
    return shown(network_width_ablation(packets(t), "ts", "event_type", ABLATION_WIDTHS, PACKET_COLUMNS, ABLATION_FEATURES))


@query(
    "network_ablation_top",
    f"""WITH ab AS ({ablation_sql(ABLATION_WIDTHS, ABLATION_FEATURES, ', '.join(scoring.SCORES))}),
    named AS (SELECT label, feature || '@' || width_s AS feature, {', '.join(scoring.SCORES)} FROM ab),
    u AS (UNPIVOT named ON {', '.join(scoring.SCORES)} INTO NAME score_type VALUE score)
    SELECT label, feature, score_type, row_number() OVER (PARTITION BY label, score_type ORDER BY round(score, 9) DESC NULLS LAST, feature)::INT AS rank,
    {r('score', 4)} AS score FROM u QUALIFY rank <= 10""",
)
def network_ablation_top(t):
    """Best features per width, label and score, all 23 features."""
    scores = network_width_ablation(packets(t), "ts", "event_type", ABLATION_WIDTHS, PACKET_COLUMNS)
    # Equal features (for example a count under two names) differ in the last bits; they are ties.
    return rounded(ablation_top(scores.withColumns({c: F.round(c, 9) for c in scoring.SCORES}), 10), 4, ["score"])


# --- weights: per-class means of the embedding dimensions stand in for a linear layer -------

WEIGHTS_SQL = """w AS (SELECT label AS class_id, 'f' || i AS feature, avg(embedding[i]::DOUBLE) AS weight
    FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS i) WHERE i <= len(embedding) GROUP BY ALL)"""


def weights(t):
    long = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
    return long.groupBy(F.col("label").alias("class_id"), F.concat(F.lit("f"), F.col("i") + 1).alias("feature")).agg(
        F.avg(F.col("x").cast("double")).alias("weight")
    )


@query(
    "weights_ranked",
    f"WITH {WEIGHTS_SQL} SELECT class_id, feature, row_number() OVER (PARTITION BY class_id ORDER BY abs(weight) DESC, feature)::INT AS rank, {r('weight')} AS weight FROM w",
)
def weights_ranked(t):
    """Features by absolute weight within each class."""
    return rounded(ranking.ranked_weights(weights(t)), 6, ["weight"])


@query(
    "weights_top_signed",
    f"WITH {WEIGHTS_SQL} SELECT DISTINCT feature FROM (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY weight DESC, feature) AS rk FROM w) WHERE rk <= 4",
)
def weights_top_signed(t):
    """K5: union of the four largest weights of every class."""
    return ranking.top_weights(weights(t), 4)


MEAN_WEIGHT_SQL = f"""{WEIGHTS_SQL}, sw AS (SELECT feature, (weight - min(weight) OVER (PARTITION BY feature)) /
    (max(weight) OVER (PARTITION BY feature) - min(weight) OVER (PARTITION BY feature)) AS s FROM w)"""


@query("weights_mean_scaled", f"WITH {MEAN_WEIGHT_SQL} SELECT feature, {r('avg(s)')} AS mean_weight FROM sw GROUP BY feature")
def weights_mean_scaled(t):
    """M9: weights scaled per feature across classes, then averaged."""
    return rounded(ranking.mean_scaled_weights(weights(t)), 6, ["mean_weight"])


@query("weights_top_mean", f"WITH {MEAN_WEIGHT_SQL} SELECT feature, {r('avg(s)')} AS mean_weight FROM sw GROUP BY feature ORDER BY avg(s) DESC, feature LIMIT 10")
def weights_top_mean(t):
    """K6."""
    return rounded(ranking.top_mean_weights(weights(t), 10), 6, ["mean_weight"])


@query(
    "weights_threshold",
    f"""WITH {WEIGHTS_SQL}, z AS (SELECT abs(weight) AS s FROM w), c AS (SELECT min(s) AS cut FROM (SELECT s FROM z ORDER BY s DESC LIMIT 4)),
    e AS (SELECT min(s) AS lo, (max(s) - min(s)) / 32 AS d FROM z)
    SELECT {r('cut', 9)} AS cut, {r('lo + floor((cut - lo) / d) * d', 9)} AS edge_below FROM c, e""",
)
def weights_threshold(t):
    """Fourth-largest weight and the histogram edge below it."""
    return rounded(reports.weight_threshold(weights(t)), 9, ["cut", "edge_below"])
