"""Catalog, cleaning, join, set and shard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.operators import cleaning, fusion, membership, ordering, ranking, reports, scaling, shards, text
from sensorloom.operators.buckets import window_agg, window_mean
from sensorloom.operators.entropy import file_type
from sensorloom.plans.device_merge import merge_device
from sensorloom.plans.training_set import clean_training_set
from sensorloom.schema import SourceRegistry
from sensorloom.sources import catalog, tables
from sensorloom.workload.registry import query, r, rounded
from sensorloom.workload.text_queries import words_sql

DAY = 86_400_000_000
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def customer_files(t):
    """Customers as raw files: nation is the device, segment the label folder, balance the source folder."""
    source = (
        F.when(F.col("c_acctbal") < 0, "FLSYS").when(F.col("c_acctbal") < 2500, "NET")
        .when(F.col("c_acctbal") < 5000, "Entropy").when(F.col("c_acctbal") < 7500, "SYS_data").otherwise("Block")
    )
    label = (
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", "1_normal_4h").when(F.col("c_mktsegment") == "BUILDING", "1_normal")
        .when(F.col("c_mktsegment") == "FURNITURE", "5_httpbackcoor").when(F.col("c_mktsegment") == "MACHINERY", "8_bdvl")
        .otherwise("9_xmrig")
    )
    suffix = F.when(F.col("c_acctbal") >= 9000, ".txt").when(F.col("c_acctbal").between(5000, 7499.99), ".zip").otherwise(".csv")
    path = F.concat(
        F.lit("file:/data/0_raw_collected_data/Lab/device"), F.col("c_nationkey"), F.lit("/"), label, F.lit("/"), source,
        F.lit("/c_"), F.col("c_custkey"), suffix,
    )
    return t.customer.select(path.alias("file_path"), F.col("c_custkey").alias("filesize_bytes"))


CUSTOMER_FILES_SQL = """SELECT c_custkey AS filesize_bytes, 'Lab_device' || c_nationkey AS device,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '1_normal' WHEN 'BUILDING' THEN '1_normal' WHEN 'FURNITURE' THEN '5_httpbackdoor'
      WHEN 'MACHINERY' THEN '8_bdvl' ELSE '9_xmrig' END AS label,
    CASE WHEN c_acctbal < 0 THEN 'FLS_data' WHEN c_acctbal < 2500 THEN 'network_data' WHEN c_acctbal < 5000 THEN 'entropy_data'
      WHEN c_acctbal < 7500 THEN 'SYS_data' ELSE 'block_data' END AS data_source,
    CASE WHEN c_acctbal BETWEEN 5000 AND 7499.99 THEN 'zip' ELSE 'csv' END AS filetype
    FROM customer WHERE c_acctbal < 9000"""


@query("catalog_fields", CUSTOMER_FILES_SQL)
def catalog_fields(t):
    """Path fields, junk files left out, aliases replaced, device name built."""
    return catalog.build_catalog(customer_files(t)).select("filesize_bytes", "device", "label", "data_source", "filetype")


SOURCES = ["FLS_data", "network_data", "entropy_data", "SYS_data", "block_data"]


@query(
    "catalog_availability",
    f"WITH c AS ({CUSTOMER_FILES_SQL}) SELECT device, label, "
    + ", ".join(f"count(*) FILTER (WHERE data_source = '{s}') AS {s}" for s in SOURCES) + " FROM c GROUP BY device, label",
)
def catalog_availability(t):
    """Files per (device, label) and source, 0-filled."""
    return reports.availability(catalog.build_catalog(customer_files(t)), ["device", "label"], "data_source", SOURCES)


@query(
    "catalog_missing_sources",
    f"""WITH c AS ({CUSTOMER_FILES_SQL}), g AS (SELECT DISTINCT device, label FROM c),
    s AS (SELECT unnest({SOURCES}) AS missing)
    SELECT device, label, missing FROM g, s WHERE NOT EXISTS
    (SELECT 1 FROM c WHERE c.device = g.device AND c.label = g.label AND c.data_source = s.missing)""",
)
def catalog_missing_sources(t):
    """The cells without data."""
    table = reports.availability(catalog.build_catalog(customer_files(t)), ["device", "label"], "data_source", SOURCES)
    return reports.missing_cells(table, ["device", "label"], SOURCES)


@query(
    "catalog_one_source",
    f"WITH c AS ({CUSTOMER_FILES_SQL}) SELECT filesize_bytes, label FROM c WHERE device = 'Lab_device3' AND data_source = 'network_data'",
)
def catalog_one_source(t):
    """P10: one device and one source, never empty."""
    rows = cleaning.one_device_one_source(catalog.build_catalog(customer_files(t)), "Lab_device3", "network_data")
    return rows.select("filesize_bytes", "label")


@query(
    "catalog_tagged_rows",
    f"""WITH c AS ({CUSTOMER_FILES_SQL}) SELECT o_orderkey, label, device, data_source
    FROM orders LEFT JOIN c ON o_custkey = filesize_bytes""",
)
def catalog_tagged_rows(t):
    """Rows get label, device and source of the file they came from; rows of unknown files stay."""
    files = catalog.build_catalog(customer_files(t))
    keyed = files.withColumn("file", F.col("filesize_bytes"))
    rows = t.orders.select("o_orderkey", F.col("o_custkey").alias("file"))
    return membership.tag_with_catalog(rows, keyed, "file").drop("file")


@query(
    "file_types",
    """WITH b AS (SELECT regexp_extract(url, '([^/]*)/*$', 1) AS base FROM pages),
    s AS (SELECT regexp_extract(base, '[^.]\\.([^.]+)$', 1) AS suffix FROM b)
    SELECT CASE WHEN suffix = '' THEN 'no_filetype' ELSE suffix END AS filetype, count(*) AS n_rows FROM s GROUP BY 1""",
)
def file_types(t):
    """Counts per extension."""
    return reports.counts_by(t.pages.select(file_type(F.col("url")).alias("filetype")), "filetype")


@query(
    "file_titles",
    """SELECT DISTINCT 'Lab_device' || c_nationkey || '_' || c_mktsegment || '_RES_data' AS title, 'Lab_device' || c_nationkey AS grp
    FROM customer""",
)
def file_titles(t):
    """2.9: detailed and group titles."""
    rows = t.customer.select(
        F.lit("Lab").alias("researcher_name"), F.concat(F.lit("device"), "c_nationkey").alias("device_name"),
        F.col("c_mktsegment").alias("label"), F.lit("RES_data").alias("data_source"),
    )
    return rows.select(catalog.detailed_title("data_source").alias("title"), catalog.group_title().alias("grp")).distinct()


@query(
    "score_file_provenance",
    """WITH f AS (SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'RES_data_Lab_dev' || c_nationkey || '_30s_ROBUST_x.csv'
      ELSE 'network_datax40s_Lab_dev' || c_nationkey || '_40s.csv' END AS n FROM customer),
    p AS (SELECT c_custkey, string_split(regexp_replace(n, '\\.[^.]*$', ''), '_') AS p FROM f)
    SELECT c_custkey, p[1] || '_' || p[2] AS data_source, array_to_string(p[3:4], '_') AS device, p[5] AS time_window,
      coalesce(p[6] = 'ROBUST', false) AS is_robust FROM p""",
)
def score_file_provenance(t):
    """Provenance from the parts of a score file's name."""
    name = F.when(
        F.col("c_acctbal") > 5000, F.concat(F.lit("RES_data_Lab_dev"), "c_nationkey", F.lit("_30s_ROBUST_x.csv"))
    ).otherwise(F.concat(F.lit("network_datax40s_Lab_dev"), "c_nationkey", F.lit("_40s.csv")))
    rows = t.customer.select("c_custkey", name.alias("file_name"))
    return tables.with_score_provenance(rows).drop("file_name")


@query(
    "first_timestamps",
    """SELECT o_orderstatus AS file_path, min(CASE WHEN o_orderpriority LIKE '1%' THEN o_totalprice END) AS first_time,
    min(o_orderkey::DOUBLE) AS first_timestamp FROM orders GROUP BY 1""",
)
def first_timestamps(t):
    """Smallest readable value of every candidate time column per file."""
    rows = t.orders.select(
        F.col("o_orderstatus").alias("file_path"), F.col("o_orderkey").cast("string").alias("timestamp"),
        F.when(F.col("o_orderpriority").startswith("1"), F.col("o_totalprice").cast("string")).otherwise("bad").alias("time"),
    )
    return catalog.first_timestamps(rows, ["timestamp", "time", "Time"])


@query("metric_files_since", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-17 20:21:33'")
def metric_files_since(t):
    """Only rows of files started after the run, start given as day/month/year text."""
    return tables.since(t.events, "ts", "17/01/2024 20:21:33 ").select("event_id")


# --- cleaning ---------------------------------------------------------------------------


@query(
    "iqr_filter",
    """WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b, quantile_cont(user_id::DOUBLE, 0.25) AS c,
      quantile_cont(user_id::DOUBLE, 0.75) AS d FROM events)
    SELECT event_id, value, user_id FROM events, q WHERE value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)
      AND user_id BETWEEN c - 1.5 * (d - c) AND d + 1.5 * (d - c)""",
)
def iqr_filter(t):
    """A row goes if any column is beyond its whiskers."""
    return cleaning.drop_iqr_outliers(t.events.select("event_id", "value", "user_id"), ["value", "user_id"])


def scaled_sql(source: str, keys: list[str], cols: list[str]) -> str:
    ends = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in cols)
    outs = ", ".join(r(f"coalesce(({c} - lo_{c}) / nullif(hi_{c} - lo_{c}, 0), CASE WHEN {c} IS NOT NULL THEN 0 END)", 9) + f" AS {c}" for c in cols)
    return f"SELECT {', '.join(keys)}, {outs} FROM {source}, (SELECT {ends} FROM {source})"


# Every seventh value is missing, as null or as NaN.
GAPS_SQL = """gap AS (SELECT event_id, event_type, CASE WHEN event_id % 7 <> 0 THEN value END AS value, user_id::DOUBLE AS user_id FROM events)"""


def gappy_events(t):
    value = F.when(F.col("event_id") % 14 == 0, F.lit(None)).when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return t.events.select("event_id", "event_type", value.alias("value"), F.col("user_id").cast("double").alias("user_id"))


@query(
    "iqr_filter_with_gaps",
    f"""WITH {GAPS_SQL}, q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b, quantile_cont(user_id, 0.25) AS c,
      quantile_cont(user_id, 0.75) AS d FROM gap)
    SELECT event_id, value, user_id FROM gap, q WHERE coalesce(value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a), true)
      AND user_id BETWEEN c - 1.5 * (d - c) AND d + 1.5 * (d - c)""",
)
def iqr_filter_with_gaps(t):
    """A row without a value stays, whether null or NaN."""
    kept = cleaning.drop_iqr_outliers(gappy_events(t).drop("event_type"), ["value", "user_id"])
    return cleaning.nan_to_null(kept, ["value"])


@query("minmax_with_gaps", f"WITH {GAPS_SQL} {scaled_sql('gap', ['event_id'], ['value', 'user_id'])}")
def minmax_with_gaps(t):
    """gaps stay gaps and do not set the limits."""
    return rounded(scaling.minmax_columns(gappy_events(t).drop("event_type"), ["value", "user_id"]), 9, ["value", "user_id"])


@query(
    "iqr_bounds_by_label",
    "WITH u AS (UNPIVOT (SELECT l_returnflag, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)"
    " ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME feature VALUE x),"
    " q AS (SELECT l_returnflag, feature, quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b FROM u GROUP BY ALL)"
    f" SELECT l_returnflag, feature, {r('a - 1.5 * (b - a)')} AS lo, {r('b + 1.5 * (b - a)')} AS hi FROM q",
)
def iqr_bounds_by_label(t):
    return rounded(cleaning.iqr_bounds(t.lineitem, MEASURES, ids=["l_returnflag"]), 6, ["lo", "hi"])


@query("minmax_scaled", f"WITH x AS (SELECT *, 7.0 AS same FROM lineitem) {scaled_sql('x', ['l_orderkey', 'l_linenumber'], MEASURES + ['same'])}")
def minmax_scaled(t):
    """columns to [0, 1], a constant column to 0, keys carried."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", *MEASURES, F.lit(7.0).alias("same"))
    return rounded(scaling.minmax_columns(rows, MEASURES + ["same"]), 9, MEASURES + ["same"])


@query(
    "minmax_scaled_robust",
    """WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events),
    x AS (SELECT event_id, value FROM events, q WHERE value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)) """
    + scaled_sql("x", ["event_id"], ["value"]),
)
def minmax_scaled_robust(t):
    """F1 with the outlier filter first; labels stay on their row."""
    return rounded(scaling.minmax_columns(t.events.select("event_id", "value"), ["value"], drop_outliers=True), 9, ["value"])


@query(
    "minmax_fit_on_train",
    f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem),
    e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM x WHERE l_quantity < 20)
    SELECT l_orderkey, l_linenumber, l_quantity, {r('(l_extendedprice - lo) / (hi - lo)', 9)} AS l_extendedprice FROM x, e""",
)
def minmax_fit_on_train(t):
    """F1 with limits from the training rows only."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return rounded(scaling.minmax_columns(rows, ["l_extendedprice"], fit_on=F.col("l_quantity") < 20), 9, ["l_extendedprice"])


@query(
    "low_variance_columns",
    f"""WITH u AS (UNPIVOT (SELECT l_quantity, l_extendedprice, l_discount, l_tax, 0.0::DOUBLE AS zero, 1e6::DOUBLE AS big FROM lineitem)
      ON l_quantity, l_extendedprice, l_discount, l_tax, zero, big INTO NAME feature VALUE x)
    SELECT feature, {r('var_pop(x)')} AS variance FROM u GROUP BY feature HAVING var_pop(x) <= 0.001""",
)
def low_variance_columns(t):
    """Columns whose variance does not exceed the limit."""
    rows = t.lineitem.withColumn("zero", F.lit(0.0)).withColumn("big", F.lit(1e6))
    return rounded(cleaning.low_variance_columns(rows, MEASURES + ["zero", "big"], 0.001), 6, ["variance"])


def gappy_orders(t):
    return t.orders.select(
        "o_orderkey", F.when(F.col("o_totalprice") > 100_000, F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("priority"),
    )


GAPPY_SQL = """g AS (SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS price,
    CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS priority FROM orders)"""


@query("rows_without_nulls", f"WITH {GAPPY_SQL} SELECT * FROM g WHERE price IS NOT NULL AND priority IS NOT NULL")
def rows_without_nulls(t):
    """Rows with any null dropped."""
    return cleaning.drop_any_null(gappy_orders(t))


@query(
    "null_profile",
    f"""WITH {GAPPY_SQL} SELECT count(*) AS n_rows, count(*) FILTER (WHERE price IS NULL OR priority IS NULL) AS n_any_null,
    count(*) FILTER (WHERE price IS NULL AND priority IS NULL) AS n_all_null, count(*) FILTER (WHERE price IS NULL) AS null_price,
    count(*) FILTER (WHERE priority IS NULL) AS null_priority FROM g""",
)
def null_profile(t):
    """Any-null, all-null and per-column diagnostics."""
    return cleaning.null_profile(gappy_orders(t), ["price", "priority"])


@query("nulls_to_zero", f"WITH {GAPPY_SQL} SELECT o_orderkey, coalesce(price, 0) AS price, priority FROM g")
def nulls_to_zero(t):
    """One column's nulls become 0."""
    return gappy_orders(t).fillna(0, subset=["price"])


@query(
    "numeric_lenient",
    """SELECT event_id, try_cast(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k, NULL::DOUBLE AS event_type, user_id FROM events""",
)
def numeric_lenient(t):
    """Text columns to numbers, unreadable text to null."""
    rows = t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"), "event_type", "user_id")
    return cleaning.to_numeric(rows, lenient=True)


@query("selected_columns", "SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem")
def selected_columns(t):
    """P5: selected features that exist, keys kept."""
    return cleaning.keep_selected(t.lineitem, ["l_tax", "l_discount", "absent"], ["l_orderkey", "l_linenumber"])


@query(
    "label_aliases",
    """SELECT CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE o_orderstatus END AS o_orderstatus, count(*) AS n_rows
    FROM orders GROUP BY 1""",
)
def label_aliases(t):
    """Values replaced by a map, others kept."""
    return reports.counts_by(cleaning.remap(t.orders, "o_orderstatus", {"O": "open", "F": "filled"}), "o_orderstatus")


@query(
    "device_family",
    """SELECT s_suppkey, CASE n_regionkey WHEN 0 THEN 'rp3' WHEN 1 THEN 'rp3' WHEN 2 THEN 'rp4' END AS family
    FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
def device_family(t):
    """Device to family through a literal map; unknown devices stay null."""
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return membership.with_family(rows, {0: "rp3", 1: "rp3", 2: "rp4"}, "n_regionkey").select("s_suppkey", "family")


@query(
    "top_category_codes",
    """WITH top AS (SELECT p_brand, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS rk FROM part GROUP BY 1 QUALIFY rk <= 5)
    SELECT p_partkey, (coalesce(rk, 0))::INT AS p_brand_code FROM part LEFT JOIN top USING (p_brand)""",
)
def top_category_codes(t):
    """rank in the five most frequent brands, else -1, made dense from 0."""
    return cleaning.top_category_codes(t.part.select("p_partkey", "p_brand"), "p_brand", 5).drop("p_brand")


@query(
    "top_values",
    "SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 5",
)
def top_values(t):
    """K8: the most frequent values."""
    return ranking.top_values(t.part, "p_type", 5)


@query("first_rows", "SELECT event_id, value FROM events ORDER BY ts, event_id LIMIT 10")
def first_rows(t):
    """K1, K9: head of a time-ordered table."""
    return ranking.preview(t.events.select("event_id", "value", "ts"), 10, order=["ts", "event_id"]).drop("ts")


@query(
    "seeded_shuffle",
    """SELECT c_custkey, row_number() OVER (ORDER BY md5(c_custkey || '|7'), c_custkey) - 1 AS position FROM customer""",
)
def seeded_shuffle(t):
    """P25: full shuffle as an order by a seeded hash; the position shows it."""
    return cleaning.shuffled(t.customer.select("c_custkey"), ["c_custkey"], 7, "position")


@query(
    "hash_sample",
    """SELECT l_orderkey, l_linenumber FROM lineitem
    WHERE ('0x' || substr(md5(l_orderkey || '|' || l_linenumber || '|5'), 1, 8))::BIGINT % 1000000 < 250000""",
)
def hash_sample(t):
    """P25: a fixed quarter of the rows, chosen by a hash of the key."""
    return cleaning.sampled(t.lineitem.select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], 0.25, 5)


@query("rows_by_position", "SELECT event_id, value FROM events ORDER BY ts, event_id LIMIT 50 OFFSET 100")
def rows_by_position(t):
    """K9: a slice of an order by position."""
    return cleaning.sliced(t.events.select("event_id", "value", "ts"), ["ts", "event_id"], 100, 150).drop("ts")


# --- joins and sets ---------------------------------------------------------------------


def daily(t):
    orders = window_agg(t.orders, "o_orderdate", "1d", [F.sum("o_totalprice").alias("amount"), F.count("*").alias("n_orders")], keep_gaps=False)
    items = window_agg(t.lineitem, "l_shipdate", "1d", [F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("amount")], keep_gaps=False)
    events = window_agg(t.events, "ts", "1d", [F.avg("value").alias("value")], keep_gaps=False)
    return {"orders": orders, "items": items, "events": events}


@query(
    "fuse_sources",
    f"""WITH o AS (SELECT epoch_us(o_orderdate) - epoch_us(o_orderdate) % {DAY} AS win_us, sum(o_totalprice) AS amount_orders, count(*) AS n_orders FROM orders GROUP BY 1),
    i AS (SELECT epoch_us(l_shipdate) - epoch_us(l_shipdate) % {DAY} AS win_us, sum(l_quantity) AS quantity, sum(l_extendedprice) AS amount_items FROM lineitem GROUP BY 1),
    e AS (SELECT epoch_us(ts) - epoch_us(ts) % {DAY} AS win_us, avg(value) AS value FROM events GROUP BY 1)
    SELECT win_us, {r('amount_orders', 2)} AS amount_orders, n_orders, quantity, {r('amount_items', 2)} AS amount_items, {r('value')} AS value
    FROM o FULL JOIN i USING (win_us) FULL JOIN e USING (win_us)""",
)
def fuse_sources(t):
    """Three sources side by side, the shared column suffixed by source."""
    fused = fusion.fuse(daily(t), ["win_us"])
    return rounded(rounded(fused, 2, ["amount_orders", "amount_items"]), 6, ["value"])


def labelled_frames(t):
    """Two sources with one row per (window, label); the label doubles as file name."""
    rows = t.events.withColumn("label", F.col("event_type"))
    series = ["label"]
    mean = window_mean(rows.filter("value < 50"), "ts", "6h", ["value"], series).withColumn("origin_path", F.col("label"))
    count = window_agg(rows.filter("value >= 50"), "ts", "6h", [F.count("*").alias("n_rows")], series, keep_gaps=False).withColumn("origin_path", F.col("label"))
    return {"small": mean, "large": count}


LABELLED_SQL = f"""e AS (SELECT *, epoch_us(ts) - epoch_us(ts) % {6 * 3_600_000_000} AS win_us FROM events),
    sp AS (SELECT event_type AS label, min(win_us) AS a, max(win_us) AS b FROM e WHERE value < 50 GROUP BY 1),
    g AS (SELECT label, unnest(generate_series(a, b, {6 * 3_600_000_000}::BIGINT)) AS win_us FROM sp),
    m AS (SELECT event_type AS label, win_us, avg(value) AS value FROM e WHERE value < 50 GROUP BY ALL),
    small AS (SELECT g.label, g.win_us, value FROM g LEFT JOIN m USING (label, win_us)),
    large AS (SELECT event_type AS label, win_us, count(*) AS n_rows FROM e WHERE value >= 50 GROUP BY ALL),
    s1 AS (SELECT win_us, arg_min(struct_pack(v := value), label).v AS value FROM small GROUP BY 1),
    l1 AS (SELECT win_us, arg_min(n_rows, label) AS n_rows FROM large GROUP BY 1),
    f AS (SELECT * FROM s1 FULL JOIN l1 USING (win_us)),
    lab AS (SELECT win_us, label FROM small UNION ALL SELECT win_us, label FROM large)"""


def labelled(t, fanout):
    frames = labelled_frames(t)
    single = {k: fusion.first_per_key(f, ["win_us"], ["origin_path"]).drop("label", "origin_path") for k, f in frames.items()}
    fused = fusion.attach_labels(fusion.fuse(single, ["win_us"]), fusion.label_side(frames, ["win_us"]), ["win_us"], fanout)
    return rounded(fused, 6, ["value"])


@query("fuse_with_labels", f"WITH {LABELLED_SQL} SELECT win_us, {r('value')} AS value, n_rows, label FROM f FULL JOIN (SELECT DISTINCT * FROM lab) USING (win_us)")
def fuse_with_labels(t):
    """One row per window and distinct label."""
    return labelled(t, False)


@query("fuse_with_labels_fanout", f"WITH {LABELLED_SQL} SELECT win_us, {r('value')} AS value, n_rows, label FROM f FULL JOIN lab USING (win_us)")
def fuse_with_labels_fanout(t):
    """J2 as the raw label rows give it: repeated per source."""
    return labelled(t, True)


def merge_sources(t):
    """Events as three telemetry sources of five files (one per type) on two devices."""
    base = t.events.select(
        "event_id", "ts", F.col("event_type").alias("label"), "value", "user_id",
        F.when(F.col("user_id") < 75, "dev_a").otherwise("dev_b").alias("device"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    ).withColumn("origin_path", F.concat_ws("/", "device", "label"))
    block = base.select("ts", "label", "device", "origin_path", F.lit("block_data").alias("data_source"), F.col("event_id").alias("row_seq"),
                        F.col("value").alias("read_ops"), F.col("k").cast("double").alias("util"))
    files = base.select("ts", "label", "device", "origin_path", F.lit("entropy_data").alias("data_source"), F.col("event_id").alias("row_seq"),
                        F.col("user_id").cast("string").alias("file_path"), (F.col("k") / 15.0).alias("entropy"))
    return {"block_data": block, "entropy_data": files}


MERGE_SQL = f"""e AS (SELECT *, epoch_us(ts) AS us, event_type AS label, CASE WHEN user_id < 75 THEN 'dev_a' ELSE 'dev_b' END AS device,
      regexp_extract(props, '([0-9]+)', 1)::INT AS k FROM events),
    st AS (SELECT min(us) AS o FROM e),
    w AS (SELECT e.*, us - (us - o) % {6 * 3_600_000_000} AS win_us FROM e, st),
    sp AS (SELECT device, label, min(win_us) AS a, max(win_us) AS b FROM w GROUP BY ALL),
    g AS (SELECT device, label, unnest(generate_series(a, b, {6 * 3_600_000_000}::BIGINT)) AS win_us FROM sp),
    x AS (SELECT device, label, win_us, avg(value) AS read_ops, count(DISTINCT CASE WHEN k / 15.0 >= 6 THEN user_id END) AS c FROM w GROUP BY ALL),
    full_ AS (SELECT device, label, win_us, read_ops, coalesce(c, 0) AS c FROM g LEFT JOIN x USING (device, label, win_us)),
    one AS (SELECT device, win_us, arg_min(struct_pack(v := read_ops), label).v AS read_ops, arg_min(c, label) AS entropy_file_count FROM full_ GROUP BY ALL)"""


@query(
    "device_merge",
    f"WITH {MERGE_SQL} SELECT device, win_us, {r('read_ops')} AS read_ops, entropy_file_count, label FROM one JOIN (SELECT DISTINCT device, win_us, label FROM full_) USING (device, win_us)",
)
def device_merge(t):
    """3.2, J1-J3, P24, W7: the whole fusion job over all devices at once, global origin."""
    merged = merge_device(merge_sources(t), ["read_ops", "entropy_file_count"], "6h", SourceRegistry())
    return rounded(merged, 6, ["read_ops"])


CALL_TERMS = ["de", "of", "que"]


@query(
    "device_merge_with_calls",
    f"""WITH {MERGE_SQL}, d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'dev_a' ELSE 'dev_b' END AS device,
      epoch_us(TIMESTAMP '2024-01-01') + doc_id * {7 * 60_000_000} AS us, {words_sql('lower(text)')} AS tokens FROM documents),
    dw AS (SELECT *, us - ((us - o) % {6 * 3_600_000_000} + {6 * 3_600_000_000}) % {6 * 3_600_000_000} AS win_us FROM d, st),
    cm AS (SELECT device, win_us, {', '.join(f"avg(len(list_filter(tokens, lambda x: x = '{w}')))::DOUBLE AS {w}" for w in CALL_TERMS)} FROM dw GROUP BY ALL),
    cs AS (SELECT device, min(win_us) AS a, max(win_us) AS b FROM dw GROUP BY 1),
    cg AS (SELECT device, unnest(generate_series(a, b, {6 * 3_600_000_000}::BIGINT)) AS win_us FROM cs),
    c AS (SELECT device, win_us, {', '.join(CALL_TERMS)} FROM cg LEFT JOIN cm USING (device, win_us)),
    m AS (SELECT device, win_us, read_ops, entropy_file_count, label FROM one JOIN (SELECT DISTINCT device, win_us, label FROM full_) USING (device, win_us))
    SELECT device, win_us, {r('read_ops')} AS read_ops, entropy_file_count, label, {', '.join(r(w) + f' AS {w}' for w in CALL_TERMS)}
    FROM m FULL JOIN c USING (device, win_us)""",
)
def device_merge_with_calls(t):
    """The fusion job with term counts of documents as calls; documents without a selected term count as 0."""
    docs = t.documents.filter("text IS NOT NULL").select(
        F.expr("IF(doc_id % 2 = 0, 'dev_a', 'dev_b')").alias("device"), F.col("doc_id").alias("doc"),
        F.expr("timestampadd(MINUTE, CAST(doc_id * 7 AS INT), TIMESTAMP_NTZ '2024-01-01 00:00:00')").alias("ts"), "text")
    counts = text.term_counts(text.tokenised(docs, ["device", "doc", "ts"], "text", lowercase=True), ["device", "doc", "ts"])
    merged = merge_device(
        merge_sources(t), ["read_ops", "entropy_file_count", *CALL_TERMS], "6h", SourceRegistry(),
        calls=counts.withColumn("value", F.col("n").cast("double")), call_documents=docs.drop("text"))
    return rounded(merged, 6, ["read_ops", *CALL_TERMS])


@query("customers_with_orders", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def customers_with_orders(t):
    """Membership as a semi join."""
    known = t.orders.select(F.col("o_custkey").alias("c_custkey"))
    return membership.in_both(t.customer.select("c_custkey", "c_name"), known, "c_custkey")


@query("customers_without_orders", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def customers_without_orders(t):
    """Exclusion as an anti join."""
    known = t.orders.filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return membership.not_in(t.customer.select("c_custkey", "c_name"), known, "c_custkey")


def brand_sets(t):
    return t.part.filter("p_size < 10").select("p_name"), t.part.filter("p_size >= 40").select("p_name")


BRANDS_A, BRANDS_B = "SELECT p_name FROM part WHERE p_size < 10", "SELECT p_name FROM part WHERE p_size >= 40"


@query("feature_union", f"{BRANDS_A} UNION {BRANDS_B}")
def feature_union(t):
    """U2."""
    return membership.set_union(*brand_sets(t))


@query("feature_intersection", f"{BRANDS_A} INTERSECT {BRANDS_B}")
def feature_intersection(t):
    """U3."""
    return membership.set_intersection(*brand_sets(t))


@query("feature_difference", "SELECT p_name FROM part WHERE p_size < 30 EXCEPT SELECT p_name FROM part WHERE p_size >= 49")
def feature_difference(t):
    """U4."""
    return membership.set_difference(t.part.filter("p_size < 30").select("p_name"), t.part.filter("p_size >= 49").select("p_name"))


@query("distinct_rows", "SELECT DISTINCT p_brand, p_type FROM part")
def distinct_rows(t):
    """U5."""
    return t.part.select("p_brand", "p_type").distinct()


@query(
    "union_sources",
    """SELECT o_custkey AS k, o_totalprice AS amount, NULL::VARCHAR AS c_mktsegment FROM orders
    UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment FROM customer""",
)
def union_sources(t):
    """Rows of two tables by name, missing columns null, an extra one dropped first."""
    a = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("amount"), F.col("o_orderstatus"))
    b = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("amount"), "c_mktsegment")
    return tables.union_training_tables([a, b], ["o_orderstatus"])


@query(
    "labels_encoded",
    """WITH codes AS (SELECT c_mktsegment, (row_number() OVER (ORDER BY c_mktsegment) - 1)::INT AS code FROM (SELECT DISTINCT c_mktsegment FROM customer))
    SELECT c_custkey, code, c_mktsegment AS name FROM customer JOIN codes USING (c_mktsegment)""",
)
def labels_encoded(t):
    """Lexicographic codes and back."""
    names = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    coded = membership.encode_labels(t.customer.select("c_custkey", F.col("c_mktsegment").alias("label")), names)
    return membership.decode_labels(coded.withColumn("code", F.col("label")), names).withColumnRenamed("label", "name")


@query(
    "first_order_per_customer",
    """SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey,
    arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM orders GROUP BY 1""",
)
def first_order_per_customer(t):
    """First row of a key in a given order."""
    rows = t.orders.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return fusion.first_per_key(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


def part_features(t):
    registry = t.part.groupBy(F.col("p_name").alias("feature"), F.col("p_brand").alias("data_source")).agg(F.min("p_partkey").alias("ord"))
    registry = registry.filter("data_source <> 'Brand#1'")
    plain = t.part.select(F.col("p_name").alias("feature"))
    suffixed = t.part.select(F.concat("p_name", F.lit("_KERN_data")).alias("feature"))
    foreign = t.part.select(F.concat("p_type", F.lit(" call")).alias("feature"))
    return plain.union(suffixed).union(foreign).distinct(), registry


FEATURE_SOURCE_SQL = """f AS (SELECT p_name AS feature FROM part UNION SELECT p_name || '_KERN_data' FROM part UNION SELECT p_type || ' call' FROM part),
    reg AS (SELECT p_name AS feature, p_brand, min(p_partkey) AS ord FROM part WHERE p_brand <> 'Brand#1' GROUP BY ALL),
    first AS (SELECT feature, arg_min(p_brand, ord) AS s FROM reg GROUP BY 1),
    src AS (SELECT feature, coalesce(CASE s WHEN 'Brand#2' THEN 'Brand#3' ELSE s END, nullif(regexp_extract(feature, '([^_]+_data)$', 1), ''), 'SYS_data') AS data_source
      FROM f LEFT JOIN first USING (feature))"""


@query("feature_sources", f"WITH {FEATURE_SOURCE_SQL} SELECT * FROM src")
def feature_sources(t):
    """Registered source, else the name's suffix, else system calls; one source folded into another."""
    features, registry = part_features(t)
    return membership.source_of_features(features, registry, {"Brand#2": "Brand#3"})


@query("feature_source_counts", f"WITH {FEATURE_SOURCE_SQL} SELECT data_source, count(*) AS n_features FROM src GROUP BY 1")
def feature_source_counts(t):
    """A22."""
    features, registry = part_features(t)
    return reports.source_counts(membership.source_of_features(features, registry, {"Brand#2": "Brand#3"}))


# --- splits and shards ------------------------------------------------------------------

UNIT = "('0x' || substr(md5({key} || '|{seed}'), 1, 8))::BIGINT % {n}"


def unit(key: str, seed: int, n: int) -> str:
    return UNIT.format(key=key, seed=seed, n=n)


ITEM_KEY = "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey"
ITEM_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("hash_split", f"SELECT {', '.join(ITEM_KEYS)}, CASE WHEN {unit(ITEM_KEY, 133, 10000)} < 8000 THEN 'train' ELSE 'test' END AS split FROM lineitem")
def hash_split(t):
    """M1: 80/20 by a hash of the row key, the same under any partitioning."""
    return shards.hash_split(t.lineitem.select(*ITEM_KEYS), ITEM_KEYS)


@query("contiguous_shards", "SELECT o_orderkey, (ntile(7) OVER (ORDER BY o_orderdate, o_orderkey) - 1)::INT AS shard FROM orders")
def contiguous_shards(t):
    """Seven contiguous shards in date order."""
    return ordering.contiguous_shards(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 7).drop("o_orderdate")


@query(
    "device_shards",
    """WITH d AS (SELECT s_nationkey, (ntile(4) OVER (ORDER BY md5(s_nationkey || '|22740369'), s_nationkey) - 1)::INT AS shard FROM (SELECT DISTINCT s_nationkey FROM supplier))
    SELECT s_suppkey, s_nationkey, shard FROM supplier JOIN d USING (s_nationkey)""",
)
def device_shards(t):
    """Whole devices to shards in seeded order."""
    return shards.device_shards(t.supplier.select("s_suppkey", "s_nationkey"), "s_nationkey", 4, 22740369)


@query(
    "half_device_shards",
    f"""WITH s AS (SELECT s_suppkey, s_nationkey, ({unit('s_suppkey', 22740369, 2)})::INT AS half FROM supplier),
    p AS (SELECT s_nationkey, half FROM (SELECT DISTINCT s_nationkey FROM supplier), (SELECT unnest([0, 1])::INT AS half)),
    o AS (SELECT s_nationkey, half, (row_number() OVER (ORDER BY md5(s_nationkey || '/' || half || '|22740369'), s_nationkey, half) - 1)::INT AS shard FROM p)
    SELECT s_suppkey, s_nationkey, half, shard FROM s JOIN o USING (s_nationkey, half)""",
)
def half_device_shards(t):
    """D3: every device halved at random."""
    return shards.half_device_shards(t.supplier.select("s_suppkey", "s_nationkey"), "s_nationkey", ["s_suppkey"], 22740369)


SHARES = shards.dirichlet_shares(["A", "N", "R"], 8, 1.0, 42)


def _share_sql() -> str:
    cases = []
    for label, parts in SHARES.items():
        cut, terms = 0.0, []
        for part in parts[:-1]:
            cut += part
            terms.append(f"(p >= {cut!r}::DOUBLE)::INT")
        cases.append(f"WHEN '{label}' THEN {' + '.join(terms)}")
    return f"(CASE l_returnflag {' '.join(cases)} END)::INT"


SKEW_SQL = f"""s AS (SELECT *, {unit(ITEM_KEY, 42, 1000000)} / 1000000.0::DOUBLE AS p FROM lineitem),
    a AS (SELECT {', '.join(ITEM_KEYS)}, l_returnflag, {_share_sql()} AS shard FROM s)"""


@query("label_skewed_shards", f"WITH {SKEW_SQL} SELECT * FROM a")
def label_skewed_shards(t):
    """Dirichlet shares per label, rows placed by their hash position."""
    return shards.label_skewed_shards(t.lineitem.select(*ITEM_KEYS, "l_returnflag"), "l_returnflag", ITEM_KEYS, SHARES, 42)


@query(
    "shard_label_counts",
    f"""WITH {SKEW_SQL} SELECT shard, CASE WHEN {unit(ITEM_KEY, 133, 10000)} < 8000 THEN 'train' ELSE 'test' END AS split,
    l_returnflag, count(*) AS n_rows FROM a GROUP BY ALL""",
)
def shard_label_counts(t):
    """Label counts per shard and split."""
    placed = shards.label_skewed_shards(t.lineitem.select(*ITEM_KEYS, "l_returnflag"), "l_returnflag", ITEM_KEYS, SHARES, 42)
    return shards.shard_label_counts(shards.hash_split(placed, ITEM_KEYS), "l_returnflag")


@query(
    "clean_training_set",
    f"""WITH x AS (SELECT {', '.join(ITEM_KEYS)}, l_quantity, l_tax, l_returnflag FROM lineitem WHERE l_discount > 0),
    e AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_tax) AS c, max(l_tax) AS d FROM x)
    SELECT {', '.join(ITEM_KEYS)}, {r('(l_quantity - a) / (b - a)', 9)} AS l_quantity, {r('(l_tax - c) / (d - c)', 9)} AS l_tax,
    (CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END)::INT AS label,
    row_number() OVER (ORDER BY md5({" || '|' || ".join(ITEM_KEYS)} || '|7'), {', '.join(ITEM_KEYS)}) - 1 AS position FROM x, e""",
)
def clean_training_set_(t):
    """nulls dropped on all columns, selected features scaled, labels coded, rows shuffled."""
    fused = t.lineitem.select(*ITEM_KEYS, "l_quantity", "l_tax", F.expr("nullif(l_discount, 0D)").alias("l_discount"), F.col("l_returnflag").alias("label"))
    table = clean_training_set(fused, ["l_quantity", "l_tax", "absent"], ["A", "N", "R"], key=ITEM_KEYS, seed=7, position="position")
    return rounded(table, 9, ["l_quantity", "l_tax"])
