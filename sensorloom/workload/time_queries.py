"""Window, network and entropy queries on the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.operators import buckets, entropy, network, timestamps
from sensorloom.operators.user_aggregates import SmallestHashes, window_aggregate
from sensorloom.workload.registry import query, r, rounded

HOUR = 3_600_000_000
DAY = 24 * HOUR


def grid_sql(width: int, origin: str, body: str, outs: str, label: str | None = "event_type", source: str = "events",
             ts: str = "ts", extra: str = "") -> str:
    """Shared shape: bucket the rows, aggregate, generate all windows of a series, left join.

    ``origin`` is an expression over lo (first microsecond of the series).
    """
    key = f"{label}, " if label else ""
    using = f"({label}, win_us)" if label else "(win_us)"
    group = f"GROUP BY {label}" if label else ""
    join = f"JOIN span USING ({label})" if label else ", span"
    return f"""
    WITH src AS (SELECT *, epoch_us({ts}) AS us FROM {source} WHERE {ts} IS NOT NULL),
    span AS (SELECT {key} min(us) AS lo, max(us) AS hi FROM src {group}),
    org AS (SELECT {key} lo, hi, ({origin})::BIGINT AS o FROM span),
    rows_ AS (SELECT src.*, us - ((((us - o) % {width}) + {width}) % {width}) AS win_us FROM src {join.replace('span', 'org')}),
    grid AS (SELECT {key} unnest(generate_series(lo - ((((lo - o) % {width}) + {width}) % {width}),
             hi - ((((hi - o) % {width}) + {width}) % {width}), {width}::BIGINT)) AS win_us FROM org){extra},
    agg AS (SELECT {key} win_us, {body} FROM rows_ GROUP BY {key} win_us)
    SELECT {key} win_us, {outs} FROM grid LEFT JOIN agg USING {using}"""


MEAN_BODY, MEAN_OUT = "avg(value) AS value", f"{r('value')} AS value"


def mean_query(t, width, origin, series=("event_type",)):
    return rounded(buckets.window_mean(t.events, "ts", width, ["value"], series, origin), 6, ["value"])


@query("window_mean_epoch", grid_sql(HOUR, "0", MEAN_BODY, MEAN_OUT))
def window_mean_epoch(t):
    """Hourly mean per event type, empty hours kept as null."""
    return mean_query(t, "1h", "epoch")


@query("window_mean_series_start", grid_sql(40 * 60_000_000, "lo", MEAN_BODY, MEAN_OUT))
def window_mean_series_start(t):
    """Origin is the first row of each series."""
    return mean_query(t, "40min", "start")


@query("window_mean_global_start", grid_sql(6 * HOUR, "(SELECT min(epoch_us(ts)) FROM events)", MEAN_BODY, MEAN_OUT))
def window_mean_global_start(t):
    """Origin is the first row of the whole input, as in the device merge."""
    return mean_query(t, "6h", "global")


@query("window_mean_start_of_day", grid_sql(7 * HOUR, f"lo - lo % {DAY}", MEAN_BODY, MEAN_OUT))
def window_mean_start_of_day(t):
    return mean_query(t, "7h", "start_day")


@query("window_mean_fixed_origin", grid_sql(5 * HOUR, "1704099600000000", MEAN_BODY, MEAN_OUT))
def window_mean_fixed_origin(t):
    """Explicit origin that lies after the first rows."""
    return mean_query(t, "5h", "2024-01-01T09:00:00")


@query("window_mean_single_series", grid_sql(HOUR, "0", MEAN_BODY, MEAN_OUT, label=None))
def window_mean_single_series(t):
    return mean_query(t, "1h", "epoch", ())


@query(
    "window_mean_long",
    f"""WITH l AS (SELECT event_type, epoch_us(ts) - epoch_us(ts) % {DAY} AS win_us, value, value * value AS value_sq FROM events),
    u AS (UNPIVOT l ON value, value_sq INTO NAME feature VALUE x)
    SELECT event_type, win_us, feature, {r('avg(x)', 4)} AS value FROM u GROUP BY ALL""",
)
def window_mean_long(t):
    """The wide-source form: one aggregate for all counters."""
    rows = t.events.withColumn("value_sq", F.col("value") * F.col("value"))
    return rounded(buckets.window_mean_long(rows, "ts", "1d", ["value", "value_sq"], ["event_type"]), 4, ["value"])


@query("window_count", grid_sql(30 * 60_000_000, "0", "count(*) AS c", "coalesce(c, 0) AS n_rows"))
def window_count(t):
    """Rows per half hour, zero for empty ones."""
    return buckets.window_count(t.events, "ts", "30min", ["event_type"])


@query("window_cells", grid_sql(30 * 60_000_000, "0", "count(*) * 6 AS c", "coalesce(c, 0)::BIGINT AS n_rows"))
def window_cells(t):
    """Cells (rows x columns) per window."""
    return buckets.window_count(t.events, "ts", "30min", ["event_type"], cells_per_row=6)


@query(
    "window_sum_with_first",
    grid_sql(
        4 * HOUR, "0",
        "sum(user_id) AS s, arg_min(event_type, (us, event_id)) AS g",
        "coalesce(s, 0)::BIGINT AS vector_count, g AS first_group", label=None,
    ),
)
def window_sum_with_first(t):
    """Sum of pre-counted vectors and the first group per window."""
    return buckets.window_sum_with_first(t.events, "ts", "4h", "user_id", "event_type", ["event_id"])


@query(
    "time_density",
    f"SELECT event_type, epoch_us(ts) - epoch_us(ts) % {DAY} AS win_us, count(*) AS n_rows FROM events GROUP BY ALL",
)
def time_density(t):
    """Rows over time per group."""
    return buckets.time_density(t.events, "ts", "1d", "event_type")


@query(
    "file_spans",
    """SELECT user_id, min(epoch_us(ts)) AS lo_us, max(epoch_us(ts)) AS hi_us,
       (SELECT min(epoch_us(ts)) FROM events) AS origin_us FROM events GROUP BY user_id""",
)
def file_spans(t):
    """First and last timestamp per file and the global origin."""
    return buckets.file_spans(t.events, "ts", ["user_id"])


def raw_records(t):
    """Raw records as files would hold them: one 'file' per event type, two of them in milliseconds,
    the time as text, unreadable for the largest values."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    text = (
        F.when(F.col("value") > 250, "n/a")
        .when(F.col("event_type").isin("click", "view"), F.floor(us / 1000).cast("long").cast("string"))
        .otherwise(F.floor(us / 1_000_000).cast("long").cast("string"))
    )
    return t.events.select("event_id", "event_type", "value", text.alias("time"))


RAW_SQL = """raw AS (SELECT event_id, event_type, value, CASE WHEN value > 250 THEN NULL
       WHEN event_type IN ('click', 'view') THEN epoch_us(ts) // 1000 ELSE epoch_us(ts) // 1000000 END AS t FROM events)"""


@query(
    "timestamps_normalised",
    f"""WITH {RAW_SQL}, unit AS (SELECT event_type, max(t) > 2000000000 AS is_ms FROM raw GROUP BY 1)
    SELECT event_id, event_type, value, CASE WHEN is_ms THEN t // 1000 ELSE t END AS epoch
    FROM raw JOIN unit USING (event_type) WHERE t IS NOT NULL""",
)
def timestamps_normalised(t):
    """First present time column, unreadable rows dropped, unit found per file."""
    rows = timestamps.normalise_timestamps(raw_records(t), ["event_type"], 2_000_000_000.0)
    return rows.select("event_id", "event_type", "value", F.unix_seconds("ts").alias("epoch"))


@query(
    "timestamps_rejected",
    f"WITH {RAW_SQL} SELECT event_type, count(*) FILTER (WHERE t IS NULL) AS n_rejected, count(*) AS n_rows FROM raw GROUP BY 1",
)
def timestamps_rejected(t):
    return timestamps.rejected_timestamps(raw_records(t), ["event_type"])


# Packets: the number in props picks protocol and source port.
PACKET_COLUMNS = {
    "protocol": "protocol", "source_port": "port", "dest_port": "dest_port", "dest_ip": "user_id",
    "length": "value", "seq": "event_id",
}


def packets(t, tied: bool = False):
    k = F.get_json_object("props", "$.k").cast("int")
    rows = t.events.select(
        "event_id", "event_type", "user_id", "value", k.alias("port"),
        (F.col("user_id") % 16).alias("dest_port"),
        F.when(k < 40, "TCP").when(k < 60, "UDP").otherwise("ICMP").alias("protocol"),
        (F.date_trunc("hour", F.col("ts")) if tied else F.col("ts")).alias("ts"),
    )
    return rows


def packet_source(tied: bool) -> str:
    ts = "date_trunc('hour', ts)::TIMESTAMP" if tied else "ts"
    return f"""(SELECT event_id, event_type, user_id, value, k AS port, user_id % 16 AS dest_port,
        CASE WHEN k < 40 THEN 'TCP' WHEN k < 60 THEN 'UDP' ELSE 'ICMP' END AS protocol, {ts} AS ts
        FROM (SELECT *, regexp_extract(props, '([0-9]+)', 1)::INT AS k FROM events))"""


def network_sql(width: int, origin: str, label: str | None, tied: bool, digits: int | None = 3) -> str:
    part = f"PARTITION BY {label + ', ' if label else ''}win_us ORDER BY us, event_id"
    steps = f""",
    d1 AS (SELECT *, (us - lag(us) OVER ({part})) / 1e6 AS dt FROM rows_),
    d2 AS (SELECT *, dt - lag(dt) OVER ({part}) AS dd,
           CASE WHEN dt IS NULL OR (dt = 0 AND value = 0) THEN NULL WHEN dt = 0 THEN 0 ELSE value / dt END AS bw FROM d1),
    d3 AS (SELECT *, dd - lag(dd) OVER ({part}) AS ddd FROM d2)"""
    features = {
        '"(OLD) PacketCount"': "count(*)::DOUBLE", '"(OLD) TotalLength"': "sum(value)", '"(OLD) AverageLength"': "avg(value)",
        '"(OLD) MedianLength"': "median(value)", '"(OLD) MinLength"': "min(value)", '"(OLD) MaxLength"': "max(value)",
        '"(OLD) VarianceLength"': "var_samp(value)", '"(OLD) DifferentSourcePorts"': "count(DISTINCT port)::DOUBLE",
        '"(OLD) DifferentDestPorts"': "count(DISTINCT dest_port)::DOUBLE",
        "TcpPacketCount": "count(*) FILTER (WHERE protocol = 'TCP')::DOUBLE",
        "UdpPacketCount": "count(*) FILTER (WHERE protocol = 'UDP')::DOUBLE",
        "TcpUdpProtocolRatio": """count(*) FILTER (WHERE protocol = 'TCP') / CASE WHEN count(*) FILTER (WHERE protocol = 'UDP') = 0
            THEN 0.1::DOUBLE ELSE (count(*) FILTER (WHERE protocol = 'UDP'))::DOUBLE END""",
        "DifferentDestIPs": "count(DISTINCT user_id)::DOUBLE",
        "MeanInterPacketInterval": "avg(dt)", "VarianceInterPacketInterval": "var_samp(dt)",
        "MinInterPacketInterval": "min(dt)", "MaxInterPacketInterval": "max(dt)",
        "FirstDerivativeInterPacketInterval": "avg(dd)", "SecondDerivativeInterPacketInterval": "avg(ddd)",
        "AverageBandwidth": "avg(bw)", "VarianceBandwidth": "var_samp(bw)", "MinBandwidth": "min(bw)", "MaxBandwidth": "max(bw)",
    }
    body = "true AS hit, " + ", ".join(f"{e} AS {n}" for n, e in features.items())
    outs = ", ".join(f"CASE WHEN hit THEN {r(n, digits) if digits else n} ELSE 0.0::DOUBLE END AS {n}" for n in features)
    sql = grid_sql(width, origin, body, outs, label, packet_source(tied), extra=steps)
    return sql.replace("FROM rows_ GROUP BY", "FROM d3 GROUP BY")


def comparable(df):
    names = network.LENGTH_FEATURES + network.INTERVAL_FEATURES
    return rounded(df, 3, names)


@query("network_features", network_sql(6 * HOUR, "lo", None, False))
def network_features(t):
    """The 23 packet features per 6-hour window of one series."""
    return comparable(network.network_features(packets(t), "ts", "6h", (), "start", PACKET_COLUMNS))


@query("network_features_by_label", network_sql(3 * HOUR, "lo", "event_type", False))
def network_features_by_label(t):
    """A3: the same per label, each with its own origin; short windows leave gaps."""
    return comparable(network.network_features(packets(t), "ts", "3h", ["event_type"], "start", PACKET_COLUMNS))


@query("network_features_tied", network_sql(6 * HOUR, "lo", "event_type", True))
def network_features_tied(t):
    """Timestamps floored to the hour: many packets share an instant."""
    return comparable(network.network_features(packets(t, True), "ts", "6h", ["event_type"], "start", PACKET_COLUMNS))


BASIC = {
    "PacketCount": "count(*)::DOUBLE", "TotalLength": "sum(value)", "AverageLength": "avg(value)", "MedianLength": "median(value)",
    "MinLength": "min(value)", "MaxLength": "max(value)", "VarianceLength": "var_samp(value)",
    "DifferentSourcePorts": "count(DISTINCT port)::DOUBLE", "DifferentDestPorts": "count(DISTINCT dest_port)::DOUBLE",
    "TcpPacketCount": "count(*) FILTER (WHERE protocol = 'TCP')::DOUBLE",
    "UdpPacketCount": "count(*) FILTER (WHERE protocol = 'UDP')::DOUBLE",
}
COUNTED = ["PacketCount", "TotalLength", "DifferentSourcePorts", "DifferentDestPorts", "TcpPacketCount", "UdpPacketCount"]


@query(
    "network_features_basic",
    grid_sql(
        2 * HOUR, "0", ", ".join(f"{e} AS {n}" for n, e in BASIC.items()),
        ", ".join(f"coalesce({r(n, 3)}, 0.0::DOUBLE) AS {n}" if n in COUNTED else f"{r(n, 3)} AS {n}" for n in BASIC),
        "event_type", packet_source(False),
    ),
)
def network_features_basic(t):
    """A4: the older 11 features, nulls in empty windows."""
    table = network.basic_network_features(packets(t), "ts", "2h", ["event_type"], "epoch", PACKET_COLUMNS)
    return rounded(table, 3, list(BASIC))


@query(
    "packets_without_addresses",
    "SELECT event_id, user_id FROM events WHERE user_id NOT IN (3, 5, 8, 13, 21)",
)
def packets_without_addresses(t):
    """Packets of given addresses removed."""
    kept = network.exclude_addresses(t.events, [3, 5, 8, 13, 21], "user_id", "user_id")
    return kept.select("event_id", "user_id")


HIGH = "count(DISTINCT CASE WHEN value >= 100 THEN user_id END) AS c"


@query("high_entropy_files", grid_sql(2 * HOUR, "0", HIGH, "coalesce(c, 0) AS entropy_file_count", label=None))
def high_entropy_files(t):
    """A5: distinct files at or above the limit, windows without a hit stay at 0."""
    return entropy.high_entropy_files(t.events, "ts", "2h", (), "epoch", "user_id", "value", 100.0)


@query("high_entropy_files_by_label", grid_sql(2 * HOUR, "0", HIGH, "coalesce(c, 0) AS entropy_file_count"))
def high_entropy_files_by_label(t):
    """The same per label."""
    return entropy.high_entropy_files(t.events, "ts", "2h", ["event_type"], "epoch", "user_id", "value", 100.0)


@query("network_features_widths", " UNION ALL ".join(
    f"SELECT {w * HOUR}::BIGINT AS width_us, * FROM ({network_sql(w * HOUR, 'lo', 'event_type', False)})" for w in (2, 4, 6, 24)))
def network_features_widths(t):
    """The 23 features at four widths from one ladder of window partials."""
    return comparable(network.network_features_at_widths(packets(t), "ts", ["2h", "4h", "6h", "1d"], ["event_type"], "start", PACKET_COLUMNS))


SKETCH = 16
USER_HASH_SQL = "('0x' || substr(md5(user_id::VARCHAR), 1, 13))::BIGINT"


@query(
    "user_aggregate_windows",
    grid_sql(2 * HOUR, "0", f"list_sort(list_distinct(list({USER_HASH_SQL})))[1:{SKETCH}] AS h",
             f"CASE WHEN h IS NULL THEN 0 WHEN len(h) < {SKETCH} THEN len(h) ELSE {SKETCH - 1} * 4503599627370496::DOUBLE / (h[{SKETCH}] + 1) END::DOUBLE AS n_users"),
)
def user_aggregate_windows(t):
    """2.15, A5: a user's aggregate, here a sketch of different users per window, in place of the built-in count."""
    hashed = F.conv(F.substring(F.md5(F.col("user_id").cast("string")), 1, 13), 16, 10).cast("long")
    sketch = SmallestHashes("h", SKETCH, name="n_users")
    return window_aggregate(t.events.withColumn("h", hashed), "ts", "2h", sketch, ["event_type"], "epoch", {"n_users": 0})


def order_files(t):
    """Orders as file records: the priority digit is the extension, the lowest priority has none."""
    digit = F.substring("o_orderpriority", 1, 1)
    path = F.concat(F.lit("/tmp/f"), F.col("o_orderkey"), F.when(digit == "5", "").otherwise(F.concat(F.lit("."), digit)))
    return t.orders.select(
        F.col("o_orderdate").alias("ts"), F.col("o_orderstatus").alias("label"), path.alias("file_path"),
        (F.col("o_totalprice") / 50_000).alias("entropy"),
    )


ORDER_FILES_SQL = """SELECT o_orderdate AS ts, o_orderstatus AS label, o_totalprice / 50000 AS entropy,
    CASE WHEN o_orderpriority LIKE '5%' THEN 'no_filetype' ELSE substr(o_orderpriority, 1, 1) END AS term FROM orders"""
FILETYPE_SQL = f"""src AS ({ORDER_FILES_SQL}), w AS (SELECT *, epoch_us(ts) - epoch_us(ts) % {7 * DAY} AS win_us FROM src),
    docs AS (SELECT sum(c) AS n FROM (SELECT (max(win_us) - min(win_us)) / {7 * DAY} + 1 AS c FROM w GROUP BY label)),
    cnt AS (SELECT label, win_us, term, count(*) AS n FROM w WHERE entropy >= 5 GROUP BY ALL),
    idf AS (SELECT term, ln((1.0 + (SELECT n FROM docs)) / (1.0 + count(*))) + 1 AS idf FROM cnt GROUP BY term),
    v AS (SELECT label, win_us, term, cnt.n, cnt.n * idf AS w FROM cnt JOIN idf USING (term)),
    prof AS (SELECT label, win_us, term, n, w / sqrt(sum(w * w) OVER (PARTITION BY label, win_us)) AS tfidf FROM v)"""


@query("filetype_profile", f"WITH {FILETYPE_SQL} SELECT label, win_us, term, n, {r('tfidf')} AS tfidf FROM prof")
def filetype_profile(t):
    """TF-IDF of file extensions per (label, week)."""
    return rounded(entropy.filetype_profile(order_files(t), "ts", "7d", origin="epoch"), 6, ["tfidf"])


@query(
    "filetype_totals",
    f"WITH {FILETYPE_SQL} SELECT term, {r('sum(tfidf)', 4)} AS total FROM prof GROUP BY term ORDER BY sum(tfidf) DESC, term LIMIT 3",
)
def filetype_totals(t):
    profile = entropy.filetype_profile(order_files(t), "ts", "7d", origin="epoch")
    return rounded(entropy.filetype_totals(profile, 3), 4, ["total"])
