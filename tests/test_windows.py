import datetime as dt
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorloom.functions.timeparts import width_micros
from sensorloom.operators import buckets, entropy, network, timestamps


def at(spark, seconds, **extra):
    rows = [(i, float(s)) for i, s in enumerate(seconds)]
    df = spark.createDataFrame(rows, "id long, s double").withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")))
    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


def counts(df):
    return [(r["win_us"] / 1e6, r["n_rows"]) for r in df.orderBy("win_us").collect()]


TIMES = [100.2, 101, 137, 260]


@pytest.mark.parametrize(
    "origin,expected",
    [
        (93, [(93, 2), (133, 1), (173, 0), (213, 0), (253, 1)]),
        ("epoch", [(80, 2), (120, 1), (160, 0), (200, 0), (240, 1)]),
        ("start_day", [(80, 2), (120, 1), (160, 0), (200, 0), (240, 1)]),
        ("start", [(100.2, 3), (140.2, 0), (180.2, 0), (220.2, 1)]),
        ("global", [(100.2, 3), (140.2, 0), (180.2, 0), (220.2, 1)]),
    ],
)
def test_origins_and_gap_fill(spark, origin, expected):
    assert counts(buckets.window_count(at(spark, TIMES), "ts", "40s", (), origin)) == expected
    if origin in ("start", "start_day", "epoch"):
        by_series = buckets.window_count(at(spark, TIMES, label="a"), "ts", "40s", ["label"], origin)
        assert counts(by_series) == expected


def test_long_gap_spans_several_grid_chunks(spark):
    grid = buckets.window_grid(at(spark, [0, 30_000]), "ts", "1s")
    assert grid.count() == 30_001 and grid.distinct().count() == 30_001


def test_empty_input_gives_no_windows(spark):
    assert buckets.window_count(at(spark, TIMES).filter("id < 0"), "ts", "40s").count() == 0


def test_widths():
    assert width_micros("10min") == 600_000_000 and width_micros(20) == 20_000_000
    with pytest.raises(ValueError):
        width_micros("fast")


def test_epoch_unit_is_found_per_file(spark):
    rows = [("ms", "1700000000123"), ("ms", "1700000001999"), ("s", "1700000000.5"), ("s", "bad")]
    df = spark.createDataFrame(rows, "f string, Time string")
    out = timestamps.normalise_timestamps(df, ["f"], 1_800_000_000.0).select("f", F.unix_micros("ts").alias("us")).collect()
    assert sorted((r["f"], r["us"]) for r in out) == [
        ("ms", 1700000000000000), ("ms", 1700000001000000), ("s", 1700000000500000)
    ]
    assert timestamps.rejected_timestamps(df, ["f"]).filter("n_rejected = 1").collect()[0]["f"] == "s"


def pandas_twin(pdf, width_us, origin):
    """Row-by-row features of one series with pandas, from the description of the features."""
    pdf = pdf.sort_values(["us", "seq"])
    win = origin + (pdf["us"] - origin) // width_us * width_us
    out = {}
    for w in range(int(win.min()), int(win.max()) + 1, width_us):
        g = pdf[win == w]
        if g.empty:
            out[w] = {c: 0.0 for c in network.LENGTH_FEATURES + network.INTERVAL_FEATURES}
            continue
        gap = g["us"].diff() / 1e6
        with np.errstate(all="ignore"):
            band = (g["Length"] / gap).replace(np.inf, 0)
        tcp, udp = int((g["Protocol"] == "TCP").sum()), int((g["Protocol"] == "UDP").sum())
        n = g["Length"]
        out[w] = {
            "(OLD) PacketCount": len(g), "(OLD) TotalLength": n.sum(), "(OLD) AverageLength": n.mean(),
            "(OLD) MedianLength": n.median(), "(OLD) MinLength": n.min(), "(OLD) MaxLength": n.max(),
            "(OLD) VarianceLength": n.var(), "(OLD) DifferentSourcePorts": g["SourcePort"].nunique(),
            "(OLD) DifferentDestPorts": g["DestPort"].nunique(), "DifferentDestIPs": g["DestIP"].nunique(),
            "TcpPacketCount": tcp, "UdpPacketCount": udp, "TcpUdpProtocolRatio": tcp / (udp or 0.1),
            "MeanInterPacketInterval": gap.mean(), "VarianceInterPacketInterval": gap.var(),
            "MinInterPacketInterval": gap.min(), "MaxInterPacketInterval": gap.max(),
            "FirstDerivativeInterPacketInterval": gap.diff().mean(),
            "SecondDerivativeInterPacketInterval": gap.diff().diff().mean(),
            "AverageBandwidth": band.mean(), "VarianceBandwidth": band.var(), "MinBandwidth": band.min(), "MaxBandwidth": band.max(),
        }
    return out


@pytest.mark.parametrize("step", [1_000_000, 250_000, 1])
def test_network_features_match_pandas_with_ties_and_a_hot_window(spark, step):
    rng = np.random.default_rng(step)
    n = 600
    us = rng.integers(0, 400_000_000, n) // step * step
    us[: n // 3] = 50_000_000 // step * step  # a third of all packets at one instant
    pdf = pd.DataFrame({
        "us": us, "seq": np.arange(n), "label": rng.choice(["a", "b"], n), "Length": rng.choice([0, 40, 60, 1500], n).astype(float),
        "Protocol": rng.choice(["TCP", "UDP", "ICMP"], n), "SourcePort": rng.integers(0, 50, n), "DestPort": rng.integers(0, 5, n),
        "DestIP": rng.choice(list("xyz"), n),
    })
    pdf.loc[pdf.index[-1], "us"] = 900_000_000  # a long gap
    df = spark.createDataFrame(pdf).withColumn("ts", F.timestamp_micros("us")).withColumnRenamed("seq", "row_seq")
    got = network.network_features(df, "ts", "20s", ["label"], "start").collect()
    seen = 0
    for label, part in pdf.groupby("label"):
        expected = pandas_twin(part, 20_000_000, int(part["us"].min()))
        mine = {r["win_us"]: r for r in got if r["label"] == label}
        assert set(mine) == set(expected)
        for w, features in expected.items():
            for name, value in features.items():
                found = mine[w][name]
                if value != value:
                    assert found is None, (w, name, found)
                else:
                    assert found == pytest.approx(value, rel=1e-9, abs=1e-9), (w, name)
                seen += 1
    assert seen > 1000


def burst(rng, n):
    """Packets of two labels; a third of them fall into two seconds of one window."""
    us = rng.integers(0, 3_000_000_000, n)
    us[: n // 3] = 1_000_000_000 + rng.integers(0, 2_000_000, n // 3)
    return pd.DataFrame({
        "us": us, "seq": np.arange(n), "label": rng.choice(["a", "b"], n, p=[0.9, 0.1]), "Length": np.where(rng.random(n) < 0.5, 40, rng.random(n) * 1500),
        "Protocol": rng.choice(["TCP", "UDP", "ICMP"], n), "SourcePort": rng.integers(0, 500, n), "DestPort": rng.integers(0, 5, n),
        "DestIP": rng.choice(list("xyz"), n),
    })


def same_features(got, pdf, width_us):
    seen = 0
    for label, part in pdf.groupby("label"):
        expected = pandas_twin(part, width_us, int(part["us"].min()))
        mine = {r["win_us"]: r for r in got if r["label"] == label and r["width_us"] == width_us}
        assert set(mine) == set(expected)
        for w, features in expected.items():
            for name, value in features.items():
                found = mine[w][name]
                if value != value:
                    assert found is None, (w, name, found)
                else:
                    assert found == pytest.approx(value, rel=1e-7, abs=1e-7), (w, name)
                seen += 1
    return seen


@pytest.mark.parametrize("limit", [100_000, 20])
def test_all_widths_from_one_ladder_match_pandas(spark, monkeypatch, limit):
    from sensorloom.operators import ranks

    if limit < 100:  # crowded windows: many slices, medians by rounds
        monkeypatch.setattr(network, "SLICE_ROWS", limit)
        monkeypatch.setattr(ranks, "FEW", limit)
        monkeypatch.setattr(ranks, "CELLS", 8)
    pdf = burst(np.random.default_rng(limit), 600)
    df = spark.createDataFrame(pdf).withColumn("ts", F.timestamp_micros("us")).withColumnRenamed("seq", "row_seq")
    widths = [20, 60, 960]
    got = network.network_features_at_widths(df, "ts", widths, ["label"]).collect()
    assert sum(same_features(got, pdf, w * 1_000_000) for w in widths) > 3000


def test_a_crowded_base_window_is_cut_by_time(spark, monkeypatch):
    monkeypatch.setattr(network, "SLICE_ROWS", 50)
    rows = [(0, i * 10) for i in range(1000)] + [(1, 20_000_000 + i) for i in range(10)]
    instants = spark.createDataFrame(rows, "base long, t long")
    sizes = [r["count"] for r in network.sliced(instants, [], 20_000_000).groupBy("base", "slice").count().collect()]
    assert sum(sizes) == 1010 and len(sizes) == 2  # all instants within 10 ms: the shortest slice asked for is still longer
    spread = spark.createDataFrame([(0, i * 20_000) for i in range(1000)], "base long, t long")
    sizes = [r["count"] for r in network.sliced(spread, [], 20_000_000).groupBy("base", "slice").count().collect()]
    assert sum(sizes) == 1000 and len(sizes) >= 20 and max(sizes) <= 50


def test_packets_are_read_twice_whatever_the_number_of_widths(spark, tmp_path):
    from sensorloom import session

    pdf = burst(np.random.default_rng(3), 300)
    spark.createDataFrame(pdf).withColumn("ts", F.timestamp_micros("us")).withColumnRenamed("seq", "row_seq").write.parquet(str(tmp_path / "packets"))
    df, before = spark.read.parquet(str(tmp_path / "packets")), len(session.STORED)
    tables, plans = session.materialise, []

    def watched(frame):
        plans.append(frame._jdf.queryExecution().optimizedPlan().toString())
        return tables(frame)

    from sensorloom.operators import buckets as b, lookup, ranks
    for module in (network, b, lookup, ranks):
        module.materialise = watched
    try:
        out = network.network_features_at_widths(df, "ts", [10, 20, 30, 60, 120, 300, 600], ["label"])
    finally:
        for module in (network, b, lookup, ranks):
            module.materialise = tables
    plans.append(out._jdf.queryExecution().optimizedPlan().toString())
    assert sum(len(re.findall(r"Relation \[[^\]]*row_seq#", p)) for p in plans) == 2 and len(session.STORED) > before


def test_no_packets_give_no_windows(spark):
    df = at(spark, [0, 1, 2], Protocol="TCP", SourcePort=1, DestPort=2, DestIP="x", Length=10.0, row_seq=1, label="a").filter("id < 0")
    for series in ([], ["label"]):
        assert network.network_features_at_widths(df, "ts", [20, 40], series).count() == 0
        assert network.basic_network_features(df, "ts", 20, series).count() == 0


def test_no_udp_divides_by_a_tenth(spark):
    df = at(spark, [0, 1, 2], Protocol="TCP", SourcePort=1, DestPort=2, DestIP="x", Length=10.0, row_seq=1)
    row = network.network_features(df, "ts", "1min", (), "epoch").collect()[0]
    assert row["TcpUdpProtocolRatio"] == pytest.approx(30.0)


def test_bandwidth_cases(spark):
    df = spark.createDataFrame([(0, 0, 5.0), (1, 0, 7.0), (2, 500_000, 4.0)], "row_seq int, us long, Length double")
    df = df.withColumns({"ts": F.timestamp_micros("us"), "Protocol": F.lit("UDP"), "SourcePort": F.lit(1), "DestPort": F.lit(1), "DestIP": F.lit("x")})
    row = network.network_features(df, "ts", "10s").collect()[0]
    assert (row["MinBandwidth"], row["MaxBandwidth"], row["AverageBandwidth"]) == (0.0, 8.0, 4.0)


def test_excluded_addresses_keep_null_rows(spark):
    df = spark.createDataFrame([("a", "b"), ("c", None), (None, "a"), (None, None)], "SourceIP string, DestIP string")
    assert network.exclude_addresses(df, ["a"]).count() == 2


def test_high_entropy_windows_without_hits_are_zero(spark):
    rows = [(0.0, "x", 7.0), (1.0, "x", 8.0), (2.0, "y", 5.9), (35.0, "z", 1.0)]
    df = spark.createDataFrame(rows, "s double, file_path string, entropy double").withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("long")))
    out = entropy.high_entropy_files(df, "ts", "10s").orderBy("win_us").collect()
    assert [r["entropy_file_count"] for r in out] == [1, 0, 0, 0]


def test_file_types(spark):
    names = ["/a/b.txt", "/a/.hidden", "/a.b/c", "/tmp/x.tar.gz", "/tmp/wdg", "/a/b."]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    found = {r["p"]: r["t"] for r in df.select("p", entropy.file_type(F.col("p")).alias("t")).collect()}
    assert found == {"/a/b.txt": "txt", "/a/.hidden": "no_filetype", "/a.b/c": "no_filetype", "/tmp/x.tar.gz": "gz",
                     "/tmp/wdg": "no_filetype", "/a/b.": "no_filetype"}


def test_streaming_windows_equal_batch(spark, tmp_path):
    from sensorloom.streaming.live_windows import live_high_entropy_files, live_window_mean

    rows = [(i, float(i % 7), "a" if i % 2 else "b", f"f{i % 5}") for i in range(200)]
    df = spark.createDataFrame(rows, "s long, entropy double, label string, file_path string")
    df = df.withColumn("ts", F.timestamp_seconds("s"))
    late = df.limit(1).withColumn("ts", F.timestamp_seconds(F.lit(10_000)))  # moves the watermark past all windows
    source = str(tmp_path / "in")
    df.coalesce(1).write.parquet(source)
    late.coalesce(1).write.mode("append").parquet(source)
    for name, build in {
        "means": lambda s: live_window_mean(s, "ts", "40s", ["entropy"], ["label"], origin=13),
        "files": lambda s: live_high_entropy_files(s, "ts", "40s", ["label"], origin=13),
    }.items():
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
        run = build(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        run.processAllAvailable()
        run.stop()
    mean = buckets.window_agg(df, "ts", "40s", [F.avg("entropy").alias("entropy")], ["label"], 13, keep_gaps=False)
    expected = {(r["label"], r["win_us"]): r["entropy"] for r in mean.collect()}
    got = {(r["label"], int(r["win_start"].replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)): r["entropy"] for r in spark.table("means").collect()}
    assert got and all(expected[k] == pytest.approx(v) for k, v in got.items()) and len(got) == len(expected)
    assert spark.table("files").count() == len(expected)


def test_user_aggregates_do_not_depend_on_the_partitions(spark, monkeypatch):
    from sensorloom.operators import user_aggregates

    rng = np.random.default_rng(6)
    n = 4000
    pdf = pd.DataFrame({"s": np.where(rng.random(n) < 0.6, 50, rng.integers(0, 2000, n)).astype(float), "label": rng.choice(["a", None], n), "h": rng.integers(0, 1 << 40, n) % 997})
    df = spark.createDataFrame(pdf).withColumn("label", F.when(F.col("label") == "a", "a").otherwise("b")).withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")))
    seen = []
    for parts in (1, 64):
        sketch = user_aggregates.SmallestHashes("h", 32, 1 << 40)
        rows = user_aggregates.window_aggregate(df.repartition(parts), "ts", 100, sketch, ["label"], fills={"n_distinct": 0}).collect()
        seen.append(sorted((r["label"], r["win_us"], r["n_distinct"]) for r in rows))
    assert seen[0] == seen[1] and len(seen[0]) == 40
    whole = pdf.assign(label=pdf["label"].fillna("b"), w=pdf["s"] // 100 * 100_000_000)
    for (label, w), group in whole.groupby(["label", "w"]):
        values = np.unique(group["h"])
        expected = float(len(values)) if len(values) < 32 else 31 * (1 << 40) / (values[31] + 1)
        assert (label, int(w), expected) in seen[0]
    none = user_aggregates.aggregate_by_key(df.filter("s < 0"), ["label"], user_aggregates.SmallestHashes("h"))
    assert none.count() == 0
    nulls = df.withColumn("label", F.lit(None).cast("string")).withColumn("h", F.lit(None).cast("long"))
    assert [tuple(r) for r in user_aggregates.aggregate_by_key(nulls, ["label"], user_aggregates.SmallestHashes("h")).collect()] == [(None, 0.0)]


def test_streamed_intervals_equal_the_batch_and_late_packets_are_counted(spark, tmp_path):
    from sensorloom.streaming.live_intervals import live_interval_features

    rng = np.random.default_rng(2)
    us = np.sort(rng.integers(0, 200_000_000, 300) // 500_000 * 500_000)
    pdf = pd.DataFrame({"us": us, "row_seq": np.arange(300), "label": rng.choice(["a", "b"], 300), "Length": rng.choice([0.0, 40.0, 1500.0], 300)})
    pdf["Protocol"], pdf["SourcePort"], pdf["DestPort"], pdf["DestIP"] = "TCP", 1, 2, "x"
    whole = spark.createDataFrame(pdf).withColumn("ts", F.timestamp_micros("us"))
    late = spark.createDataFrame([(int(us[120]) - 1, 900, "a", 7.0, "TCP", 1, 2, "x")], list(pdf.columns)).withColumn("ts", F.timestamp_micros("us"))
    end = whole.limit(1).withColumn("ts", F.timestamp_micros(F.lit(900_000_000))).withColumn("label", F.lit("z"))
    source = str(tmp_path / "packets")
    for part in (whole.filter(f"us <= {us[150]}"), late, whole.filter(f"us > {us[150]}"), end, end):
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(whole.schema).parquet(source)
        live_interval_features(stream, "ts", "20s", ["label"], "1 minute").writeStream.format("parquet").outputMode("append").option(
            "checkpointLocation", str(tmp_path / "offsets")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    got = {(r["label"], r["win_us"]): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = network.network_features(whole, "ts", "20s", ["label"], "epoch").filter("`(OLD) PacketCount` > 0").collect()
    assert sum(r["n_late"] for r in got.values()) == 1 and set(got) == {(r["label"], r["win_us"]) for r in batch}
    for r in batch:
        mine = got[r["label"], r["win_us"]]
        assert mine["n_packets"] == r["(OLD) PacketCount"]
        for name in network.INTERVAL_FEATURES:
            assert mine[name] == (None if r[name] is None else pytest.approx(r[name], rel=1e-9, abs=1e-9)), name
