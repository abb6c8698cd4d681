import zipfile

import pytest
from pyspark.sql import functions as F

from sensorloom.operators.timestamps import normalise_timestamps
from sensorloom.plans.call_encoding import call_documents, call_vocabulary, encode_documents
from sensorloom.plans.device_merge import merge_device
from sensorloom.schema import LABELS, SourceRegistry, registry_from_headers
from sensorloom.sources import archive_source, archives, catalog, claims, logs, sinks, tables

BLOCK = "read_ops,write_ops,read_kbs,write_kbs,avgrq_sz,avg_queue,await,r_await,w_await,svctm,util"


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    root = tmp_path_factory.mktemp("run") / "0_raw_collected_data"

    def put(path, content):
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(content)

    values = ",".join(["1"] * 9)
    put("Lab/dev1/1_normal_4h/Block/b1.csv", f"timestamp,{BLOCK}\n1700000000,2,4,{values}\n1700000010,4,8,{values}\nbad,1,1,{values}\n")
    swapped = BLOCK.replace("read_ops,write_ops", "write_ops,read_ops")
    put("Lab/dev1/9_xmrig/Block/b2.csv", f"time,{swapped},index\n1700000065000,6,10,{values},0\n")
    put("Lab/dev1/1_normal/NET/n1.csv", "Time,Protocol,SourceIP,SourcePort,DestIP,DestPort,Length\n1700000001.25,TCP,a,1,b,2,60\n1700000002.25,UDP,a,1,c,3,40\n")
    put("Lab/dev1/1_normal/Entropy/e1.csv", "timestamp,file_path,action,entropy\n1700000003,/x/a.bin,w,7.5\n1700000004,/x/b.txt,w,1.0\n")
    put("Lab/dev1/1_normal/Block/readme.txt", "junk")
    zips = root / "Lab/dev1/1_normal/SYS_data"
    zips.mkdir(parents=True)
    with zipfile.ZipFile(zips / "s1.zip", "w") as z:
        for i in range(150):
            z.writestr(f"SYS/{1700000000 + i}.log", f"x open(arg0) read(arg0) {'futex(arg0) ' * (i % 3)} \n close(arg0: 1)")
        z.writestr("__MACOSX/SYS/._1.log", "x bad(arg0)")
        z.writestr("SYS/notes.md", "x bad(arg0)")
        z.writestr("SYS/1800000000.log", b"\xff\xfe open(arg0)")
    (zips / "broken.zip").write_bytes(b"not a zip")
    return str(root)


@pytest.fixture(scope="module")
def files(spark, raw):
    return catalog.build_catalog(catalog.list_files(spark, raw))


def source(spark, files, name):
    rows = tables.read_source(spark, files.filter(F.col("data_source") == name))
    return normalise_timestamps(rows, [tables.ORIGIN], 1_750_000_000.0)


def test_catalog(spark, raw, files):
    rows = {r["file_name"]: r for r in files.collect()}
    assert set(rows) == {"b1.csv", "b2.csv", "n1.csv", "e1.csv", "s1.zip", "broken.zip"}
    assert rows["b1.csv"]["label"] == "1_normal" and rows["b1.csv"]["data_source"] == "block_data" and rows["b1.csv"]["device"] == "Lab_dev1"
    assert rows["s1.zip"]["filetype"] == "zip" and rows["s1.zip"]["filesize_bytes"] > 100
    with pytest.raises(Exception, match="collection layout"):
        bad = spark.createDataFrame([("/elsewhere/x.csv", 1)], "file_path string, filesize_bytes long")
        catalog.build_catalog(bad).collect()
    assert catalog.build_catalog(bad, strict=False).isEmpty() and catalog.rejected_paths(bad).count() == 1


def test_csv_with_other_column_order_and_units(spark, files):
    rows = source(spark, files, "block_data").select("label", "read_ops", "write_ops", F.unix_seconds("ts").alias("s")).collect()
    assert sorted((r["label"], r["read_ops"], r["write_ops"], r["s"]) for r in rows) == [
        ("1_normal", 2.0, 4.0, 1700000000), ("1_normal", 4.0, 8.0, 1700000010), ("9_xmrig", 10.0, 6.0, 1700000065)
    ]
    with pytest.raises(ValueError, match="only csv"):
        tables.read_source(spark, files.filter("filetype = 'zip'"))


def test_headers_and_registry(spark, files):
    paths = [r["file_path"] for r in files.filter("filetype = 'csv'").collect()]
    headers = catalog.header_inventory(spark, paths)
    registry = SourceRegistry()
    found = {registry.classify(r["columns"]) for r in headers.collect()}
    assert found == {"block_data", "network_data", "entropy_data"}
    assert registry.source_of("util") == "block_data" and registry.by_name("NET") == "network_data"
    with pytest.raises(ValueError):
        registry.classify(["a"])
    learned = registry_from_headers(spark.createDataFrame(
        [("RES_data", ["time", "cpu", "a7"]), ("RES_data", ["cpu", "a15"]), ("KERN_data", ["cpu", "cs"])], "data_source string, columns array<string>"
    ))
    assert learned.source_of("cpu") == "KERN_data" and {learned.classify(["a15", "cpu"]), learned.classify(["a7", "cpu"])} == {"RES_data", "RES_data_rp4"}
    assert not learned.wanted("KERN_data", ["a7"]) and learned.wanted("network_data", [])


def test_archives(spark, files, monkeypatch):
    zips = files.filter("filetype = 'zip'")
    rows = archives.read_archives(zips).collect()
    assert len(rows) == 152 and sum(r["content"] is None for r in rows) == 2
    assert [r["entry"] for r in rows if r["error"] and r["entry"] is None] == [None]  # the unreadable archive
    assert archives.archive_timestamps(zips).count() == 151
    entries = archives.archive_entries(zips)
    assert entries.filter("error is not null").count() == 1
    # One archive is read by several tasks.
    monkeypatch.setattr(archives, "ENTRY_RANGE", 8)
    tasks = archives.read_archives(zips).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 1


def test_call_encoding_job(spark, files, tmp_path):
    documents = call_documents(files.filter("filetype = 'zip'"))
    assert {r["term"] for r in call_vocabulary(documents).collect()} == {"open", "read", "futex", "close"}
    vocab = sinks.load_or_build(spark, str(tmp_path / "vocab"), lambda: call_vocabulary(documents))
    again = sinks.load_or_build(spark, str(tmp_path / "vocab"), lambda: 1 / 0)
    assert vocab.count() == again.count() == 4
    table = encode_documents(documents, ["device", "timestamp"], vocab=vocab)
    assert table.groupBy("device", "timestamp").count().count() == 150


def test_extraction_runs_once(spark, files, tmp_path):
    zips = files.filter("file_name = 's1.zip'")
    target, manifest = str(tmp_path / "calls"), str(tmp_path / "done")

    def simple(todo):
        return call_documents(todo).select("timestamp", "calls", "device", "label", F.lit("s1.zip").alias("file_name"))

    assert sinks.extract_pending(spark, zips, target, manifest, simple) == 1
    assert sinks.extract_pending(spark, zips, target, manifest, simple) == 0
    assert spark.read.parquet(target).count() == 150


def test_unreadable_archives_are_tried_again(spark, files, tmp_path):
    zips, target, manifest = files.filter("filetype = 'zip'"), str(tmp_path / "calls"), str(tmp_path / "done")
    n = zips.count()

    def extract(todo):
        return call_documents(todo, keep_errors=True)

    # One archive cannot be opened, the other holds an unreadable entry: what can be read is there, neither counts as done.
    assert sinks.extract_pending(spark, zips, target, manifest, extract) == 0
    assert sinks.pending(spark, zips, manifest).count() == n and spark.read.parquet(target).count() == 150


def test_paths_with_blanks_and_files_without_a_dot(spark, tmp_path):
    folder = tmp_path / "a b%20c+d" / "0_raw_collected_data" / "Lab" / "dev1" / "1_normal" / "KERN_data"
    folder.mkdir(parents=True)
    (folder / "k.csv").write_text("timestamp,cpu,x y\n1700000000,1,nan\n1700000001,3,4\n")
    (folder / "README").write_text("no data")
    listed = catalog.build_catalog(catalog.list_files(spark, str(tmp_path)))
    rows = tables.read_source(spark, listed).collect()
    assert sorted((r["label"], r["device"], r["cpu"], r["x y"]) for r in rows) == [("1_normal", "Lab_dev1", 1.0, None), ("1_normal", "Lab_dev1", 3.0, 4.0)]


def test_a_source_with_default_registry_is_merged(spark, tmp_path):
    folder = tmp_path / "0_raw_collected_data" / "Lab" / "dev1" / "1_normal" / "KERN_data"
    folder.mkdir(parents=True)
    (folder / "k.csv").write_text("timestamp,cpu,irq\n1700000000,1,2\n1700000001,3,4\n")
    listed = catalog.build_catalog(catalog.list_files(spark, str(tmp_path)))
    rows = tables.read_source(spark, listed).withColumn("ts", F.timestamp_seconds(F.col("timestamp").cast("long")))
    merged = merge_device({"KERN_data": rows}, ["cpu"], "10s").collect()
    assert [(r["cpu"], r["label"]) for r in merged] == [(2.0, "1_normal")]


def test_all_header_variants_are_learned(spark):
    rows = [("RES_data", ["a", "b"]), ("RES_data", ["a", "c"]), ("RES_data", ["a", "d", "e"]), ("KERN_data", ["k"]), ("KERN_data", ["k", "l"])]
    learned = registry_from_headers(spark.createDataFrame(rows, "data_source string, columns array<string>"))
    assert {learned.classify(c) for _, c in rows} == {"RES_data", "RES_data_rp4", "RES_data_v3", "KERN_data", "KERN_data_v2"}
    assert learned.wanted("RES_data", ["c"]) and not learned.wanted("RES_data", ["k"])


def test_stored_tables_are_dropped(spark):
    import os

    from sensorloom import session

    session.drop_tables(spark)
    table = session.materialise(spark.range(5))
    folder = session.STORED[0].removeprefix("file:")
    assert table.count() == 5 and os.path.isdir(folder)
    assert session.drop_tables(spark) == 1 and not os.path.exists(folder) and not session.STORED


def test_a_local_folder_is_refused_on_a_cluster(spark, monkeypatch):
    from sensorloom import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_device_merge_from_files(spark, files):
    documents = call_documents(files.filter("filetype = 'zip'")).withColumn("ts", F.timestamp_seconds(F.col("timestamp").cast("long")))
    calls = encode_documents(documents, ["device", "timestamp", "ts"]).withColumnRenamed("timestamp", "doc").withColumnRenamed("tfidf", "value")
    merged = merge_device(
        {s: source(spark, files, s) for s in ("block_data", "network_data", "entropy_data")},
        ["read_ops", "TcpPacketCount", "entropy_file_count", "futex"], "30s", calls=calls,
    )
    rows = sorted(merged.collect(), key=lambda r: (r["win_us"], r["label"] or ""))
    assert set(merged.columns) == {"device", "win_us", "read_ops", "TcpPacketCount", "entropy_file_count", "label", "futex"}
    assert rows[0]["win_us"] == 1700000000 * 10**6 and rows[0]["read_ops"] == 3.0 and rows[0]["TcpPacketCount"] == 1
    assert rows[0]["entropy_file_count"] == 1 and rows[0]["futex"] > 0
    assert [r["read_ops"] for r in rows if r["label"] == "9_xmrig"] == [10.0]
    assert len(rows) == 5  # the calls run over 150 seconds, the other sources over 65


def test_score_files_and_metrics(spark, tmp_path):
    scores = spark.createDataFrame([(1.0, 2.0, 3.0, "x", "1_normal")], "chi2 double, f_classif double, mutual_info_classif double, feature string, label string")
    folder = tmp_path / "result"
    folder.mkdir()
    scores.toPandas().to_csv(folder / "RES_data_Lab_dev1_scores_ROBUST.csv", index=False)
    scores.toPandas().to_csv(folder / "KERN_data_Lab_dev1_scores.csv", index=False)
    rows = {r["data_source"]: r for r in tables.read_scores(spark, str(folder)).collect()}
    assert rows["RES_data"]["is_robust"] and not rows["KERN_data"]["is_robust"] and rows["KERN_data"]["device"] == "Lab_dev1"
    log = spark.createDataFrame([(1, "Test/F1")], "p int, tag string").withColumn("file_ts", F.to_timestamp(F.lit("2024-07-17 20:21:33")))
    sinks.write_table(log, str(tmp_path / "log"))
    assert tables.read_metrics(spark, str(tmp_path / "log"), "17/07/2024 20:21:33").count() == 1
    assert tables.read_metrics(spark, str(tmp_path / "log"), "17/07/2024 20:21:34").count() == 0


def test_loose_logs_and_json(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1700000001.log").write_text(" Summary of events:\n svc (1), 2 events, 0.5%\n\n------\n")
    (tmp_path / "a" / "x.txt").write_text("junk")
    parsed = logs.parse_summaries(logs.read_logs(spark, str(tmp_path)))
    row = parsed.collect()[0]
    assert row["timestamp"] == "1700000001" and parsed.count() == 1
    sinks.write_table(parsed.select("timestamp", "processes"), str(tmp_path / "json"), fmt="json")
    assert spark.read.json(str(tmp_path / "json")).count() == 1 and len(LABELS) == 9


def plain_extract(todo):
    return todo.select("file_path", F.lit(1).alias("n"))


@pytest.fixture()
def listing(spark):
    return spark.createDataFrame([(f"/data/{i}.csv",) for i in range(30)], "file_path string")


def published(spark, target):
    rows = claims.read_extracted(spark, target)
    return [] if rows is None else sorted(r["file_path"] for r in rows.collect())


def test_two_runs_at_once_extract_every_file_once(spark, listing, tmp_path):
    target, everything = str(tmp_path / "t"), [f"/data/{i}.csv" for i in range(30)]
    a, b = (claims.Extraction(spark, listing, target, buckets=8) for _ in range(2))
    assert a.claim() == 30 and b.claim() == 0  # all buckets are taken
    assert claims.extract_claimed(spark, listing, target, plain_extract, buckets=8) == 0
    a.write(plain_extract)
    assert published(spark, target) == []  # written, not committed
    assert len(a.commit()) == 8 and published(spark, target) == sorted(everything)
    assert a.commit() == []  # once only
    more = listing.union(spark.createDataFrame([("/data/new.csv",)], "file_path string"))
    assert claims.extract_claimed(spark, more, target, plain_extract, buckets=8) == 1
    assert published(spark, target) == sorted([*everything, "/data/new.csv"])


@pytest.mark.parametrize("step", ["claimed", "written", "committed"])
def test_a_lost_run_is_taken_over_and_cannot_come_back(spark, listing, tmp_path, step):
    target, clock = str(tmp_path / "t"), [1000.0]
    lost = claims.Extraction(spark, listing, target, buckets=4, lease_seconds=60, now=lambda: clock[0])
    lost.claim()
    if step != "claimed":
        lost.write(plain_extract)
    if step == "committed":
        assert len(lost.commit()) == 4
    run = lambda: claims.extract_claimed(spark, listing, target, plain_extract, buckets=4, lease_seconds=60, now=lambda: clock[0])
    assert run() == 0
    clock[0] += 61
    assert run() == (0 if step == "committed" else 30)
    if step == "claimed":
        lost.write(plain_extract)
    assert lost.commit() == []
    assert published(spark, target) == sorted(f"/data/{i}.csv" for i in range(30))


def test_the_first_of_holder_and_successor_wins(spark, tmp_path):
    markers, clock = claims.Markers(spark, str(tmp_path / "m")), [0.0]
    now = lambda: clock[0]
    assert claims.claim_buckets(markers, "a", [0, 1], 10, now) == [claims.Claim(0, 1), claims.Claim(1, 1)]
    assert claims.claim_buckets(markers, "b", [0, 1], 10, now) == []
    assert markers.create("records/0-1", {"run": "a"})
    clock[0] = 11
    assert claims.claim_buckets(markers, "b", [0, 1], 10, now) == [claims.Claim(0, 2), claims.Claim(1, 2)]
    assert not markers.create("records/1-1", {"run": "a"}) and markers.create("records/1-2", {"run": "b"})
    assert claims.committed_folders(markers) == ["a/bucket=0", "b/bucket=1"]


def test_files_with_errors_are_tried_again(spark, listing, tmp_path):
    target, bad = str(tmp_path / "t"), ["/data/3.csv"]

    def extract(todo):
        return plain_extract(todo).withColumn("error", F.when(F.col("file_path").isin(bad), "broken"))

    assert claims.extract_claimed(spark, listing, target, extract, buckets=4) == 29
    bad.clear()
    assert claims.extract_claimed(spark, listing, target, lambda todo: extract(todo).withColumn("error", F.lit(None).cast("string")), buckets=4) == 1
    assert len(published(spark, target)) == 30


def test_archives_as_a_data_source(spark, files, raw):
    archive_source.register(spark)
    read = lambda n: spark.read.format("log_archives").option("taskBytes", n).load(raw)
    rows = read(1 << 30).collect()
    assert sum(r["content"] is not None for r in rows) == 150 and sum(r["error"] is not None for r in rows) == 2
    assert sorted(map(repr, read(500).collect())) == sorted(map(repr, rows)) and read(500).rdd.getNumPartitions() > 3
    some = read(1 << 30).filter(F.col("entry").startswith("SYS/17000000") & F.col("entry").endswith("7.log") & F.col("file_path").endswith("s1.zip"))
    assert some.count() == 10
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "StringEndsWith" not in plan.split("BatchScan")[0] and "EndsWith" not in plan.split("BatchScan")[0]
    counted = archive_source.log_parser(lambda text: [(w,) for w in text.split("(")[:1]], "first string")
    parsed = some.lateralJoin(counted(F.col("content").outer()))
    assert {r["first"] for r in parsed.collect()} == {"x open"}


def test_pushed_conditions_rule_archives_out(raw):
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringEndsWith

    reader = archive_source.ArchiveReader(raw, 1 << 30)
    left = list(reader.pushFilters([StringEndsWith(("file_path",), "s1.zip"), EqualTo(("entry",), "SYS/1700000001.log"), GreaterThan(("entry",), "a"), EqualTo(("content",), "x")]))
    assert [type(f) for f in left] == [GreaterThan, EqualTo]
    shares = reader.partitions()
    assert [s.path.rsplit("/")[-1] for s in shares] == ["s1.zip"]
    assert [r[1] for s in shares for r in reader.rows(s)] == ["SYS/1700000001.log"]


def test_metrics_taken_in_three_arrivals_equal_one_read(spark, tmp_path):
    from sensorloom.operators import reports
    from sensorloom.streaming import live_metrics

    schema = "participant string, file_ts timestamp, tag string, step long, value double, ts timestamp"
    rows = [(f"p{p}", "2024-01-0%d 00:00:00" % (1 + k), f"Test/{t}", s, float(p * 100 + s * 10 + k) if s != 2 else None, "2024-01-0%d 00:00:0%d" % (1 + k, s))
            for k in range(3) for p in range(3) for t in ("a", "b") for s in range(4)] + [("p0", "2023-12-31 00:00:00", "Test/a", 9, 1e9, "2025-01-01 00:00:00")]
    table = spark.createDataFrame(rows, "participant string, f string, tag string, step long, value double, t string").selectExpr(
        "participant", "CAST(f AS TIMESTAMP) AS file_ts", "tag", "step", "value", "CAST(t AS TIMESTAMP) AS ts")
    source, target, offsets = (str(tmp_path / x) for x in ("log", "values", "offsets"))
    for day in (2, 3, 1):  # the oldest file comes last
        table.filter(F.day("ts") == day).coalesce(1).write.mode("append").parquet(source)
        assert live_metrics.take_new_metrics(spark, source, schema, target, offsets, "01/01/2024 00:00:00") >= 1
    assert live_metrics.take_new_metrics(spark, source, schema, target, offsets, "01/01/2024 00:00:00") == 0  # nothing new
    live = {(r["participant"], r["tag"]): r["value"] for r in live_metrics.current_values(spark, target).collect()}
    whole = reports.last_values(tables.since(table, "file_ts", "01/01/2024 00:00:00"), ["participant", "tag"], "value", ["ts", "step"])
    assert live == {(r["participant"], r["tag"]): r["value"] for r in whole.collect()} and len(live) == 6
