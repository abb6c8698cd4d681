"""Sources and sinks: tables are written as files below the checkpoint folder and read back through the library."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from sensorloom.operators import processes, text
from sensorloom.schema import registry_from_headers
from sensorloom.sources import archive_source, archives, catalog, claims, logs, sinks, tables
from sensorloom.sources.files import write_file
from sensorloom.workload.registry import query
from sensorloom.workload.text_queries import PROC_SQL, TOK_SQL, order_logs, tokens

DOCS_PER_ARCHIVE = 1000


def scratch(t) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{t.spark.sparkContext.getCheckpointDir()}/raw/{uuid.uuid4().hex}"


def collection(t):
    """The events as CSV files in the layout of a raw collection, one folder per event type; the catalog of the files."""
    root = scratch(t)
    rows = t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"), "value", "user_id", "event_type")
    for kind in [r[0] for r in t.events.select("event_type").distinct().collect()]:
        folder = f"{root}/0_raw_collected_data/Lab/device1/{kind}/events_data"
        sinks.write_table(rows.filter(F.col("event_type") == kind).drop("event_type"), folder, fmt="csv")
    return catalog.build_catalog(catalog.list_files(t.spark, root))


EVENTS_SQL = """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS timestamp, value, user_id, event_type AS label,
    'Lab_device1' AS device, 'events_data' AS data_source FROM events"""


@query("csv_collection", EVENTS_SQL)
def csv_collection(t):
    """Files listed, parsed from their paths, read with the attributes of their path."""
    rows = tables.read_source(t.spark, collection(t), ())
    return rows.select(
        F.col("event_id").cast("long"), "timestamp", "value", F.col("user_id").cast("long").alias("user_id"), "label", "device", "data_source")


@query(
    "csv_headers",
    "SELECT 'events_data' AS data_source, 'event_id,timestamp,value,user_id' AS header, count(DISTINCT event_type) AS n_labels FROM events",
)
def csv_headers(t):
    """Header lines of all files, from their first kilobytes."""
    files = collection(t)
    paths = [r["file_path"] for r in files.select("file_path").collect()]
    headers = catalog.header_inventory(t.spark, paths)
    return files.join(headers, "file_path").groupBy("data_source", "header").agg(F.countDistinct("label").alias("n_labels"))


@query("file_sources", "SELECT DISTINCT event_type AS label, 'events_data' AS by_columns, 'events_data' AS by_name FROM events")
def file_sources(t):
    """The source of every file by the columns of its header and by the name of its folder."""
    files = collection(t)
    paths = [r["file_path"] for r in files.select("file_path").collect()]
    headers = files.join(catalog.header_inventory(t.spark, paths), "file_path")
    registry = registry_from_headers(headers)
    distinct = headers.select("columns", "data_source").distinct().collect()
    found = t.spark.createDataFrame(
        [(r["columns"], r["data_source"], registry.classify(r["columns"]), registry.by_name(r["data_source"])) for r in distinct],
        "columns array<string>, data_source string, by_columns string, by_name string")
    return headers.join(F.broadcast(found), ["columns", "data_source"]).select("label", "by_columns", "by_name").distinct()


@query("extraction_resumed", "SELECT event_id, value, event_type AS label, 0::BIGINT AS repeated FROM events")
def extraction_resumed(t):
    """Files are extracted once; a second run finds nothing to do."""
    files, folder = collection(t), scratch(t)

    def extract(todo):
        rows = tables.read_source(t.spark, todo, ())
        name = F.regexp_extract("origin_path", "([^/]+)$", 1).alias("file_name")
        return rows.select(F.col("event_id").cast("long").alias("event_id"), "value", "device", "label", name)

    sinks.extract_pending(t.spark, files, f"{folder}/target", f"{folder}/done", extract)
    again = sinks.extract_pending(t.spark, files, f"{folder}/target", f"{folder}/done", extract)
    return t.spark.read.parquet(f"{folder}/target").select("event_id", "value", "label", F.lit(again).cast("long").alias("repeated"))


@query("extraction_claimed", "SELECT event_id, value, event_type AS label, 0::BIGINT AS repeated FROM events")
def extraction_claimed(t):
    """Two runs at once and a lost one; every file is published once."""
    files, target = collection(t), f"{scratch(t)}/claimed"

    def extract(todo):
        rows = tables.read_source(t.spark, todo, ())
        return rows.select(F.col("event_id").cast("long").alias("event_id"), "value", "label", F.col(tables.ORIGIN).alias("file_path"))

    plain = files.withColumn("file_path", F.regexp_replace("file_path", "^file:/+", "file:/"))
    lost = claims.Extraction(t.spark, plain, target, buckets=4, lease_seconds=0)
    lost.claim()
    lost.write(extract)
    claims.extract_claimed(t.spark, plain, target, extract, buckets=4)
    lost.commit()  # too late: its buckets have been taken over
    again = claims.extract_claimed(t.spark, plain, target, extract, buckets=4)
    return claims.read_extracted(t.spark, target).select("event_id", "value", "label", F.lit(again).cast("long").alias("repeated"))


@query("vocabulary_built_once", f"WITH {TOK_SQL} SELECT DISTINCT term FROM cnt")
def vocabulary_built_once(t):
    """Built and stored by the first call, read by the second."""
    path = f"{scratch(t)}/vocabulary"
    sinks.load_or_build(t.spark, path, lambda: text.vocabulary(tokens(t)))
    return sinks.load_or_build(t.spark, path, lambda: t.spark.createDataFrame([], "term string"))


@query("matrix_round_trip", f"WITH {TOK_SQL} SELECT lang, doc_id, term, n FROM cnt JOIN documents USING (doc_id)")
def matrix_round_trip(t):
    """A sparse matrix written as a table partitioned by language."""
    path = f"{scratch(t)}/matrix"
    sinks.write_table(text.term_counts(tokens(t, "lang", by_document=True), ["doc_id", "lang"]), path, ["lang"])
    return t.spark.read.parquet(path)


@query("nested_json_round_trip", f"WITH {PROC_SQL} SELECT o_orderkey, pid, proc_ord::INT AS proc_ord, call_ord, syscall, calls FROM s")
def nested_json_round_trip(t):
    """Nested process tables written as JSON."""
    path, nested = f"{scratch(t)}/processes", order_logs(t)
    sinks.write_table(nested, path, fmt="json")
    back = t.spark.read.schema(nested.schema).json(path)
    return processes.exploded_calls(processes.exploded_processes(back, ["o_orderkey"]), ["o_orderkey", "pid", "proc_ord"])


def write_archives(t, root: str):
    """One zip for every ``DOCS_PER_ARCHIVE`` documents, with junk entries; (file_path) of the archives."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        number, held = int(frame["part"].iloc[0]), io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("__MACOSX/SYS/._0.log", "junk")
            for doc, content in zip(frame["doc_id"], frame["text"]):
                archive.writestr(f"SYS/{doc}.log", content)
        path = f"{root}/logs{number}.zip"
        write_file(path, held.getvalue())
        return pd.DataFrame({"file_path": [path]})

    parts = t.documents.filter("text IS NOT NULL").select("doc_id", "text", F.expr(f"doc_id DIV {DOCS_PER_ARCHIVE}").alias("part"))
    parts.groupBy("part").applyInPandas(pack, "file_path string").write.format("noop").mode("overwrite").save()
    return catalog.list_files(t.spark, root)


@query("archives_read", "SELECT doc_id::VARCHAR AS timestamp, md5(text) AS content_md5 FROM documents WHERE text IS NOT NULL")
def archives_read(t):
    """Log entries of zip archives, junk entries left out."""
    return archives.read_archives(write_archives(t, scratch(t))).select("timestamp", F.md5("content").alias("content_md5"))


@query(
    "archives_source",
    """SELECT doc_id::VARCHAR || '.log' AS name, md5(text) AS content_md5, len(string_split(text, chr(10))) AS n_lines FROM documents
    WHERE text IS NOT NULL AND doc_id::VARCHAR LIKE '%7'""",
)
def archives_source(t):
    """S7, 2.15: archives through the data source, a condition on the entry name pushed to it, texts parsed by a user's table function."""
    root = scratch(t)
    write_archives(t, root)
    archive_source.register(t.spark)
    rows = t.spark.read.format("log_archives").option("taskBytes", 200_000).load(root).filter(F.col("entry").endswith("7.log"))
    count_lines = archive_source.log_parser(lambda content: [(len(content.split("\n")),)], "n_lines long")
    parsed = rows.lateralJoin(count_lines(F.col("content").outer()))
    return parsed.select(F.regexp_extract("entry", "([^/]*)$", 1).alias("name"), F.md5("content").alias("content_md5"), "n_lines")


@query("archive_listing", "SELECT doc_id::VARCHAR AS timestamp FROM documents WHERE text IS NOT NULL")
def archive_listing(t):
    """Timestamps from the entry names, contents unread."""
    return archives.archive_timestamps(write_archives(t, scratch(t))).select("timestamp")


@query("loose_logs", "SELECT item_id::VARCHAR AS timestamp, text AS content FROM benchmark")
def loose_logs(t):
    """One log file per item."""
    root = scratch(t)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for item, content in zip(batch["item_id"], batch["text"]):
                write_file(f"{root}/{item % 7}/{item}.log", content.encode("utf-8"))
            yield batch[["item_id"]]

    t.benchmark.select("item_id", "text").mapInPandas(write, "item_id long").write.format("noop").mode("overwrite").save()
    return logs.read_logs(t.spark, root).select("timestamp", "content")
