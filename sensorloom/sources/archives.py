"""Zip archives of log files.

The only Python boundary of the library: an archive is opened on the executor that reads
it. The entry lists are made first (one small row per entry), then the entries are spread
over tasks by (archive, entry range), so one large archive is read by many tasks.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sensorloom.session import materialise
from sensorloom.sources.files import open_file

# Entries read by one open of an archive.
ENTRY_RANGE = 64
# Unpacked bytes one task should read.
TASK_BYTES = 256 * 1024 * 1024
ENTRIES_SCHEMA = "file_path string, entry string, entry_no int, entry_bytes long, error string"
TEXT_SCHEMA = "file_path string, entry string, content string, error string"


def is_log(name: str) -> bool:
    return name.endswith(".log") and not ("__MACOSX" in name and "SYS/._" in name)


def _list_entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path in batch["file_path"]:
            rows = []
            try:
                with open_file(path) as handle, zipfile.ZipFile(handle) as archive:
                    rows = [(path, i.filename, n, i.file_size, None) for n, i in enumerate(archive.infolist())
                            if is_log(i.filename)]
            except Exception as problem:  # an unreadable archive is a row of its own
                rows = [(path, None, None, None, str(problem))]
            yield pd.DataFrame(rows, columns=["file_path", "entry", "entry_no", "entry_bytes", "error"])


def _read_entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, group in batch.groupby("file_path", sort=False):
            with open_file(path) as handle, zipfile.ZipFile(handle) as archive:
                for entry in group["entry"]:
                    try:
                        row = (path, entry, archive.read(entry).decode("utf-8"), None)
                    except Exception as problem:
                        row = (path, entry, None, str(problem))
                    # One entry per output batch: no more than one text is held.
                    yield pd.DataFrame([row], columns=["file_path", "entry", "content", "error"])


def archive_entries(archives: DataFrame) -> DataFrame:
    """(file_path, entry, entry_no, entry_bytes, error) without reading contents.

    The number of partitions is explicit: the rows are tiny, and adaptive execution would put
    all archives into one task.
    """
    tasks = archives.sparkSession.sparkContext.defaultParallelism * 4
    return archives.select("file_path").repartition(tasks, "file_path").mapInPandas(_list_entries, ENTRIES_SCHEMA)


def archive_timestamps(archives: DataFrame) -> DataFrame:
    """(file_path, timestamp): the stem of every log entry; unreadable archives give no row, ``archive_entries`` names them."""
    entries = archive_entries(archives).filter(F.col("entry").isNotNull())
    return entries.select("file_path", entry_stem("entry").alias("timestamp"))


def entry_stem(column: str):
    """Base name without its extension."""
    return F.regexp_replace(F.regexp_extract(column, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def read_archives(archives: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(file_path, entry, content, error, timestamp), one row per log entry.

    An unreadable archive is one row without entry, an unreadable entry one without content; both
    have an error. The entry list is stored, its sizes give the number of tasks.
    """
    listed = materialise(archive_entries(archives))
    broken = listed.filter(F.col("entry").isNull()).select("file_path", "entry", F.lit(None).cast("string").alias("content"), "error")
    entries = listed.filter(F.col("entry").isNotNull())
    total = entries.agg(F.sum("entry_bytes")).first()[0] or 0
    tasks = max(archives.sparkSession.sparkContext.defaultParallelism, -(-total // task_bytes))
    placed = entries.withColumn("_range", F.floor(F.col("entry_no") / F.lit(ENTRY_RANGE))).repartition(tasks, "file_path", "_range")
    ordered = placed.sortWithinPartitions("file_path", "entry_no").select("file_path", "entry")
    return ordered.mapInPandas(_read_entries, TEXT_SCHEMA).unionByName(broken).withColumn("timestamp", entry_stem("entry"))
