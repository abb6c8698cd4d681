"""Log archives as a data source (S7, S8) and parsing by a user's function (2.15).

``spark.read.format("log_archives").load(folder)`` gives one row per log entry below a folder: file_path, entry, content, error.
Partitions are (archive, share of its entries), as many as the size of an archive asks for; the driver sees names and sizes of
archives only, the entry lists are read by the tasks. Conditions on file_path reach the list of archives and conditions on
entry the entry list, so neither archives nor entries that they rule out are unpacked. An archive or an entry that cannot be
read is a row with an error.
"""

from __future__ import annotations

import zipfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringContains, StringEndsWith, StringStartsWith,
)

from sensorloom.sources.archives import is_log
from sensorloom.sources.files import list_folder, open_file

SCHEMA = "file_path string, entry string, content string, error string"
# Packed bytes that one task reads; logs unpack to several times that.
TASK_BYTES = 32 << 20
BATCH_BYTES = 4 << 20
TESTS: dict[type, Callable[[str, object], bool]] = {
    EqualTo: lambda x, y: x == y, In: lambda x, y: x in y, StringStartsWith: str.startswith, StringEndsWith: str.endswith,
    StringContains: lambda x, y: y in x,
}


class Share(InputPartition):
    """One of ``parts`` contiguous shares of an archive's entries."""

    def __init__(self, path: str, part: int, parts: int):
        self.path, self.part, self.parts = path, part, parts


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str, task_bytes: int):
        self.folder, self.task_bytes = folder, task_bytes
        self.on_path: list[tuple[type, object]] = []
        self.on_entry: list[tuple[type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes conditions on one of the two names; the rest stays with the engine."""
        for f in filters:
            taken = {("file_path",): self.on_path, ("entry",): self.on_entry}.get(getattr(f, "attribute", None))
            if taken is None or (type(f) not in TESTS and not isinstance(f, IsNotNull)):
                yield f
                continue
            taken.append((type(f), getattr(f, "value", None)))

    @staticmethod
    def passes(name: str | None, tests: list[tuple[type, object]]) -> bool:
        return all(name is not None and (kind is IsNotNull or TESTS[kind](name, value)) for kind, value in tests)

    def partitions(self) -> list[Share]:
        found = []
        for path, size in list_folder(self.folder):
            if path.endswith(".zip") and self.passes(path, self.on_path):
                parts = max(1, -(-size // self.task_bytes))
                found += [Share(path, i, parts) for i in range(parts)]
        return found

    def rows(self, share: Share) -> Iterator[tuple]:
        try:
            with open_file(share.path) as handle, zipfile.ZipFile(handle) as archive:
                logs = [i for i in archive.infolist() if is_log(i.filename)]
                first, end = (len(logs) * k // share.parts for k in (share.part, share.part + 1))
                for info in logs[first:end]:
                    if not self.passes(info.filename, self.on_entry):
                        continue
                    try:
                        yield (share.path, info.filename, archive.read(info).decode("utf-8"), None)
                    except Exception as problem:  # an unreadable entry is a row of its own
                        yield (share.path, info.filename, None, str(problem))
        except (OSError, ValueError, zipfile.BadZipFile) as problem:
            if share.part == 0 and self.passes(None, self.on_entry):
                yield (share.path, None, None, str(problem))

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in self.rows(partition):
            held.append(row)
            size += len(row[2] or "")
            if size > BATCH_BYTES:
                yield batch(held)
                held, size = [], 0
        if held:
            yield batch(held)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["file_path", "entry", "content", "error"])


class LogArchives(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        if "path" not in self.options:
            raise ValueError("log_archives needs a folder: load(folder)")
        return ArchiveReader(self.options["path"], int(self.options.get("taskBytes", TASK_BYTES)))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session and lets conditions reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LogArchives)


def log_parser(parse: Callable[[str], Iterable[tuple]], returns: str):
    """A table function from a user's parser: ``rows.lateralJoin(parser(F.col("content").outer()))``; a null text has no rows."""

    class Parser:
        def eval(self, content: str):
            if content is not None:
                yield from parse(content)

    return F.udtf(Parser, returnType=returns)
