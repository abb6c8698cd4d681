"""File catalog: one row per raw file, attributes read from its path."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sensorloom.operators.entropy import file_type
from sensorloom.schema import LABEL_ALIASES, SOURCE_ALIASES
from sensorloom.sources.files import open_file

# Fixed value: folder layout of the raw collection.
PATH_PATTERN = r"0_raw_collected_data/(\w+)/(\w+)/(\w+)/(\w+)/([\w.-]+\.(?:csv|zip))$"
PATH_FIELDS = ["researcher_name", "device_name", "label", "data_source", "file_name"]
HEADER_BYTES = 16 * 1024
# Files that are never data.
JUNK_PATTERN = r"(^|/)(\.DS_Store|\.backup|[^/]*\.txt)$"


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, filesize_bytes, modified) of every file below root; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(
        F.col("path").alias("file_path"), F.col("length").alias("filesize_bytes"),
        F.col("modificationTime").alias("modified"),
    )


def with_path_fields(files: DataFrame, path: str = "file_path") -> DataFrame:
    """Adds file type and the five path fields; all five are null for a foreign path."""
    matches = F.col(path).rlike(PATH_PATTERN)
    fields = {
        name: F.when(matches, F.regexp_extract(path, PATH_PATTERN, i + 1)) for i, name in enumerate(PATH_FIELDS)
    }
    named = F.col(path).rlike(r"\.[^/]*$")  # a name without a dot (README) is no data file
    return files.filter(named & ~F.col(path).rlike(JUNK_PATTERN)).withColumns({"filetype": file_type(F.col(path)), **fields})


def canonical(df: DataFrame) -> DataFrame:
    """Source and label aliases replaced, device = researcher_device."""
    renamed = df.replace(SOURCE_ALIASES, subset=["data_source"]).replace(LABEL_ALIASES, subset=["label"])
    return renamed.withColumn("device", F.concat_ws("_", "researcher_name", "device_name"))


def build_catalog(files: DataFrame, strict: bool = True) -> DataFrame:
    """The catalog of all matching files; a foreign path fails when strict, else is left out."""
    parsed = with_path_fields(files)
    if strict:
        message = F.concat(F.lit("path does not fit the collection layout: "), F.col("file_path"))
        checked = F.when(F.col("file_name").isNull(), F.raise_error(message).cast("string")).otherwise(F.col("file_name"))
        parsed = parsed.withColumn("file_name", checked)
    return canonical(parsed.filter(F.col("file_name").isNotNull()))


def rejected_paths(files: DataFrame) -> DataFrame:
    return with_path_fields(files).filter(F.col("file_name").isNull()).select("file_path", "filetype")


def detailed_title(*extra: str) -> Column:
    """researcher_device_label_<extra> (2.9)."""
    return F.concat_ws("_", "researcher_name", "device_name", "label", *extra)


def group_title() -> Column:
    return F.concat_ws("_", "researcher_name", "device_name")


def header_inventory(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file_path, header, columns) per CSV file: its first line.

    Only the first kilobytes of a file are read. A name that breaks off inside quotes is trimmed.
    """
    listed = spark.createDataFrame([(p,) for p in paths], "file_path string")
    tasks = spark.sparkContext.defaultParallelism * 4
    first = listed.repartition(min(tasks, max(1, len(paths)))).mapInPandas(_first_lines, "file_path string, header string")
    names = F.transform(F.split("header", ","), lambda c: F.trim(F.regexp_replace(c, '["\r\n]', "")))
    return first.withColumn("columns", names)


def _first_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame([(path, _first_line(path)) for path in batch["file_path"]], columns=["file_path", "header"])


def _first_line(path: str) -> str:
    """Text before the first line break; a longer header is read on, kilobytes at a time."""
    held = b""
    with open_file(path) as handle:
        while b"\n" not in held and (more := handle.read(HEADER_BYTES)):
            held += more
    return held.split(b"\n")[0].decode("utf-8", "replace").rstrip("\r").removeprefix("\ufeff")


def plain_path(column: str | Column) -> Column:
    """One spelling of a path: ``_metadata.file_path`` is URL-encoded and has three slashes, a listing is neither."""
    path = F.col(column) if isinstance(column, str) else column
    decoded = F.url_decode(F.regexp_replace(path, r"\+", "%2B"))
    return F.regexp_replace(F.when(path.rlike("%[0-9A-Fa-f]{2}"), decoded).otherwise(path), r"^file:/+", "file:/")


def first_timestamps(rows: DataFrame, candidates: Sequence[str], path: str = "file_path") -> DataFrame:
    """Smallest value of each candidate time column per file."""
    return rows.groupBy(path).agg(
        *[F.min(F.expr(f"try_cast(`{c}` as double)")).alias(f"first_{c}") for c in candidates if c in rows.columns]
    )
