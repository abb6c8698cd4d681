"""CSV sources, score files and metric logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sensorloom.operators.cleaning import quoted
from sensorloom.operators.fusion import union_sources
from sensorloom.operators.lookup import join_lookup
from sensorloom.operators.timestamps import TIMESTAMP_COLUMNS, timestamp_column
from sensorloom.session import materialise
from sensorloom.sources.catalog import header_inventory, plain_path

TEXT_COLUMNS = {"Protocol", "SourceIP", "DestIP", "file_path", "action"}
# File the row came from; entropy records have a ``file_path`` of their own.
ORIGIN = "origin_path"


def read_source(spark: SparkSession, catalog: DataFrame, text_columns: Sequence[str] = tuple(TEXT_COLUMNS)) -> DataFrame:
    """All CSV files of one source as one table.

    Files are grouped by header, so a different column order is read correctly; every group is
    one multi-path scan with all columns as text, numbers are cast leniently. Adds the file's
    label, device and source, and ``row_seq`` (order within the file). The paths of the files
    come to the driver, which lists them for the scan in any case; of the headers only their numbers.
    """
    other = catalog.filter(F.col("filetype") != "csv").limit(1).collect()
    if other:
        raise ValueError(f"only csv files can be read here: {other[0]['file_path']}")
    paths = [r["file_path"] for r in catalog.select("file_path").collect()]
    headers = materialise(header_inventory(spark, paths).select("file_path", "columns", F.xxhash64("columns").alias("no")))
    groups: dict[int, list[str]] = {}
    for row in headers.select("file_path", "no").collect():
        groups.setdefault(row["no"], []).append(row["file_path"])
    distinct = headers.groupBy("no").agg(F.first("columns").alias("columns")).orderBy("columns").collect()
    tables = [_scan(spark, row["columns"], groups[row["no"]], text_columns) for row in distinct]
    attributes = catalog.select(F.col("file_path").alias(ORIGIN), "label", "device", "data_source")
    return join_lookup(union_sources(tables), attributes.withColumn(ORIGIN, F.regexp_replace(ORIGIN, r"^file:/+", "file:/")), [ORIGIN], how="left")


def _scan(spark: SparkSession, columns: Sequence[str], files: Sequence[str], text_columns: Sequence[str]) -> DataFrame:
    schema = StructType([StructField(c, StringType()) for c in columns])
    raw = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(list(files))
    kept = [c for c in columns if c != "index" and c not in TIMESTAMP_COLUMNS]
    values = [quoted(c) if c in text_columns else F.nanvl(quoted(c).try_cast("double"), F.lit(None)).alias(c) for c in kept]  # text "nan" means no value
    # The time column is a choice per file, so it is settled before files are united.
    return raw.select(
        quoted(timestamp_column(columns)).alias("timestamp"),
        *values,
        plain_path("_metadata.file_path").alias(ORIGIN),
        F.struct(
            F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"),
            F.monotonically_increasing_id().alias("i"),
        ).alias("row_seq"),
    )


def read_table(spark: SparkSession, path: str, filetype: str) -> DataFrame:
    """One file by its type; other types fail."""
    if filetype == "csv":
        return spark.read.option("header", True).csv(path)
    raise ValueError(f"file type not supported: {filetype}")


def with_score_provenance(scores: DataFrame, file_name: str = "file_name") -> DataFrame:
    """data_source, device, time_window and is_robust from a score file's name."""
    parts = F.split(F.regexp_replace(file_name, r"\.[^.]*$", ""), "_")
    return scores.withColumns({
        "data_source": F.array_join(F.slice(parts, 1, 2), "_"),
        "device": F.array_join(F.slice(parts, 3, 2), "_"),
        "time_window": F.get(parts, F.lit(4)),
        "is_robust": F.coalesce(F.get(parts, F.lit(5)) == "ROBUST", F.lit(False)),
    })


def read_scores(spark: SparkSession, directory: str) -> DataFrame:
    """All score CSVs of a folder with provenance."""
    schema = "chi2 double, f_classif double, mutual_info_classif double, feature string, label string"
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(f"{directory}/*.csv")
    return with_score_provenance(raw.withColumn("file_name", F.col("_metadata.file_name")))


def read_metrics(spark: SparkSession, path: str, run_start: str, fmt: str = "dd/MM/yyyy HH:mm:ss") -> DataFrame:
    """Metric log rows whose file was started at or after ``run_start``.

    The table holds participant, file_ts, tag, step, value, ts; the condition reaches the scan.
    """
    return since(spark.read.parquet(path), "file_ts", run_start, fmt)


def since(log: DataFrame, column: str, run_start: str, fmt: str = "dd/MM/yyyy HH:mm:ss") -> DataFrame:
    start = F.to_timestamp(F.lit(run_start.strip()), fmt)
    return log.filter(F.col(column) >= start.cast(log.schema[column].dataType))


def union_training_tables(frames: Sequence[DataFrame], dropped: Sequence[str] = ()) -> DataFrame:
    """Cleaned tables of several devices as one, without the columns only some boards have."""
    return union_sources([f.drop(*dropped) for f in frames])
