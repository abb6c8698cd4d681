"""Writers: partitioned tables, skip-if-done extraction, vocabularies."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from sensorloom.session import materialise


def _read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def pending(spark: SparkSession, catalog: DataFrame, manifest: str) -> DataFrame:
    """Catalog rows whose file is not in the manifest yet."""
    done = _read_or_none(spark, manifest)
    return catalog if done is None else catalog.join(done.select("file_path"), "file_path", "left_anti")


def extract_pending(
    spark: SparkSession, catalog: DataFrame, target: str, manifest: str,
    extract: Callable[[DataFrame], DataFrame], partition_by: Sequence[str] = ("device", "label", "file_name"),
) -> int:
    """Extracts files that are not done and records them (S10); returns how many were read without error.

    Partitions end at the file and are overwritten one by one, and the manifest is written
    after the data: a run that died half-way is repeated without doubling rows. If the extracted rows
    have a column ``error`` (and ``file_path``), rows with an error are not written, and their files
    are not recorded, so that the next run tries them again.
    """
    todo = materialise(pending(spark, catalog, manifest))
    if todo.isEmpty():
        return 0
    rows, done = extract(todo), todo.select("file_path")
    if "error" in rows.columns:
        rows = materialise(rows)
        done = done.join(rows.filter(F.col("error").isNotNull()).select("file_path").distinct(), "file_path", "left_anti")
        rows = rows.filter(F.col("error").isNull()).drop("error")
    done = materialise(done)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(target)
    done.write.mode("append").parquet(manifest)
    return done.count()


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite", fmt: str = "parquet") -> None:
    """Parquet, CSV (with header) or JSON sink."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def load_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A small table (vocabulary, feature list) that is built once and then read."""
    found = _read_or_none(spark, path)
    if found is None:
        build().write.mode("ignore").parquet(path)
        found = spark.read.parquet(path)
    return found
