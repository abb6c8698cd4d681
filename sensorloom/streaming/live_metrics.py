"""Metric logs as they arrive (S17, A16): a file stream that keeps the last value per participant and tag.

New files are read once: the stream remembers them in its checkpoint. Each run takes what is there and ends
(available-now trigger). The state is one value per (participant, tag) with its place in time, so a file that comes late, or
rows that come twice, cannot replace a later value. A run writes the keys that changed, one folder per batch; a batch that
is repeated after a failure overwrites its folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from sensorloom.operators.cleaning import quoted
from sensorloom.operators.reports import last_values
from sensorloom.sources.tables import since

ORDER = ("ts", "step")


def live_last_values(stream: DataFrame, keys: Sequence[str], value: str = "value", order: Sequence[str] = ORDER) -> DataFrame:
    """(keys..., value, order...): the latest non-null value per key with its place; works on streams and tables."""
    known = stream.filter(quoted(value).isNotNull() & ~F.isnan(value))
    latest = F.max(F.struct(*[quoted(c) for c in order], quoted(value))).alias("_latest")
    return known.groupBy(*[quoted(k) for k in keys]).agg(latest).select(
        *[quoted(k) for k in keys], F.col(f"_latest.`{value}`").alias(value), *[F.col(f"_latest.`{c}`").alias(c) for c in order])


def take_new_metrics(
    spark: SparkSession, source: str, schema: StructType | str, target: str, checkpoint: str, run_start: str | None = None,
    keys: Sequence[str] = ("participant", "tag"), value: str = "value", order: Sequence[str] = ORDER, files_per_batch: int = 1000,
) -> int:
    """Reads the Parquet files below ``source`` that are new and writes the changed keys below ``target``; returns the number of batches.

    ``run_start``: rows of files started before it (column ``file_ts``) are left out, as in ``read_metrics``.
    """
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    log = since(log, "file_ts", run_start) if run_start else log
    batches = []

    def write(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{target}/batch={number}")
        batches.append(number)

    query = (
        live_last_values(log, keys, value, order).writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return len(batches)


def current_values(
    spark: SparkSession, target: str, keys: Sequence[str] = ("participant", "tag"), value: str = "value", order: Sequence[str] = ORDER,
) -> DataFrame:
    """(keys..., value): the last value per key over all batches; a table for ``experiment_rollup`` and the like."""
    return last_values(spark.read.parquet(target), keys, value, order)
