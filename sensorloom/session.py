"""Session helpers: a builder for local runs and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Folders of the tables that ``materialise`` has written.
STORED: list[str] = []


def build_session(app: str = "sensorloom", cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session used by tests and the bench. A cluster brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SENSORLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the folder named by the cluster; only a local session without one (tests) gets its own.

    On a cluster a folder of one machine would lose tables with their executor, so that is refused.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="run-checkpoint-", dir="/tmp"))


def materialise(df: DataFrame) -> DataFrame:
    """Writes the rows as a table below the checkpoint folder and reads it back.

    Later stages read files, so a lost executor cannot change them. A table (unlike a checkpoint)
    is columnar, has a known size, and drops the plan's constraints, whose number explodes for
    wide window tables.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    STORED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def task_count(spark: SparkSession, amount: int, per_task: int) -> int:
    """Tasks that read at most about ``per_task`` of ``amount`` each; a small amount is still spread over the cores.

    For ``repartition``: without a number the tasks grow with the input, because the session's number of partitions does
    not, and adaptive execution joins them up to a size that is measured before the rows are taken apart.
    """
    spread = min(spark.sparkContext.defaultParallelism, -(-amount * 16 // per_task))
    return max(1, spread, -(-amount // per_task))


def drop_tables(spark: SparkSession) -> int:
    """Deletes the tables that this process has stored; to be called when their results have been used. Returns how many."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    dropped = 0
    while STORED:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(STORED.pop())
        dropped += bool(path.getFileSystem(hadoop).delete(path, True))
    return dropped
