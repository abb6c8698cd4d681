"""Registered queries: a name, a function (spark, sf_dir) -> DataFrame, and its SQL twin if there is one."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from sensorloom.session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers the decorated function, which receives a table loader."""

    def register(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            ensure_checkpoint_dir(spark)
            return build(Tables(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


class Tables:
    """Lazily opened driver tables: ``t.events``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int, columns: Sequence[str]) -> DataFrame:
    """Rounds float results for comparison; NaN becomes null, -0.0 becomes 0.0."""
    return df.selectExpr(*[
        f"IF(isnan(`{c}`), NULL, round(CAST(`{c}` AS DOUBLE) * {TIE_SHIFT}D, {digits}) + 0D) AS `{c}`" if c in columns else f"`{c}`"
        for c in df.columns
    ])


# A mean of few decimals often ends exactly on ...5; this factor moves such ties off the edge
# before rounding, on both sides, so that the last bit of a sum cannot decide the digit.
TIE_SHIFT = 1.00000000001


def r(expression: str, digits: int = 6) -> str:
    """SQL side of ``rounded``."""
    return f"(round(({expression})::DOUBLE * {TIE_SHIFT}::DOUBLE, {digits}) + 0.0)"
