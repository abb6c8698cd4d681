"""Row and column clean-up."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from sensorloom.functions.numeric import hash_order, hash_unit
from sensorloom.operators.ordering import with_row_index
from sensorloom.operators.quantiles import feature_quantiles


def escaped(name: str) -> str:
    """A column name as SQL text; names may hold dots, colons, spaces or line breaks."""
    return "`" + name.replace("`", "``") + "`"


def quoted(name: str) -> Column:
    return F.col(escaped(name))


def to_numeric(df: DataFrame, exclude: Sequence[str] = (), lenient: bool = False) -> DataFrame:
    """Casts every non-numeric column to double; bad text raises, or becomes null if lenient."""
    out = []
    for field in df.schema.fields:
        column = quoted(field.name)
        if field.name in exclude or isinstance(field.dataType, NumericType):
            out.append(column)
        else:
            out.append((column.try_cast("double") if lenient else column.cast("double")).alias(field.name))
    return df.select(*out)


def keep_selected(df: DataFrame, features: Sequence[str], always: Sequence[str] = ()) -> DataFrame:
    """Selected features that exist in the table, sorted by name (P5)."""
    wanted = set(features)
    names = [c for c in df.columns if c in always] + sorted(c for c in df.columns if c in wanted and c not in always)
    return df.select(*[quoted(c) for c in names])


def one_device_one_source(catalog: DataFrame, device: str, source: str) -> DataFrame:
    """Catalog rows of one device and source; fails if there are none (P10)."""
    rows = catalog.filter((F.col("device") == device) & (F.col("data_source") == source))
    if rows.isEmpty():
        raise ValueError(f"no files of {source} for {device}")
    return rows


def remap(df: DataFrame, column: str, mapping: Mapping[str, str]) -> DataFrame:
    return df.replace(dict(mapping), subset=[column])


def nan_to_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.when(F.isnan(quoted(c)), None).otherwise(quoted(c)) for c in columns})


def drop_any_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drops a row with any null or NaN in the given columns, or in all.

    One condition per column: the built-in form puts all columns into one condition, and the
    optimizer then derives a variant of it for every subset of renamed columns.
    """
    names = df.columns if columns is None else list(columns)
    floats = {f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")}
    tests = []
    for name in names:
        q = escaped(name)
        tests.append(f"{q} IS NOT NULL" + (f" AND NOT isnan({q})" if name in floats else ""))
    return df.filter(" AND ".join(tests)) if tests else df


def null_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: rows, rows with any null, rows with only nulls, and nulls per column (P14); NaN counts as null."""
    floats = {f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")}
    flags = [quoted(c).isNull() | F.isnan(quoted(c)) if c in floats else quoted(c).isNull() for c in columns]
    any_null, all_null = flags[0], flags[0]
    for f in flags[1:]:
        any_null, all_null = any_null | f, all_null & f
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(any_null).alias("n_any_null"),
        F.count_if(all_null).alias("n_all_null"),
        *[F.count_if(flag).alias(f"null_{c}") for c, flag in zip(columns, flags)],
    )


def iqr_bounds(df: DataFrame, columns: Sequence[str], factor: float = 1.5, ids: Sequence[str] = ()) -> DataFrame:
    """(ids..., feature, lo, hi) with the whisker limits of every column."""
    quartiles = feature_quantiles(df, columns, [0.25, 0.75], ids)
    spread = (F.col("q1") - F.col("q0")) * F.lit(factor)
    return quartiles.select(*ids, "feature", (F.col("q0") - spread).alias("lo"), (F.col("q1") + spread).alias("hi"))


def drop_iqr_outliers(df: DataFrame, columns: Sequence[str], factor: float = 1.5) -> DataFrame:
    """Drops a row if any column lies outside its whiskers; null and NaN never count.

    The limits (one pair per column) reach the filter as a scalar subquery.
    """
    bounds = iqr_bounds(df, columns, factor)
    limits = bounds.agg(
        F.map_from_entries(F.collect_list(F.struct("feature", F.struct("lo", "hi").alias("b")))).alias("m")
    ).scalar()
    rows = df.withColumn("_limits", limits)
    keep = F.lit(True)
    for c in columns:
        pair = F.col("_limits")[F.lit(c)]
        x = F.nanvl(quoted(c).cast("double"), F.lit(None))
        keep = keep & F.coalesce(x.between(pair["lo"], pair["hi"]), F.lit(True))
    return rows.filter(keep).drop("_limits")


def low_variance_columns(df: DataFrame, columns: Sequence[str], threshold: float = 0.0) -> DataFrame:
    """(feature, variance) of the columns to drop (P17); a zero threshold is decided on max - min."""
    narrow = df.unpivot([], [quoted(c).cast("double").alias(c) for c in columns], "feature", "x")
    stats = narrow.groupBy("feature").agg(
        F.var_pop("x").alias("variance"), (F.max("x") - F.min("x")).alias("spread")
    )
    low = F.col("spread") == 0 if threshold == 0 else F.col("variance") <= threshold
    return stats.filter(low).select("feature", "variance")


def drop_low_variance(df: DataFrame, columns: Sequence[str], threshold: float = 0.0) -> DataFrame:
    """Drops those columns. The column list fixes the schema, so it is read to the driver."""
    names = [r["feature"] for r in low_variance_columns(df, columns, threshold).collect()]
    return df.select(*[quoted(c) for c in df.columns if c not in names])


def suffix_shared_columns(frames: Mapping[str, DataFrame], keys: Sequence[str]) -> dict[str, DataFrame]:
    """Renames a column present in several sources to ``<column>_<source>``."""
    seen = Counter(c for frame in frames.values() for c in frame.columns if c not in keys)
    return {
        source: frame.withColumnsRenamed({c: f"{c}_{source}" for c in frame.columns if c not in keys and seen[c] > 1})
        for source, frame in frames.items()
    }


def shuffled(df: DataFrame, key: Sequence[str], seed: int, position: str | None = None) -> DataFrame:
    """Seeded full shuffle as a distributed sort on a hash of the row key (P25).

    ``position`` adds the row's place in the new order, for keys that identify a row.
    """
    order = hash_order(F.concat_ws("|", *[quoted(k) for k in key]), seed)
    if position is None:
        return df.orderBy(order, *[quoted(k) for k in key])
    return with_row_index(df.withColumn("_hash", order), ["_hash", *key], position).drop("_hash")


def sampled(df: DataFrame, key: Sequence[str], share: float, seed: int) -> DataFrame:
    """A fraction of the rows by a hash of the row key: the same rows under any partitioning (P25)."""
    limit = int(round(share * 1_000_000))
    return df.filter(hash_unit(F.concat_ws("|", *[quoted(k) for k in key]), seed, 1_000_000) < limit)


def sliced(df: DataFrame, order: Sequence[str], start: int, stop: int) -> DataFrame:
    """Rows at the positions start .. stop - 1 of an order (K9)."""
    placed = with_row_index(df, order, "_position")
    return placed.filter((F.col("_position") >= start) & (F.col("_position") < stop)).drop("_position")


def top_category_codes(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    """Adds ``<column>_code`` (F13): rank among the k most frequent values, else -1, made dense.

    The dense code counts from the smallest code that occurs, so -1 becomes 0 as soon as a
    value outside the top k exists. At most k rows are joined back.
    """
    counts = df.filter(quoted(column).isNotNull()).groupBy(quoted(column).alias("_v")).agg(F.count("*").alias("_n"))
    top = counts.orderBy(F.desc("_n"), "_v").limit(k)
    ranks = top.agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("o"), F.col("_v").alias("v")))), lambda s: s["v"]
        )
    ).scalar()
    outside = df.agg(F.count("*")).scalar() > top.agg(F.sum("_n")).scalar()
    ranked = df.withColumn("_ranks", ranks)
    position = F.coalesce(F.array_position("_ranks", quoted(column)), F.lit(0)).cast("int") - 1
    code = position + F.when(outside, 1).otherwise(0)
    return ranked.withColumn(f"{column}_code", code.cast("int")).drop("_ranks")
