"""Feature-set membership and label codes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sensorloom.operators.lookup import join_lookup


def in_both(left: DataFrame, right: DataFrame, on: str = "feature") -> DataFrame:
    """Rows of ``left`` whose feature the other table knows."""
    return left.join(right.select(on), on, "left_semi")


def not_in(left: DataFrame, right: DataFrame, on: str = "feature") -> DataFrame:
    """Rows of ``left`` whose feature the other table lacks."""
    return left.join(right.select(on), on, "left_anti")


def set_union(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.union(right).distinct()


def set_intersection(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.intersect(right)


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.subtract(right)


def mapped(column: Column, mapping: Mapping, strict: bool = True) -> Column:
    """Literal lookup; an unknown non-null key raises when strict, else becomes null."""
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    found = F.try_element_at(F.create_map(*pairs), column)
    if not strict:
        return found
    kind = "string" if isinstance(next(iter(mapping.values())), str) else "int"
    message = F.concat(F.lit("unknown value: "), column.cast("string"))
    return F.when(found.isNull() & column.isNotNull(), F.raise_error(message).cast(kind)).otherwise(found)


def with_family(df: DataFrame, families: Mapping[str, str], device: str = "device") -> DataFrame:
    """Adds ``family`` from a device -> hardware family map (P12); an unlisted device gives null."""
    return df.withColumn("family", mapped(F.col(device), families, strict=False))


def encode_labels(df: DataFrame, labels: Sequence[str], column: str = "label") -> DataFrame:
    """Label text -> 0-based code in lexicographic order (F14); an unknown label raises."""
    codes = {name: i for i, name in enumerate(sorted(labels))}
    return df.withColumn(column, mapped(F.col(column), codes))


def decode_labels(df: DataFrame, labels: Sequence[str], column: str = "label") -> DataFrame:
    names = dict(enumerate(sorted(labels)))
    return df.withColumn(column, mapped(F.col(column).cast("int"), names))


def source_of_features(features: DataFrame, registry: DataFrame, fold: Mapping[str, str] | None = None) -> DataFrame:
    """(feature, data_source) of selected features.

    ``registry`` holds (feature, data_source, ord); the first registered source wins, then a
    ``_<x>_data`` suffix, then the system-call source.
    """
    first = registry.groupBy("feature").agg(F.min_by("data_source", "ord").alias("known"))
    suffix = F.nullif(F.regexp_extract("feature", r"([^_]+_data)$", 1), F.lit(""))
    known = F.col("known") if not fold else F.coalesce(mapped(F.col("known"), fold, strict=False), F.col("known"))
    return features.join(first, "feature", "left").select(
        "feature", F.coalesce(known, suffix, F.lit("SYS_data")).alias("data_source")
    )


def tag_with_catalog(rows: DataFrame, catalog: DataFrame, path: str = "file_path") -> DataFrame:
    """Label, device and source of the file a row came from (J9); null for a file outside the catalog."""
    return join_lookup(rows, catalog.select(path, "label", "device", "data_source"), [path], how="left")
