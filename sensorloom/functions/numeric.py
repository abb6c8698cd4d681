"""Numeric expressions shared by the operators; all of them stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def null_if_nan(x: Column) -> Column:
    return F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x)


def ratio(num: Column, den: Column) -> Column:
    """Division that yields null, not an error, on a zero denominator."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def hash_unit(key: Column, seed: int, buckets: int = 10_000) -> Column:
    """Deterministic integer in [0, buckets): first 8 hex digits of md5('key|seed')."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.lit(buckets).cast("long")


def hash_order(key: Column, seed: int) -> Column:
    """Sort key of a seeded shuffle."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))


def digamma(m: Column) -> Column:
    """psi(m) for m >= 1: shift by 8 with the recurrence, then the asymptotic series."""
    m = m.cast("double")
    z = m + F.lit(8.0)
    shift = F.lit(0.0)
    for i in range(8):
        shift = shift + F.lit(1.0) / (m + F.lit(float(i)))
    inv2 = F.lit(1.0) / (z * z)
    tail = F.lit(0.0)
    for term in (1 / 132, 1 / 240, 1 / 252, 1 / 120, 1 / 12):
        tail = inv2 * (F.lit(term) - tail)
    return F.log(z) - F.lit(0.5) / z - tail - shift
