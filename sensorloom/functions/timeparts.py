"""Time widths and origin-anchored bucket arithmetic on microseconds since the epoch."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import Column, functions as F

# Microseconds per unit of the accepted width strings.
UNIT_MICROS = {
    "us": 1,
    "ms": 1_000,
    "s": 1_000_000,
    "min": 60_000_000,
    "h": 3_600_000_000,
    "d": 86_400_000_000,
}


def width_micros(width: str | int | float) -> int:
    """'30s', '10min', '1h' -> microseconds. Plain numbers are seconds."""
    if isinstance(width, (int, float)):
        return int(round(width * 1_000_000))
    match = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([a-z]+)\s*", width.lower())
    if not match or match.group(2) not in UNIT_MICROS:
        raise ValueError(f"not a window width: {width!r}")
    micros = int(round(float(match.group(1)) * UNIT_MICROS[match.group(2)]))
    if micros <= 0:
        raise ValueError(f"window width must be positive: {width!r}")
    return micros


def instant_micros(value: datetime | int | float | str) -> int:
    """An origin given as datetime, ISO text or epoch seconds -> microseconds."""
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    if isinstance(value, datetime):
        if value.tzinfo is None:
            value = value.replace(tzinfo=timezone.utc)
        delta = value - datetime(1970, 1, 1, tzinfo=timezone.utc)
        return (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds
    return int(round(value * 1_000_000))


def micros_of(ts: Column) -> Column:
    """TIMESTAMP / TIMESTAMP_NTZ column -> epoch microseconds (session time zone must be UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def bucket_of(ts_us: Column, origin_us: Column, width_us: int) -> Column:
    """Start of the left-closed bucket that holds ``ts_us``; exact integer arithmetic."""
    return ts_us - F.pmod(ts_us - origin_us, F.lit(width_us).cast("long"))


def timestamp_of(micros: Column) -> Column:
    return F.timestamp_micros(micros)


def seconds_of(micros: Column) -> Column:
    return micros.cast("double") / F.lit(1_000_000.0)
