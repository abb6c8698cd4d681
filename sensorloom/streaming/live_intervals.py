"""Packet intervals as a stream (W3-W5): the interval and bandwidth features of a window, closed by the watermark.

``lag`` does not exist on streams. The state of a (series, window) is the last packets seen, the first three instants and running
moments; a row of it has a fixed size. A packet is folded in when it arrives, so it has to come in time order within its
window; one that is older than the last packet of its window is counted as late and left out. A window is given
out and its state is dropped when the watermark has passed its end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sensorloom.functions.timeparts import bucket_of, instant_micros, micros_of, width_micros
from sensorloom.operators.network import INTERVAL_FEATURES

# n packets, late ones, first and last three instants, then count, mean, squared deviations, least and greatest of interval and bandwidth.
STATE = "n long, late long, head array<long>, tail array<long>, " + ", ".join(f"{p}_{c}" for p in ("dt", "bw") for c in ("n long", "mean double", "ss double", "lo double", "hi double"))


class Moments:
    """Count, mean, squared deviations, least and greatest value; merged around the common mean."""

    def __init__(self, n: int = 0, mean: float = 0.0, ss: float = 0.0, lo: float | None = None, hi: float | None = None):
        self.n, self.mean, self.ss, self.lo, self.hi = n, mean, ss, lo, hi

    def add(self, values: np.ndarray) -> None:
        if not len(values):
            return
        n, mean = len(values), float(values.mean())
        both, gap = self.n + n, mean - self.mean
        self.ss += float(((values - mean) ** 2).sum()) + gap * gap * self.n * n / both
        self.mean += gap * n / both
        self.lo = float(values.min()) if self.lo is None else min(self.lo, float(values.min()))
        self.hi = float(values.max()) if self.hi is None else max(self.hi, float(values.max()))
        self.n = both

    def row(self) -> tuple:
        return (self.n, self.mean, self.ss, self.lo, self.hi)

    def features(self) -> tuple:
        """Mean, sample variance, least, greatest; null where there is none."""
        return (self.mean if self.n else None, self.ss / (self.n - 1) if self.n > 1 else None, self.lo, self.hi)


class WindowState:
    """The packets of one window so far."""

    def __init__(self, row: tuple | None = None):
        n, late, head, tail, *moments = row or (0, 0, [], [], *Moments().row(), *Moments().row())
        self.n, self.late, self.head, self.tail = n, late, list(head), list(tail)
        self.dt, self.bw = Moments(*moments[:5]), Moments(*moments[5:])

    def row(self) -> tuple:
        return (self.n, self.late, self.head, self.tail, *self.dt.row(), *self.bw.row())

    def add(self, frame: pd.DataFrame) -> None:
        frame = frame.sort_values(["_us", "_seq"], kind="stable")
        us, length = frame["_us"].to_numpy(np.int64), frame["_length"].to_numpy(np.float64)
        if self.tail:
            late = us < self.tail[-1]
            self.late += int(late.sum())
            us, length = us[~late], length[~late]
        if not len(us):
            return
        before = np.concatenate((self.tail[-1:] or us[:1], us[:-1]))
        dt = (us - before) / 1e6
        if not self.n:
            dt, length = dt[1:], length[1:]
        with np.errstate(divide="ignore", invalid="ignore"):
            band = np.where(dt > 0, length / dt, np.where(length == 0, np.nan, 0.0))
        self.dt.add(dt)
        self.bw.add(band[~np.isnan(band)])
        self.head = (self.head + us[:3].tolist())[:3]
        self.tail = (self.tail + us[-3:].tolist())[-3:]
        self.n += len(us)

    def features(self) -> tuple:
        """In the order of ``INTERVAL_FEATURES``."""
        gaps = [(b - a) / 1e6 for a, b in zip(self.head, self.head[1:])]
        ends = [(b - a) / 1e6 for a, b in zip(self.tail, self.tail[1:])]
        first = (ends[-1] - gaps[0]) / (self.n - 2) if self.n >= 3 else None
        second = ((ends[-1] - ends[-2]) - (gaps[1] - gaps[0])) / (self.n - 3) if self.n >= 4 else None
        return (*self.dt.features(), first, second, *self.bw.features())


def live_interval_features(
    stream: DataFrame, ts: str, width: str | int | float, series: Sequence[str] = (), delay: str = "1 minute", origin: Any = "epoch",
    length: str = "Length", seq: str = "row_seq",
) -> DataFrame:
    """(series..., win_us, interval features, n_packets, n_late) of every closed window; ``stream`` is a streaming table.

    Windows count from a fixed origin: a stream has no first row to start at.
    """
    width_us, series = width_micros(width), list(series)
    anchor = F.lit(0 if origin == "epoch" else instant_micros(origin)).cast("long")
    keys = [*series, "win_us"]
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    rows = stream.filter(F.col(ts).isNotNull()).withWatermark(ts, delay).select(
        *series, F.col(ts), bucket_of(micros_of(F.col(ts)), anchor, width_us).alias("win_us"), micros_of(F.col(ts)).alias("_us"),
        F.col(f"`{length}`").cast("double").alias("_length"), F.col(f"`{seq}`").cast("long").alias("_seq"))
    names = [*keys, *INTERVAL_FEATURES, "n_packets", "n_late"]
    schema = ", ".join([*(f"`{k}` {kinds.get(k, 'long')}" for k in keys), *(f"`{c}` double" for c in INTERVAL_FEATURES), "n_packets long", "n_late long"])

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = WindowState(state.get if state.exists else None)
        if state.hasTimedOut:
            state.remove()
            row = (*key, *held.features(), held.n, held.late)
            yield pd.DataFrame([[None if isinstance(x, float) and math.isnan(x) else x for x in row]], columns=names)
            return
        held.add(pd.concat(list(frames)))
        state.update(held.row())
        # Milliseconds, rounded up; a timer must lie after the watermark.
        end = -(-(int(key[-1]) + width_us) // 1000)
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))

    return rows.groupBy(*keys).applyInPandasWithState(fold, schema, STATE, "append", GroupStateTimeout.EventTimeTimeout)
