"""Packet-record window features (A2-A4, W3-W5) at one or several window widths.

The packets are read twice, whatever the number of widths: once for the span of every series, once into
partial rows of base windows, whose width is the common divisor of all widths (``packet_parts``): one row per
instant, length, port and address that occurs in a base window. Widths are rows from there on: a partial row is
repeated for the wider windows that hold it, and everything is merged in one aggregation over (series, width, window).

One window may hold a third of all packets. Packets of an instant, a length or an address are combined before
they are shuffled. Differences between consecutive instants are taken in slices of a base window, as many as its
instants need; the slices of a window are stitched by their edges. Medians come from rank selection, counts of
different values from a table that is grouped by value first, so neither meets in a task.

Packet lengths are taken as non-negative. Packets at equal timestamps keep the order of the ``seq`` column.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sensorloom.functions.timeparts import micros_of, width_micros
from sensorloom.operators.buckets import Origin, anchored_span, sequence_rows
from sensorloom.operators.lookup import join_lookup
from sensorloom.operators.ranks import group_quantiles
from sensorloom.session import materialise

# Instants of a base window that one slice takes, and the longest slice of a crowded one.
SLICE_ROWS = 100_000
SLICE_MICROS = 1_000_000

# Output names of the window features.
LENGTH_FEATURES = [
    "(OLD) PacketCount",
    "(OLD) TotalLength",
    "(OLD) AverageLength",
    "(OLD) MedianLength",
    "(OLD) MinLength",
    "(OLD) MaxLength",
    "(OLD) VarianceLength",
    "(OLD) DifferentSourcePorts",
    "(OLD) DifferentDestPorts",
    "TcpPacketCount",
    "UdpPacketCount",
    "TcpUdpProtocolRatio",
    "DifferentDestIPs",
]
INTERVAL_FEATURES = [
    "MeanInterPacketInterval",
    "VarianceInterPacketInterval",
    "MinInterPacketInterval",
    "MaxInterPacketInterval",
    "FirstDerivativeInterPacketInterval",
    "SecondDerivativeInterPacketInterval",
    "AverageBandwidth",
    "VarianceBandwidth",
    "MinBandwidth",
    "MaxBandwidth",
]
# Divisor used for the protocol ratio when a window has no UDP packet.
NO_UDP_DIVISOR = 0.1


def _over(keys: Sequence[str], tail: str = "") -> str:
    return f"OVER (PARTITION BY {', '.join(f'`{k}`' for k in keys)} {tail})"


def _aliased(expressions: dict[str, str]) -> list[Column]:
    return [F.expr(e).alias(name) for name, e in expressions.items()]


def _bandwidth(length: str, seconds: str) -> str:
    """Length over interval; infinite becomes 0, 0/0 and a missing interval stay null."""
    return f"CASE WHEN {seconds} = 0 THEN IF({length} = 0, NULL, 0D) ELSE try_divide({length}, {seconds}) END"


# Kinds of partial rows.
INSTANT, LENGTH, SOURCE_PORT, DEST_PORT, DEST_IP = range(5)

PACKET_NAMES = {
    "protocol": "Protocol", "source_port": "SourcePort", "dest_port": "DestPort",
    "dest_ip": "DestIP", "length": "Length", "seq": "row_seq",
}


def _whole_steps(value: str, step: str) -> str:
    """Floor of value / step in integer arithmetic."""
    return f"(({value} - pmod({value}, {step})) div {step})"


def packet_parts(
    df: DataFrame, ts: str, anchors: DataFrame, base_us: int, series: Sequence[str], names: dict[str, str], tcp: str, udp: str, instants: bool = True,
) -> DataFrame:
    """Stored partial rows (series, base, kind, t, x, s, n, tcp, udp, first_len, zero_bw); one read of the packets.

    ``base`` numbers the base windows from the anchor of the series, ``t`` is the time since the anchor.
    """
    rows = df.filter(F.col(ts).isNotNull()).select(
        *series, micros_of(F.col(ts)).alias("ts_us"),
        *[(F.col(f"`{names[c]}`") if c in names else F.lit(None).cast("long")).alias(c) for c in ("protocol", "source_port", "dest_port", "dest_ip", "seq")],
        F.col(f"`{names['length']}`").cast("double").alias("length"))
    placed = join_anchor(rows, anchors, series).withColumn("t", F.expr("ts_us - anchor")).withColumn("base", F.expr(_whole_steps("t", f"{base_us}L")))
    entries = [(INSTANT, "t", "CAST(NULL AS DOUBLE)", "CAST(NULL AS STRING)")] if instants else []
    entries += [(LENGTH, "CAST(NULL AS LONG)", "length", "CAST(NULL AS STRING)")]
    entries += [(kind, "CAST(NULL AS LONG)", "CAST(NULL AS DOUBLE)", f"CAST({c} AS STRING)")
                for kind, c in ((SOURCE_PORT, "source_port"), (DEST_PORT, "dest_port"), (DEST_IP, "dest_ip"))]
    structs = ", ".join(f"named_struct('kind', {k}, 't', {t}, 'x', {x}, 's', {s})" for k, t, x, s in entries)
    long = placed.select(*series, "base", "protocol", "length", "seq", F.expr(f"inline(array({structs}))"))
    parts = long.filter(f"kind < {SOURCE_PORT} OR s IS NOT NULL").groupBy(*series, "base", "kind", "t", "x", "s").agg(F.count_if(F.col("protocol") == tcp).alias("tcp"), F.count_if(F.col("protocol") == udp).alias("udp"), *_aliased({
        "n": "count(*)",
        "first_len": "min_by(length, seq)",
        # Packets after the first one at an instant have interval 0 and bandwidth 0 (null when empty).
        "zero_bw": "count_if(length > 0) - IF(min_by(length, seq) > 0, 1, 0)",
    }))
    return materialise(parts)


def join_anchor(rows: DataFrame, anchors: DataFrame, series: Sequence[str]) -> DataFrame:
    """Adds ``anchor``, the microsecond from which the windows of the row's series are counted."""
    if series:
        return join_lookup(rows, anchors.select(*series, "anchor"), series, stored=True)
    return rows.withColumn("anchor", anchors.select("anchor").scalar())


def at_widths(parts: DataFrame, base_us: int, widths: Sequence[int]) -> DataFrame:
    """Every partial row once per width, with the number of the window that holds it."""
    steps = ", ".join(f"named_struct('width_us', {w}L, 'step', {w // base_us}L)" for w in widths)
    return parts.select("*", F.expr(f"inline(array({steps}))")).withColumn("win", F.expr(_whole_steps("base", "step"))).drop("step")


def length_features(parts: DataFrame, keys: list[str], base_us: int, widths: Sequence[int]) -> DataFrame:
    """Length, protocol and distinct-count features per (series, width, window)."""
    values = materialise(at_widths(parts.filter(f"kind <> {INSTANT}"), base_us, widths).groupBy(*keys, "kind", "x", "s").agg(
        F.sum("n").alias("n"), F.sum("tcp").alias("tcp"), F.sum("udp").alias("udp")))
    is_length = f"kind = {LENGTH}"
    grouped = values.groupBy(*keys).agg(*_aliased({
        "n": f"sum(IF({is_length}, n, 0L))",
        "nl": f"sum(IF({is_length} AND x IS NOT NULL, n, 0L))",
        "total": "coalesce(sum(x * n), 0D)",
        "lo": "min(x)",
        "hi": "max(x)",
        "tcp": f"sum(IF({is_length}, tcp, 0L))",
        "udp": f"sum(IF({is_length}, udp, 0L))",
        # Lengths are at most a few 10^4, so the raw second moment keeps enough digits.
        "sq": "sum(x * x * n)",
        "ports": f"count_if(kind = {SOURCE_PORT})", "targets": f"count_if(kind = {DEST_PORT})", "addresses": f"count_if(kind = {DEST_IP})",
    }))
    medians = group_quantiles(values.filter(f"{is_length} AND x IS NOT NULL"), keys, "x", [0.5], "n", combined=True)
    return grouped.join(medians.withColumnRenamed("q0", "median"), keys, "left").select(*keys, *_aliased({
        "(OLD) PacketCount": "n",
        "(OLD) TotalLength": "total",
        "(OLD) AverageLength": "try_divide(total, nl)",
        "(OLD) MedianLength": "median",
        "(OLD) MinLength": "lo",
        "(OLD) MaxLength": "hi",
        "(OLD) VarianceLength": "IF(nl > 1, greatest(sq - total * try_divide(total, nl), 0D) / (nl - 1), NULL)",
        "(OLD) DifferentSourcePorts": "ports",
        "(OLD) DifferentDestPorts": "targets",
        "TcpPacketCount": "tcp",
        "UdpPacketCount": "udp",
        "TcpUdpProtocolRatio": f"tcp / IF(udp > 0, CAST(udp AS DOUBLE), {NO_UDP_DIVISOR}D)",
        "DifferentDestIPs": "addresses",
    }))


def sliced(instants: DataFrame, series: list[str], base_us: int) -> DataFrame:
    """Adds ``slice``: crowded base windows are cut by time, as finely as their number of instants asks."""
    sizes = instants.groupBy(*series, "base").agg(F.count(F.lit(1)).alias("rows")).filter(f"rows > {SLICE_ROWS}")
    length = f"least(greatest({base_us} div (rows div {SLICE_ROWS} + 1), 1L), {SLICE_MICROS}L)"
    crowded = materialise(sizes.select(*series, "base", F.expr(length).alias("slice_us")))
    if crowded.isEmpty():
        return instants.withColumn("slice", F.lit(0).cast("long"))
    rows = join_lookup(instants, crowded, [*series, "base"], stored=True, how="left")
    return rows.withColumn("slice", F.expr(f"coalesce((t - base * {base_us}) div slice_us, 0L)")).drop("slice_us")


def slice_rows(instants: DataFrame, series: list[str]) -> DataFrame:
    """Differences inside a slice, reduced to one row per slice with its two edges."""
    keys = [*series, "base", "slice"]
    inside = _over(keys, "ORDER BY t")
    rows = instants.select(*keys, "t", "n", "first_len", "zero_bw", *_aliased({
        "dt": f"(t - lag(t) {inside}) / 1e6D",
        "is_head": f"lag(t, 3) {inside} IS NULL",
        "is_tail": f"lead(t, 3) {inside} IS NULL",
    })).withColumn("bw", F.expr(_bandwidth("first_len", "dt")))
    aggs = {
        "first_us": "min(t)",
        "last_us": "max(t)",
        "edge_len": "max(IF(dt IS NULL, first_len, NULL))",
        "packets": "sum(n)",
        "dt_zeros": "sum(n - 1)",
        "bw_zeros": "sum(zero_bw)",
        # Up to three instants of either end, each repeated for its packets (at most three).
        "head": "flatten(collect_list(IF(is_head, array_repeat(t, CAST(least(n, 3) AS INT)), NULL)))",
        "tail": "flatten(collect_list(IF(is_tail, array_repeat(t, CAST(least(n, 3) AS INT)), NULL)))",
    }
    for p in ("dt", "bw"):
        aggs |= {f"{p}_n": f"count({p})", f"{p}_mean": f"avg({p})", f"{p}_var": f"var_pop({p})",
                 f"{p}_lo": f"min({p})", f"{p}_hi": f"max({p})"}
    return rows.groupBy(*keys).agg(*_aliased(aggs))


def interval_features(parts: DataFrame, keys: list[str], series: list[str], base_us: int, widths: Sequence[int]) -> DataFrame:
    """Interval, derivative and bandwidth statistics per (series, width, window)."""
    instants = sliced(parts.filter(f"kind = {INSTANT}"), series, base_us)
    slices = at_widths(slice_rows(instants, series), base_us, widths)
    # All that follows has the same partitioning: one exchange of slice rows.
    whole, ordered = _over(keys), _over(keys, "ORDER BY first_us")
    stitched = slices.select("*", *_aliased({
        "dt_edge": f"(first_us - lag(last_us) {ordered}) / 1e6D",
        # Every slice has an instant, so three slices of either end hold the three outer instants.
        "is_head": f"lag(first_us, 3) {ordered} IS NULL",
        "is_tail": f"lead(first_us, 3) {ordered} IS NULL",
    })).withColumn("bw_edge", F.expr(_bandwidth("edge_len", "dt_edge")))
    aggs = {"head": "array_sort(flatten(collect_list(IF(is_head, head, NULL))))", "tail": "array_sort(flatten(collect_list(IF(is_tail, tail, NULL))))",
            "packets": "sum(packets)"}
    centres = {}
    for p in ("dt", "bw"):
        count = f"({p}_n + {p}_zeros + IF({p}_edge IS NULL, 0, 1))"
        total = f"(coalesce({p}_mean * {p}_n, 0D) + coalesce({p}_edge, 0D))"
        centres |= {f"{p}_all": f"sum({count}) {whole}", f"{p}_centre": f"try_divide(sum({total}) {whole}, sum({count}) {whole})"}
        zero = f"IF({p}_zeros > 0, 0D, NULL)"
        aggs |= {
            f"{p}_all": f"max({p}_all)",
            f"{p}_mean": f"max({p}_centre)",
            # Squared deviations from the common mean: inner values, zero intervals, edge value.
            f"{p}_ss": f"sum(coalesce(({p}_var + pow({p}_mean - {p}_centre, 2)) * {p}_n, 0D) + {p}_zeros * {p}_centre * {p}_centre"
                       f" + coalesce(pow({p}_edge - {p}_centre, 2), 0D))",
            f"{p}_lo": f"min(least({p}_lo, {p}_edge, {zero}))",
            f"{p}_hi": f"max(greatest({p}_hi, {p}_edge, {zero}))",
        }
    merged = stitched.select("*", *_aliased(centres)).groupBy(*keys).agg(*_aliased(aggs))

    def gap(array: str, i: int, j: int) -> str:
        return f"((try_element_at({array}, {j}) - try_element_at({array}, {i})) / 1e6D)"

    first, second = gap("head", 1, 2), gap("head", 2, 3)
    last, before_last = gap("tail", -2, -1), gap("tail", -3, -2)
    # The mean of consecutive differences telescopes to its two ends.
    return merged.select(*keys, *_aliased({
        "MeanInterPacketInterval": "dt_mean",
        "VarianceInterPacketInterval": "IF(dt_all > 1, dt_ss / (dt_all - 1), NULL)",
        "MinInterPacketInterval": "dt_lo",
        "MaxInterPacketInterval": "dt_hi",
        "FirstDerivativeInterPacketInterval": f"IF(packets >= 3, ({last} - {first}) / (packets - 2), NULL)",
        "SecondDerivativeInterPacketInterval":
            f"IF(packets >= 4, (({last} - {before_last}) - ({second} - {first})) / (packets - 3), NULL)",
        "AverageBandwidth": "bw_mean",
        "VarianceBandwidth": "IF(bw_all > 1, bw_ss / (bw_all - 1), NULL)",
        "MinBandwidth": "bw_lo",
        "MaxBandwidth": "bw_hi",
    }))


def width_grid(anchors: DataFrame, series: list[str], widths: Sequence[int]) -> DataFrame:
    """(series, width_us, win, win_us): every window from the first to the last packet, at every width."""
    steps = ", ".join(f"{w}L" for w in widths)
    bounds = anchors.filter("lo_us IS NOT NULL").select(*series, "anchor", "lo_us", "hi_us", F.expr(f"explode(array({steps})) AS width_us")).select(
        *series, "width_us", "anchor", *_aliased({"_first": _whole_steps("(lo_us - anchor)", "width_us"), "_last": _whole_steps("(hi_us - anchor)", "width_us")}))
    return sequence_rows(bounds, [*series, "width_us", "anchor"], "win").select(*series, "width_us", "win", F.expr("anchor + win * width_us AS win_us"))


def _at_widths_with_gaps(
    df: DataFrame, ts: str, widths: Sequence[str | int | float], series: Sequence[str], origin: Origin, columns: dict[str, str],
    tcp: str, udp: str, names: Sequence[str], zeros: Sequence[str], renamed: dict[str, str],
) -> DataFrame:
    """(series, width_us, win_us, names...): packets read for the span and for the partial rows, windows without a packet filled."""
    series, micros = list(series), sorted({width_micros(w) for w in widths})
    base_us = math.gcd(*micros)
    anchors = anchored_span(df, ts, series, origin)
    wanted = set(names) & set(INTERVAL_FEATURES)
    parts = packet_parts(df, ts, anchors, base_us, series, columns, tcp, udp, bool(wanted))
    keys = [*series, "width_us", "win"]
    features = length_features(parts, keys, base_us, micros).withColumnsRenamed(renamed)
    if wanted:
        features = features.join(interval_features(parts, keys, series, base_us, micros), keys)
    joined = width_grid(anchors, series, micros).join(features.withColumn("_hit", F.lit(True)), keys, "left")
    kinds = dict(features.dtypes)
    # Only windows without any packet are filled: a null computed from packets stays null.
    values = [f"IF(_hit, `{c}`, CAST(0 AS {kinds[c]})) AS `{c}`" if c in zeros else f"`{c}`" for c in names]
    return joined.selectExpr(*[f"`{c}`" for c in series], "width_us", "win_us", *values)


def network_features_at_widths(
    df: DataFrame, ts: str, widths: Sequence[str | int | float], series: Sequence[str] = (), origin: Origin = "start",
    columns: dict[str, str] | None = None, tcp: str = "TCP", udp: str = "UDP",
) -> DataFrame:
    """(series, width_us, win_us, 23 features) at all widths from two reads of the packets; an empty window is all zeros.

    ``columns`` maps protocol, source_port, dest_port, dest_ip, length and seq to the table's names. ``series=["label"]``
    gives every label its own origin.
    """
    names = LENGTH_FEATURES + INTERVAL_FEATURES
    return _at_widths_with_gaps(df, ts, widths, series, origin, {**PACKET_NAMES, **(columns or {})}, tcp, udp, names, names, {})


def network_features(
    df: DataFrame, ts: str, width: str | int | float = "40s", series: Sequence[str] = (), origin: Origin = "start",
    columns: dict[str, str] | None = None, tcp: str = "TCP", udp: str = "UDP",
) -> DataFrame:
    """The 23 window features of a packet table at one width (A2, A3)."""
    return network_features_at_widths(df, ts, [width], series, origin, columns, tcp, udp).drop("width_us")


# The older names of features that both tables have.
BASIC_NAMES = {
    "(OLD) PacketCount": "PacketCount", "(OLD) TotalLength": "TotalLength",
    "(OLD) AverageLength": "AverageLength", "(OLD) MedianLength": "MedianLength",
    "(OLD) MinLength": "MinLength", "(OLD) MaxLength": "MaxLength",
    "(OLD) VarianceLength": "VarianceLength", "(OLD) DifferentSourcePorts": "DifferentSourcePorts",
    "(OLD) DifferentDestPorts": "DifferentDestPorts",
}


def basic_network_features(
    df: DataFrame, ts: str, width: str | int | float, series: Sequence[str] = (), origin: Origin = "start",
    columns: dict[str, str] | None = None, tcp: str = "TCP", udp: str = "UDP",
) -> DataFrame:
    """The 11 older features: counts and the sum are 0 in an empty window, the rest null (A4)."""
    counted = ["PacketCount", "TotalLength", "DifferentSourcePorts", "DifferentDestPorts", "TcpPacketCount", "UdpPacketCount"]
    names = [*BASIC_NAMES.values(), "TcpPacketCount", "UdpPacketCount"]
    given = {k: v for k, v in {**PACKET_NAMES, **(columns or {})}.items() if k != "seq"}
    return _at_widths_with_gaps(df, ts, [width], series, origin, given, tcp, udp, names, counted, BASIC_NAMES).drop("width_us")


def exclude_addresses(df: DataFrame, addresses: Sequence[str], source: str = "SourceIP", dest: str = "DestIP") -> DataFrame:
    """Drops packets from or to the given addresses; rows with a null address stay."""
    hit = F.coalesce(F.col(source).isin(*addresses), F.lit(False)) | F.coalesce(F.col(dest).isin(*addresses), F.lit(False))
    return df.filter(~hit)
