"""Nested process tables: rollup per window, qualified tokens.

Input rows are logs with ``processes`` ARRAY<STRUCT<service_name, pid, events, cpu_usage,
system_calls ARRAY<STRUCT<syscall, calls, ...>>>>.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from sensorloom.operators.buckets import Origin, assign_windows
from sensorloom.operators.lookup import join_terms
from sensorloom.session import task_count

# Admission of a (service, syscall) pair to the vocabulary.
MIN_PAIR_CALLS = 5
MIN_PAIR_CPU = 0.5
TASK_CALLS = 1 << 18


def exploded_processes(logs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per (log, process); ``proc_ord`` keeps the order inside the log."""
    return logs.select(*keep, F.posexplode("processes").alias("proc_ord", "p")).select(
        *keep, "proc_ord", F.col("p.service_name").alias("service_name"), F.col("p.pid").alias("pid"),
        F.col("p.events").cast("long").alias("events"), F.col("p.cpu_usage").cast("double").alias("cpu_usage"),
        F.col("p.system_calls").alias("system_calls"),
    )


def exploded_calls(processes: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per (process, system call)."""
    return processes.select(*keep, F.posexplode("system_calls").alias("call_ord", "s")).select(
        *keep, "call_ord", F.col("s.syscall").alias("syscall"), F.col("s.calls").cast("long").alias("calls")
    )


def process_rollup(
    logs: DataFrame, ts: str, width: str | int | float, series: Sequence[str] = (), origin: Origin = "epoch",
    log_key: Sequence[str] = (),
) -> DataFrame:
    """Per (series, window, pid): cpu sum and maximum, occurrences, events, last service name.

    ``log_key`` orders logs of the same time, so that the last name is defined.
    """
    windowed = assign_windows(logs, ts, width, series, origin)
    rows = exploded_processes(windowed, [*series, "win_us", "ts_us", *log_key])
    return rows.groupBy(*series, "win_us", "pid").agg(
        F.sum("cpu_usage").alias("cpu_usage"),
        F.max("cpu_usage").alias("max_cpu_usage"),
        F.count("*").alias("occurances"),
        F.sum("events").alias("events"),
        F.max_by("service_name", F.struct("ts_us", *log_key, "proc_ord")).alias("service_name"),
    )


def process_call_sequence(
    logs: DataFrame, ts: str, width: str | int | float, series: Sequence[str] = (), origin: Origin = "epoch",
    log_key: Sequence[str] = (),
) -> DataFrame:
    """The system calls of each (series, window, pid) as ordered rows.

    The order columns (ts_us, log key, proc_ord, call_ord) stand for the position in one joined
    string, so no process's calls have to fit in one cell.
    """
    windowed = assign_windows(logs, ts, width, series, origin)
    keep = [*series, "win_us", "ts_us", *log_key]
    processes = exploded_processes(windowed, keep)
    return exploded_calls(processes, [*keep, "pid", "proc_ord"])


def nested_rollup(rollup: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """Re-nests the rollup: one row per window with its processes.

    The array holds one entry per process id, at most the kernel's id limit.
    """
    entry = F.struct("pid", "service_name", "cpu_usage", "max_cpu_usage", "occurances", "events")
    return rollup.groupBy(*series, "win_us").agg(F.array_sort(F.collect_list(entry)).alias("processes"))


def process_vocabulary(
    logs: DataFrame, min_calls: int = MIN_PAIR_CALLS, min_cpu: float = MIN_PAIR_CPU
) -> DataFrame:
    """Distinct terms: every system call, and 'service syscall' pairs that pass the limits (P20)."""
    calls = exploded_calls(exploded_processes(logs, []), ["service_name", "cpu_usage"])
    single = calls.select(F.col("syscall").alias("term"))
    pairs = calls.filter((F.col("calls") > min_calls) & (F.col("cpu_usage") > min_cpu)).select(
        F.concat_ws(" ", "service_name", "syscall").alias("term")
    )
    return single.union(pairs).distinct()


def process_term_counts(logs: DataFrame, doc: Sequence[str], vocab: DataFrame | None = None) -> DataFrame:
    """(doc keys, term, n): pairs count their calls, a bare system call counts once per listing.

    ``logs`` is read twice. Logs are placed by document before their calls are listed, in tasks of about ``TASK_CALLS``
    calls: their terms are then counted in place, and a task holds the counts of no more.
    """
    listed = F.aggregate("processes", F.lit(0).cast("long"), lambda n, p: n + F.coalesce(F.size(p["system_calls"]), F.lit(0)))
    size = logs.agg(F.sum(listed)).first()[0] or 0
    logs = logs.select(*doc, "processes").repartition(task_count(logs.sparkSession, size, TASK_CALLS), *doc)
    calls = exploded_calls(exploded_processes(logs, doc), [*doc, "service_name"])
    terms = calls.select(
        *doc,
        F.explode(
            F.array(
                F.struct(F.concat_ws(" ", "service_name", "syscall").alias("term"), F.col("calls").alias("n")),
                F.struct(F.col("syscall").alias("term"), F.lit(1).cast("long").alias("n")),
            )
        ).alias("t"),
    )
    counted = terms.groupBy(*doc, F.col("t.term").alias("term")).agg(F.sum("t.n").alias("n")).filter("n > 0")
    if vocab is None:
        return counted
    return join_terms(counted, vocab.select("term").distinct(), ["term"], F.xxhash64(*doc), how="left_semi")


def process_documents(logs: DataFrame, doc: Sequence[str]) -> DataFrame:
    """(doc keys, pid, proc_ord, tokens): one document per process of a log."""
    rows = exploded_processes(logs, doc)
    return rows.select(
        *doc, "pid", "proc_ord", F.transform("system_calls", lambda s: s["syscall"]).alias("tokens")
    )
