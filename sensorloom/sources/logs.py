"""Loose log files and trace summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Layout of a trace-summary log.
SUMMARY_MARK = " Summary of events:"
HEADER_PATTERN = r"^\s+(.+\d*)\s+\((\d+)\),\s+(\d+)\s+events,\s+(\d+\.\d+)%"
ROW_PATTERN = (
    r"\s*(\S+)\s+(\d+)\s+(\d+(?:\.\d+)?)\s+(\d+(?:\.\d+)?)\s+(\d+(?:\.\d+)?)\s+(\d+(?:\.\d+)?)\s+\s+(\d+(?:\.\d+)?)%"
)
UPTIME_PATTERN = r"UPTIME:(\d+\.\d+)"
RULE = "------\n"
CALL_FIELDS = ["syscall", "calls", "total", "min", "avg", "max", "stddev"]


def read_logs(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, timestamp, content) of every .log file below root; the stem is the timestamp."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.log")
    # A scan without the text column would count lines, not files.
    files = files.filter(F.col("value").isNotNull())
    return files.select(
        F.col("_metadata.file_path").alias("file_path"),
        F.regexp_replace(F.col("_metadata.file_name"), r"(?<=.)\.[^.]*$", "").alias("timestamp"),
        F.col("value").alias("content"),
    )


def from_quasi_json(text: Column, schema: str) -> Column:
    """Nested values from the text of a literal that is JSON but for single quotes, True, False and None (2.9).

    Text that cannot be read gives null fields. The three words are replaced only where a value stands.
    """
    value = r"(?<=[:,\[]\s{0,4})%s(?=\s*[,\]}])"
    for word, plain in (("None", "null"), ("True", "true"), ("False", "false")):
        text = F.regexp_replace(text, value % word, plain)
    return F.from_json(text, schema, {"allowSingleQuotes": "true"})


def _process(p: Column) -> Column:
    """The process of a paragraph (head, body) whose head has the header."""
    # One regex pass finds the rows; their fields are separated by blanks.
    rows = F.transform(
        F.regexp_extract_all(p["body"], F.lit(ROW_PATTERN), F.lit(0)), lambda m: F.split(F.trim(F.translate(m, "\n\t", "  ")), r"\s+"))

    def field(r: Column, i: int) -> Column:
        c = CALL_FIELDS[i]
        text = F.rtrim(r[i], F.lit("%")) if c == "stddev" else r[i]
        return (text if c == "syscall" else text.cast("long" if c == "calls" else "double")).alias(c)

    calls = F.transform(rows, lambda r: F.struct(*[field(r, i) for i in range(len(CALL_FIELDS))]))
    # The four fields of the header by one match: none of them can hold a line break.
    header = F.split(F.regexp_replace(p["head"], HEADER_PATTERN + r"[\s\S]*", "$1\n$2\n$3\n$4"), "\n")
    named = F.transform(F.array(header), lambda h: F.struct(
        h[0].alias("service_name"), h[1].alias("pid"), h[2].cast("long").alias("events"), h[3].cast("double").alias("cpu_usage"),
        calls.alias("system_calls")))
    return named[0]


def parse_summaries(logs: DataFrame, text: str = "content") -> DataFrame:
    """Adds ``processes`` and ``uptime``.

    Paragraphs after the last summary mark are separated by two empty lines. One with a
    process header is a process; the last one without gives the uptime ('' when it has none).
    """
    tail = F.substring_index(F.col(text), SUMMARY_MARK, -1)
    halves = F.transform(F.split(tail, "\n\n\n"), lambda p: F.struct(
        F.substring_index(p, RULE, 1).alias("head"),
        F.when(F.instr(p, RULE) > 0, F.substr(p, F.instr(p, RULE) + F.lit(len(RULE)))).otherwise("").alias("body")))
    # Every paragraph's header is looked for once.
    marked = F.transform(halves, lambda p: F.struct(p["head"].alias("head"), p["body"].alias("body"), p["head"].rlike(HEADER_PATTERN).alias("header")))
    staged = logs.withColumn("_paragraphs", marked)
    processes = F.transform(F.filter("_paragraphs", lambda p: p["header"]), _process)
    plain = F.filter("_paragraphs", lambda p: ~p["header"])
    last = F.try_element_at(plain, F.lit(-1))["head"]
    uptime = F.coalesce(F.regexp_extract(last, UPTIME_PATTERN, 1), F.lit(""))
    return staged.withColumns({"processes": processes, "uptime": uptime}).drop("_paragraphs")
