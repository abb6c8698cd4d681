"""Bag-of-words, process-table and log-text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.operators import processes, text
from sensorloom.plans.call_encoding import encode_documents
from sensorloom.session import materialise, task_count
from sensorloom.sources.logs import from_quasi_json, parse_summaries
from sensorloom.workload.registry import query, r, rounded

DAY = 86_400_000_000
ITEM_KEY = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]  # the order of an order's items
TASK_LINES = 1 << 19
# Letters, marks, digits and connectors, as the operators' own word pattern.
WORDS_SQL = r"regexp_extract_all({c}, '[\p{{L}}\p{{M}}\p{{Nl}}\p{{Nd}}\p{{Pc}}]{{2,}}')"


def words_sql(column: str) -> str:
    return WORDS_SQL.format(c=column)


TOK_SQL = f"""tok AS (SELECT doc_id, lang, {words_sql('lower(text)')} AS tokens FROM documents WHERE text IS NOT NULL),
    cnt AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(tokens) AS term FROM tok) GROUP BY ALL),
    nd AS (SELECT count(*)::DOUBLE AS n_docs FROM tok),
    idf AS (SELECT term, count(*) AS df, ln((1.0 + (SELECT n_docs FROM nd)) / (1.0 + count(*))) + 1 AS idf FROM cnt GROUP BY term),
    w AS (SELECT doc_id, term, cnt.n, cnt.n * idf AS w FROM cnt JOIN idf USING (term)),
    tfidf AS (SELECT doc_id, term, n, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS tfidf FROM w)"""


def tokens(t, *extra, by_document=False):
    return text.tokenised(t.documents, ["doc_id", *extra], "text", lowercase=True, by_document=by_document)


@query(
    "call_names",
    """SELECT page_id, array_to_string(regexp_extract_all(html, '<([A-Za-z0-9_]+)[\\s>]', 1), ' ') AS calls FROM pages""",
)
def call_names(t):
    """Ordered names by a pattern with look-around (opening tags stand in for calls)."""
    found = text.extract_calls(t.pages, "html", r"(?<=<)([A-Za-z0-9_]+)(?=[\s>])")
    return found.select("page_id", F.array_join("calls", " ").alias("calls"))


@query(
    "vocabulary",
    f"""WITH {TOK_SQL} SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id FROM (SELECT DISTINCT term FROM cnt)""",
)
def vocabulary(t):
    """Sorted distinct terms with their position."""
    return text.with_term_ids(text.vocabulary(tokens(t)))


@query("vocabulary_by_language", f"WITH {TOK_SQL} SELECT DISTINCT lang, unnest(tokens) AS term FROM tok")
def vocabulary_by_language(t):
    """T3 per group: the vocabularies before they are united."""
    return tokens(t, "lang").select("lang", F.explode_outer(F.array_distinct("tokens")).alias("term")).filter("term IS NOT NULL").distinct()


@query("bag_of_words", f"WITH {TOK_SQL} SELECT * FROM cnt")
def bag_of_words(t):
    """T4: term counts of every document."""
    return text.term_counts(tokens(t, by_document=True), ["doc_id"])


@query(
    "bag_of_words_fixed_vocabulary",
    f"""WITH {TOK_SQL}, b AS (SELECT DISTINCT unnest({words_sql('lower(text)')}) AS term FROM benchmark)
    SELECT cnt.* FROM cnt JOIN b USING (term)""",
)
def bag_of_words_fixed_vocabulary(t):
    """T4 over a given vocabulary: the terms of the benchmark texts."""
    vocab = text.vocabulary(text.tokenised(t.benchmark, ["item_id"], "text", lowercase=True))
    return text.term_counts(tokens(t, by_document=True), ["doc_id"], vocab)


@query("tfidf", f"WITH {TOK_SQL} SELECT doc_id, term, n, {r('tfidf')} AS tfidf FROM tfidf")
def tfidf(t):
    """T5: smooth IDF, rows scaled to length 1."""
    return rounded(text.tfidf(tokens(t, by_document=True), ["doc_id"]), 6, ["tfidf"])


@query("top_idf", f"WITH {TOK_SQL} SELECT term, df, {r('idf')} AS idf FROM idf ORDER BY idf.idf DESC, term LIMIT 10")
def top_idf(t):
    """K7: terms of the highest IDF."""
    rows = tokens(t, by_document=True)
    return rounded(text.top_idf(text.term_counts(rows, ["doc_id"]), rows.agg(F.count("*")).scalar(), 10), 6, ["idf"])


CONV_SQL = f"""tok AS (SELECT conv_id, turn, {words_sql('lower(text)')} AS t FROM conversations WHERE text IS NOT NULL),
    pos AS (SELECT conv_id, turn, unnest(t) AS a, unnest(t[2:] || [NULL]) AS b FROM tok WHERE len(t) > 0)"""


def turns(t):
    return text.tokenised(t.conversations, ["conv_id", "turn"], "text", lowercase=True, by_document=True)


PAIRS_SQL = f"""WITH {CONV_SQL}, g AS (SELECT conv_id, turn, a AS term FROM pos UNION ALL SELECT conv_id, turn, a || ' ' || b FROM pos WHERE b IS NOT NULL__EXTRA__)
    SELECT conv_id, turn, term, count(*) AS n FROM g GROUP BY ALL"""


@query("two_grams", PAIRS_SQL.replace("__EXTRA__", ""))
def two_grams(t):
    """Single terms and all neighbouring pairs of every turn."""
    return text.term_counts(text.pair_tokens(turns(t)), ["conv_id", "turn"])


@query("two_grams_ordered", PAIRS_SQL.replace("__EXTRA__", " AND a < b"))
def two_grams_ordered(t):
    """T6 with the pairs a vocabulary of sorted combinations holds."""
    return text.term_counts(text.pair_tokens(turns(t), ordered_only=True), ["conv_id", "turn"])


@query(
    "two_gram_tfidf",
    f"""WITH {CONV_SQL}, g AS (SELECT conv_id, turn, a AS term FROM pos UNION ALL SELECT conv_id, turn, a || ' ' || b FROM pos WHERE b IS NOT NULL AND a < b),
    cnt AS (SELECT conv_id, turn, term, count(*) AS n FROM g GROUP BY ALL),
    idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM tok)) / (1.0 + count(*))) + 1 AS idf FROM cnt GROUP BY term),
    w AS (SELECT conv_id, turn, term, n, n * idf AS w FROM cnt JOIN idf USING (term))
    SELECT conv_id, turn, term, n, {r('w / sqrt(sum(w * w) OVER (PARTITION BY conv_id, turn))')} AS tfidf FROM w""",
)
def two_gram_tfidf(t):
    """3.1, T6, T5: the encoding job with pairs."""
    docs = turns(t).withColumnRenamed("tokens", "calls")
    return rounded(encode_documents(docs, ["conv_id", "turn"], "calls", pairs=True, ordered_pairs_only=True), 6, ["tfidf"])


JOINED_SQL = f"""WITH {CONV_SQL}, v AS (SELECT a AS term, row_number() OVER (ORDER BY a) - 1 AS id, count(*) OVER () AS n FROM (SELECT DISTINCT a FROM pos)),
    s AS (SELECT *, n + coalesce(sum(n - 1 - id) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM v),
    g AS (SELECT conv_id, turn, id AS term_id, a AS term FROM pos JOIN v ON a = term
      UNION ALL SELECT conv_id, turn, x.before + y.id - x.id - 1, a || ' ' || b FROM pos JOIN s x ON a = x.term JOIN v y ON b = y.term WHERE a < b)"""


@query("two_gram_ids", f"{JOINED_SQL} SELECT conv_id, turn, term_id::BIGINT AS term_id, count(*) AS n FROM g GROUP BY ALL")
def two_gram_ids(t):
    """Single terms and pairs under their numbers in the joined vocabulary of all terms and all pairs of them."""
    docs = turns(t)
    return text.joined_term_counts(docs, ["conv_id", "turn"], materialise(text.with_term_ids(text.vocabulary(docs))))


@query("two_gram_names", f"{JOINED_SQL} SELECT DISTINCT term_id::BIGINT AS term_id, term FROM g")
def two_gram_names(t):
    """The names behind the numbers, found from the numbers alone."""
    docs = turns(t)
    terms = materialise(text.with_term_ids(text.vocabulary(docs)))
    return text.joined_term_names(text.joined_term_counts(docs, ["conv_id", "turn"], terms).select("term_id").distinct(), terms)


@query(
    "rows_minmax",
    f"""WITH {TOK_SQL} SELECT doc_id, term, n, {r('(n - min(n) OVER (PARTITION BY doc_id))::DOUBLE / nullif(max(n) OVER (PARTITION BY doc_id) - min(n) OVER (PARTITION BY doc_id), 0) * 4 + 1')} AS scaled
    FROM cnt""",
)
def rows_minmax(t):
    """Row-wise min-max over stored values into [1, 5]."""
    return rounded(text.minmax_rows(text.term_counts(tokens(t, by_document=True), ["doc_id"]), ["doc_id"], "n", 1.0, 5.0), 6, ["scaled"])


@query(
    "term_extremes",
    f"""WITH {TOK_SQL}, b AS (SELECT DISTINCT unnest({words_sql('lower(text)')}) AS term FROM benchmark),
    x AS (SELECT term, max(n) AS hi, min(n) AS lo FROM cnt GROUP BY term)
    SELECT term, coalesce(hi, 0) AS max_value, coalesce(lo, 0) AS min_value FROM b LEFT JOIN x USING (term)""",
)
def term_extremes(t):
    """Extremes of the stored values per vocabulary term, 0 when unused."""
    vocab = text.vocabulary(text.tokenised(t.benchmark, ["item_id"], "text", lowercase=True))
    return text.term_extremes(text.term_counts(tokens(t, by_document=True), ["doc_id"]), "n", vocab)


@query(
    "low_variance_terms",
    f"""WITH {TOK_SQL}, s AS (SELECT term, sum(n) AS s, sum(n * n) AS q, (SELECT n_docs FROM nd) AS d FROM cnt GROUP BY term)
    SELECT term, {r('q / d - (s / d) ** 2', 9)} AS variance FROM s WHERE q / d - (s / d) ** 2 <= 0.0014""",
)
def low_variance_terms(t):
    """Variance over all documents with the zeros that are not stored."""
    rows = tokens(t, by_document=True)
    table = text.constant_terms(text.term_counts(rows, ["doc_id"]), "n", rows.agg(F.count("*")).scalar(), 0.0014)
    return rounded(table, 9, ["variance"])


# --- processes: an order is a log, its items are the processes --------------------------------


def order_lines(t, *columns):
    """(l_orderkey, lines): the items of each order with their plain columns, in tasks of about ``TASK_LINES`` of them."""
    lines = t.lineitem.select("l_orderkey", F.struct(*ITEM_KEY, *columns).alias("line"))
    placed = lines.repartition(task_count(t.spark, t.lineitem.count(), TASK_LINES), "l_orderkey")
    return placed.groupBy("l_orderkey").agg(F.collect_list("line").alias("lines"))


def in_order(value):
    """Of the items of an order, the built values in the order of the items; built after the shuffle, which moves plain columns only."""
    built = F.transform("lines", lambda x: F.struct(*[x[c].alias(c) for c in ITEM_KEY], value(x).alias("v")))
    return F.transform(F.array_sort(built), lambda s: s["v"])


def order_logs(t):
    """Logs with nested processes; an order has at most a handful of items."""

    def process(x):
        call = F.array(
            F.struct(F.concat(x["l_returnflag"], x["l_linestatus"]).alias("syscall"), x["l_quantity"].cast("long").alias("calls")),
            F.struct(F.concat(F.lit("ln"), x["l_linenumber"]).alias("syscall"), x["l_linenumber"].cast("long").alias("calls")),
        )
        return F.struct(
            F.concat(F.lit("svc"), x["l_suppkey"] % 7).alias("service_name"), (x["l_suppkey"] % 11).alias("pid"),
            x["l_quantity"].cast("long").alias("events"), (x["l_discount"] * 10).alias("cpu_usage"), call.alias("system_calls"),
        )

    logs = order_lines(t, "l_returnflag", "l_linestatus", "l_quantity", "l_discount").select("l_orderkey", in_order(process).alias("processes"))
    return logs.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", F.col("o_orderdate").alias("ts"), "processes")


PROC_SQL = f"""p AS (SELECT o_orderkey, o_orderdate, epoch_us(o_orderdate) - epoch_us(o_orderdate) % {30 * DAY} AS win_us, epoch_us(o_orderdate) AS ts_us,
      row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS proc_ord,
      'svc' || l_suppkey % 7 AS service_name, l_suppkey % 11 AS pid, l_quantity::BIGINT AS events, l_discount * 10 AS cpu,
      l_returnflag || l_linestatus AS c1, l_quantity::BIGINT AS n1, 'ln' || l_linenumber AS c2, l_linenumber::BIGINT AS n2
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    s AS (SELECT *, c1 AS syscall, n1 AS calls, 0 AS call_ord FROM p UNION ALL SELECT *, c2, n2, 1 FROM p)"""


@query(
    "process_rollup",
    f"""WITH {PROC_SQL} SELECT win_us, pid, {r('sum(cpu)', 4)} AS cpu_usage, {r('max(cpu)', 4)} AS max_cpu_usage, count(*) AS occurances,
    sum(events)::BIGINT AS events, arg_max(service_name, (ts_us, o_orderkey, proc_ord)) AS service_name FROM p GROUP BY ALL""",
)
def process_rollup(t):
    """Per window and process id; logs of one time are ordered by their key."""
    table = processes.process_rollup(order_logs(t), "ts", "30d", log_key=["o_orderkey"])
    return rounded(table, 4, ["cpu_usage", "max_cpu_usage"])


@query(
    "process_call_sequence",
    f"WITH {PROC_SQL} SELECT win_us, ts_us, o_orderkey, pid, proc_ord::INT AS proc_ord, call_ord, syscall, calls FROM s",
)
def process_call_sequence(t):
    """The system calls of every process in order, as rows."""
    return processes.process_call_sequence(order_logs(t), "ts", "30d", log_key=["o_orderkey"])


@query(
    "process_windows_nested",
    f"""WITH {PROC_SQL}, x AS (SELECT win_us, pid, arg_max(service_name, (ts_us, o_orderkey, proc_ord)) AS service_name, count(*) AS n, sum(events)::BIGINT AS events
      FROM p GROUP BY ALL)
    SELECT win_us, count(*) AS n_processes, string_agg(pid || ':' || service_name || ':' || n || ':' || events, ',' ORDER BY pid) AS processes FROM x GROUP BY 1""",
)
def process_windows_nested(t):
    """Re-nested rollup with the contents of its entries."""
    nested = processes.nested_rollup(processes.process_rollup(order_logs(t), "ts", "30d", log_key=["o_orderkey"]))
    entry = "concat_ws(':', x.pid, x.service_name, x.occurances, x.events)"
    return nested.select(
        "win_us", F.size("processes").cast("long").alias("n_processes"), F.expr(f"array_join(transform(processes, x -> {entry}), ',')").alias("processes"))


@query(
    "process_vocabulary",
    f"WITH {PROC_SQL} SELECT syscall AS term FROM s UNION SELECT service_name || ' ' || syscall FROM s WHERE calls > 5 AND cpu > 0.5",
)
def process_vocabulary(t):
    """P20: admitted terms."""
    return processes.process_vocabulary(order_logs(t))


PROC_TERMS_SQL = f"""{PROC_SQL}, v AS (SELECT syscall AS term FROM s UNION SELECT service_name || ' ' || syscall FROM s WHERE calls > 5 AND cpu > 0.5),
    tc AS (SELECT o_orderkey, service_name || ' ' || syscall AS term, calls AS n FROM s UNION ALL SELECT o_orderkey, syscall, 1 FROM s)"""


@query(
    "process_term_counts",
    f"WITH {PROC_TERMS_SQL} SELECT o_orderkey, term, sum(n)::BIGINT AS n FROM tc WHERE term IN (SELECT term FROM v) GROUP BY ALL HAVING sum(n) > 0",
)
def process_term_counts(t):
    """Qualified tokens weighted by calls, over the admitted vocabulary."""
    logs = materialise(order_logs(t))  # read for the vocabulary and for the counts
    return processes.process_term_counts(logs, ["o_orderkey"], processes.process_vocabulary(logs))


@query(
    "process_documents_tfidf",
    f"""WITH {PROC_SQL}, cnt AS (SELECT o_orderkey, proc_ord, syscall AS term, count(*) AS n FROM s GROUP BY ALL),
    idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM p)) / (1.0 + count(*))) + 1 AS idf FROM cnt GROUP BY term),
    w AS (SELECT o_orderkey, proc_ord, term, n, n * idf AS w FROM cnt JOIN idf USING (term))
    SELECT o_orderkey, proc_ord::INT AS proc_ord, term, n, {r('w / sqrt(sum(w * w) OVER (PARTITION BY o_orderkey, proc_ord))')} AS tfidf FROM w""",
)
def process_documents_tfidf(t):
    """One document per process of a log."""
    docs = processes.process_documents(order_logs(t), ["o_orderkey"])
    return rounded(text.tfidf(docs, ["o_orderkey", "proc_ord"]), 6, ["tfidf"])


def summary_logs(t):
    """Trace summaries as text, one per order."""

    def block(x):
        line = F.concat(
            F.lit("   "), F.concat(x["l_returnflag"], x["l_linestatus"]), F.lit("  "), x["l_quantity"].cast("long"), F.lit("  "),
            x["l_suppkey"], F.lit(".5  "), x["l_linenumber"], F.lit(".25  "), x["l_linenumber"], F.lit("  "), x["l_partkey"],
            F.lit(".75      "), x["l_linenumber"], F.lit(".125%\n"),
        )
        return F.concat(
            F.lit("\n svc"), x["l_suppkey"], F.lit(" ("), x["l_partkey"], F.lit("), "), x["l_quantity"].cast("long"),
            F.lit(" events, "), x["l_linenumber"], F.lit(".5%\n\n   syscall calls total min avg max stddev\n   ------\n"), line, line,
        )

    texts = order_lines(t, "l_returnflag", "l_linestatus", "l_quantity").select("l_orderkey", F.array_join(in_order(block), "\n\n\n").alias("b"))
    head = F.lit("junk\n Summary of events: none\n Summary of events:\n")
    return texts.select("l_orderkey", F.concat(head, F.lit("\n"), "b", F.lit("\n\n\nUPTIME:"), "l_orderkey", F.lit(".25\n")).alias("content"))


@query(
    "trace_summaries",
    """SELECT l_orderkey, l_orderkey || '.25' AS uptime, 'svc' || l_suppkey AS service_name, l_partkey::VARCHAR AS pid, l_quantity::BIGINT AS events,
    l_linenumber + 0.5::DOUBLE AS cpu_usage, l_returnflag || l_linestatus AS syscall, l_quantity::BIGINT AS calls, l_suppkey + 0.5::DOUBLE AS total,
    l_linenumber + 0.25::DOUBLE AS min, l_linenumber::DOUBLE AS avg, l_partkey + 0.75::DOUBLE AS max, l_linenumber + 0.125::DOUBLE AS stddev, c AS call_ord
    FROM lineitem, (SELECT unnest([0, 1])::INT AS c)""",
)
def trace_summaries(t):
    """Summary text parsed back to processes and their system calls."""
    parsed = parse_summaries(summary_logs(t))
    # The outer form keeps the optimizer from adding a size filter, which would parse twice; logs without processes give no rows below.
    rows = parsed.select("l_orderkey", "uptime", F.explode_outer("processes").alias("p")).select(
        "l_orderkey", "uptime", "p.service_name", "p.pid", "p.events", "p.cpu_usage", F.posexplode("p.system_calls").alias("call_ord", "s")
    )
    return rows.select(
        "l_orderkey", "uptime", "service_name", "pid", "events", "cpu_usage", F.col("s.syscall").alias("syscall"),
        *[F.col(f"s.{c}").alias(c) for c in ("calls", "total", "min", "avg", "max", "stddev")], "call_ord",
    )


@query(
    "quasi_json_rows",
    """SELECT event_id, event_type AS name, regexp_extract(props, '([0-9]+)', 1)::BIGINT AS k, user_id % 2 = 0 AS even,
    CASE WHEN user_id % 3 > 0 THEN value END AS value FROM events""",
)
def quasi_json_rows(t):
    """2.9i: nested values from the text of a literal with single quotes, True, False and None."""
    written = F.format_string(
        "{'name': '%s', 'counts': [{'k': %s}], 'even': %s, 'value': %s}", "event_type", F.get_json_object("props", "$.k"),
        F.expr("IF(user_id % 2 = 0, 'True', 'False')"), F.expr("IF(user_id % 3 > 0, CAST(value AS STRING), 'None')"))
    parsed = t.events.select("event_id", from_quasi_json(written, "name string, counts array<struct<k bigint>>, even boolean, value double").alias("p"))
    return parsed.select("event_id", "p.name", F.col("p.counts")[0]["k"].alias("k"), "p.even", "p.value")
