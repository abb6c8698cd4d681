import math

import pytest
from pyspark.sql import functions as F

from sensorloom.operators import lookup, processes, text
from sensorloom.plans.call_encoding import encode_documents
from sensorloom.session import materialise
from sensorloom.sources.logs import parse_summaries


def docs(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
    return text.tokenised(df, ["doc"], "text")


def test_call_names_need_blank_and_first_argument(spark):
    df = spark.createDataFrame([("x read(arg0: 1) =write(arg0) \n open(arg0) close(fd)",)], "t string")
    assert text.extract_calls(df, "t").collect()[0]["calls"] == ["read", "open"]


def test_idf_and_unit_rows(spark):
    rows = docs(spark, "aa bb aa", "bb", None)
    table = text.tfidf(rows, ["doc"])
    idf = {r["term"]: r["idf"] for r in text.idf_table(text.term_counts(rows, ["doc"]), F.lit(2)).collect()}
    assert idf["aa"] == pytest.approx(math.log(3 / 2) + 1) and idf["bb"] == pytest.approx(1.0)
    norms = table.groupBy("doc").agg(F.sum(F.col("tfidf") * F.col("tfidf")).alias("s")).collect()
    assert all(r["s"] == pytest.approx(1.0) for r in norms)


def test_vocabulary_skips_single_letters_and_nulls(spark):
    terms = text.with_term_ids(text.vocabulary(docs(spark, "b read é ça", None, "Alpha read"))).orderBy("term_id").collect()
    assert [(r["term"], r["term_id"]) for r in terms] == [("Alpha", 0), ("read", 1), ("ça", 2)]


def test_pairs(spark):
    rows = docs(spark, "bb aa bb", "xx")
    all_pairs = {(r["term"]): r["n"] for r in text.term_counts(text.pair_tokens(rows, keep_single=False), ["doc"]).collect()}
    ordered = {(r["term"]): r["n"] for r in text.term_counts(text.pair_tokens(rows, True, False), ["doc"]).collect()}
    assert all_pairs == {"bb aa": 1, "aa bb": 1} and ordered == {"aa bb": 1}


def test_row_scaling_of_equal_values_is_null(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "b", 4.0), (2, "a", 3.0)], "doc int, term string, v double")
    out = {(r["doc"], r["term"]): r["scaled"] for r in text.minmax_rows(df, ["doc"], "v").collect()}
    assert out == {(1, "a"): 0.0, (1, "b"): 1.0, (2, "a"): None}


def test_constant_terms_count_the_zeros(spark):
    df = spark.createDataFrame([(1, "always", 3.0), (2, "always", 3.0), (1, "once", 3.0)], "doc int, term string, v double")
    assert [r["term"] for r in text.constant_terms(df, "v", F.lit(2)).collect()] == ["always"]


def test_encoding_drops_short_terms(spark):
    df = spark.createDataFrame([(1, ["a", "open", "read"]), (2, None)], "doc int, calls array<string>")
    assert {r["term"] for r in encode_documents(df, ["doc"]).collect()} == {"open", "read"}


LOG = """noise
 Summary of events: old
 x (1), 1 events, 9.9%
 Summary of events:

 sshd (812), 40 events, 1.5%

   syscall            calls    total       min       avg       max      stddev
                               (msec)    (msec)    (msec)    (msec)        (%)
   --------------- -------- --------- --------- --------- ---------     ------
   read                  12     0.500     0.010     0.041     0.100     12.25%
   close                  3     1         0.1       0.3       0.5        1.00%


 UPTIME:1.0


 my service (9), 7 events, 0.2%

   ------
   futex   7   2.0   0.1   0.2   0.9    3.50%


 UPTIME:99.5
"""


def logs(spark):
    return parse_summaries(spark.createDataFrame([("1700000000", LOG)], "timestamp string, content string"))


def test_trace_summary(spark):
    row = logs(spark).collect()[0]
    assert row["uptime"] == "99.5"
    names = [(p["service_name"], p["pid"], p["events"], p["cpu_usage"]) for p in row["processes"]]
    assert names == [("sshd", "812", 40, 1.5), ("my service", "9", 7, 0.2)]
    first = [(c["syscall"], c["calls"], c["avg"], c["stddev"]) for c in row["processes"][0]["system_calls"]]
    assert first == [("read", 12, 0.041, 12.25), ("close", 3, 0.3, 1.0)]


def test_process_terms(spark):
    table = logs(spark).withColumn("ts", F.timestamp_seconds(F.col("timestamp").cast("long")))
    vocab = processes.process_vocabulary(table)
    assert {r["term"] for r in vocab.collect()} == {"read", "close", "futex", "sshd read"}
    counts = {r["term"]: r["n"] for r in processes.process_term_counts(table, ["timestamp"], vocab).collect()}
    assert counts == {"read": 1, "close": 1, "futex": 1, "sshd read": 12}
    rollup = {r["pid"]: r for r in processes.process_rollup(table.union(table), "ts", "20s").collect()}
    assert rollup["812"]["cpu_usage"] == 3.0 and rollup["812"]["max_cpu_usage"] == 1.5 and rollup["812"]["occurances"] == 2


def test_pairs_have_their_place_among_all_combinations(spark):
    import itertools

    from pyspark.sql import functions as F

    for n in (2, 3, 7, 40):
        pairs = list(itertools.combinations(range(n), 2))
        df = spark.createDataFrame([(i, a, b, n) for i, (a, b) in enumerate(pairs)], "rank long, a long, b long, n long")
        first, second = text.pair_members("rank", "n")
        wrong = df.filter(F.expr(f"{text.pair_rank('a', 'b', 'n')} <> rank OR {first} <> a OR {second} <> b"))
        assert wrong.count() == 0
    # A vocabulary whose pairs could never be listed.
    n = 3_000_000_000
    ends = [(0, 1), (0, n - 1), (1, 2), (n // 2, n // 2 + 1), (n - 3, n - 1), (n - 2, n - 1), (123_456_789, 2_987_654_321)]
    df = spark.createDataFrame([(a, b, n) for a, b in ends], "a long, b long, n long").withColumn("rank", F.expr(text.pair_rank("a", "b", "n")))
    first, second = text.pair_members("rank", "n")
    assert [(r["x"], r["y"]) for r in df.select(F.expr(first).alias("x"), F.expr(second).alias("y")).collect()] == ends


def test_joined_vocabulary(spark):
    docs = spark.createDataFrame([(1, ["b", "c", "a", "b", "b"]), (2, ["a", "c"]), (3, []), (4, ["x"])], "d int, tokens array<string>")
    terms = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "term string, term_id long")
    got = sorted((r["d"], r["term_id"], r["n"]) for r in text.joined_term_counts(docs, ["d"], terms).collect())
    # Pairs: a b = 3, a c = 4, b c = 5; "c a" and "b b" are not ascending, x is unknown.
    assert got == [(1, 0, 1), (1, 1, 3), (1, 2, 1), (1, 3, 1), (1, 5, 1), (2, 0, 1), (2, 2, 1), (2, 4, 1)]
    names = {r["term_id"]: r["term"] for r in text.joined_term_names(text.joined_term_counts(docs, ["d"], terms), terms).collect()}
    assert names == {0: "a", 1: "b", 2: "c", 3: "a b", 4: "a c", 5: "b c"}


def widest_broadcast(df):
    """Nodes of the plan that send a table to every task, other than the few heavy keys."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "BroadcastHashJoin" in line and "_salt" in line.split("]")[0]]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_large_tables_are_not_broadcast_with_their_copies(spark, monkeypatch, how):
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(lookup, "HEAVY_ROWS", 5)
    keys = ["many"] * 7 + ["few", "few", "unknown", None, None]
    rows = spark.createDataFrame(list(enumerate(keys)), "i long, k string")
    table = materialise(spark.createDataFrame([("many", 1), ("few", 2), ("unused", 3)], "k string, v int"))
    joined = lookup.join_terms(rows, table, ["k"], F.col("i"), how=how)
    values = {"many": 1, "few": 2}
    kept = [(k, i) for i, k in enumerate(keys) if how == "left" or k in values]
    expected = kept if how == "left_semi" else [(k, i, values.get(k)) for k, i in kept]
    assert sorted(map(tuple, joined.collect()), key=lambda r: r[1]) == expected
    assert joined.columns == (["k", "i"] if how == "left_semi" else ["k", "i", "v"])
    assert not widest_broadcast(joined)
    looked_up = None if how == "left_semi" else lookup.join_lookup(rows, table, ["k"], how=how)
    assert looked_up is None or sorted(map(tuple, looked_up.collect()), key=lambda r: r[1]) == expected and not widest_broadcast(looked_up)


def test_names_and_ids_of_pairs_through_salted_joins(spark, monkeypatch):
    rows = docs(spark, "bb aa bb cc", "aa bb", "aa cc")
    terms = materialise(text.with_term_ids(text.vocabulary(rows)))
    matrix = text.joined_term_counts(rows, ["doc"], terms)
    plain = sorted(map(tuple, matrix.collect()))
    names = sorted(map(tuple, text.joined_term_names(matrix.select("term_id").distinct(), terms).collect()))
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(lookup, "HEAVY_ROWS", 2)
    again = text.joined_term_counts(rows, ["doc"], terms)
    assert sorted(map(tuple, again.collect())) == plain and not widest_broadcast(again)
    renamed = text.joined_term_names(again.select("term_id").distinct(), terms)
    assert sorted(map(tuple, renamed.collect())) == names == [(0, "aa"), (1, "bb"), (2, "cc"), (3, "aa bb"), (4, "aa cc"), (5, "bb cc")]
    assert not widest_broadcast(renamed)


def test_tfidf_through_salted_joins(spark, monkeypatch):
    rows = docs(spark, "aa bb aa", "bb cc", "bb", None)
    plain = sorted(map(tuple, text.tfidf(rows, ["doc"]).collect()))
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(text, "HEAVY_ROWS", 3)
    table = text.tfidf(rows, ["doc"])
    assert sorted(map(tuple, table.collect())) == plain and not widest_broadcast(table)


def test_tasks_follow_the_size_of_the_texts(spark, monkeypatch):
    monkeypatch.setattr(text, "TASK_TEXT_BYTES", 100)
    sizes = {}
    for n in (40, 160):
        df = spark.range(n).select(F.col("id").alias("doc"), F.lit("aa bb cc dd aa ").alias("text")).unionByName(
            spark.createDataFrame([(None, None), (0, "aa")], "doc long, text string"))
        rows = text.tokenised(df, ["doc"], "text", by_document=True)
        held = text.term_counts(rows, ["doc"]).withColumn("task", F.spark_partition_id())
        sizes[n] = held.select("task").distinct().count()
        assert {(r["term"], r["n"]) for r in held.collect()} == {("aa", 2), ("aa", 3), ("bb", 1), ("cc", 1), ("dd", 1)}
        # Counted where the texts were placed: a document is in one task.
        assert held.groupBy("doc").agg(F.countDistinct("task").alias("t")).filter("t > 1").isEmpty()
    assert sizes[40] <= 8 and sizes[160] > 2 * 8


def test_process_counts_in_tasks_of_bounded_calls(spark, monkeypatch):
    monkeypatch.setattr(processes, "TASK_CALLS", 10)
    schema = "o long, processes array<struct<service_name:string, pid:int, events:long, cpu_usage:double, system_calls:array<struct<syscall:string, calls:long>>>>"
    log = [("s", 1, 1, 0.9, [("read", 7), ("open", 0)]), ("s", 2, 1, 0.1, None)]
    logs = spark.createDataFrame([*[(i, log) for i in range(40)], (3, log), (None, log), (7, None)], schema)
    counts = processes.process_term_counts(logs, ["o"], processes.process_vocabulary(logs))
    found = {}
    for r in counts.collect():
        found.setdefault(r["o"], {})[r["term"]] = r["n"]
    assert found == {o: {"read": k, "open": k, "s read": 7 * k} for o in [*range(40), None] for k in [2 if o == 3 else 1]}
    assert counts.withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 4


def test_summary_paragraphs_are_parsed_once(spark):
    block = "\n svc a (12), 3 events, 0.5%\n\n   syscall calls\n   ------\n   read  2  1.5  0.25  1  7.75      0.125%\n"
    texts = [f" Summary of events:\n{block}\n\n\nplain\n\n\nUPTIME:7.25\n", " Summary of events:\nUPTIME:1.5\n", "no mark", None,
             " Summary of events:\n\n b (1), 2 events, 4.5%\n"]
    out = parse_summaries(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, content string")).orderBy("i")
    rows = [(r["uptime"], None if r["processes"] is None else [(p["service_name"], p["pid"], p["events"], p["cpu_usage"], [tuple(c) for c in p["system_calls"]])
                                                               for p in r["processes"]]) for r in out.collect()]
    call = ("read", 2, 1.5, 0.25, 1.0, 7.75, 0.125)
    assert rows == [("7.25", [("svc a", "12", 3, 0.5, [call])]), ("1.5", []), ("", []), ("", None), ("", [("b", "1", 2, 4.5, [])])]
    # One match gives the header's fields: the pattern is there to look for headers and to read them, not once for each field.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("events,") <= 3


def test_summary_query_does_not_parse_for_a_filter(spark, tmp_path):
    from sensorloom.workload.text_queries import trace_summaries
    from sensorloom.workload.registry import Tables

    spark.sql("""SELECT 7L AS l_orderkey, 1 AS l_linenumber, 5L AS l_partkey, 3L AS l_suppkey, 2.5D AS l_extendedprice, 4D AS l_quantity,
        0.1D AS l_discount, 'A' AS l_returnflag, 'F' AS l_linestatus""").write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = trace_summaries(Tables(spark, str(tmp_path)))
    assert [(r["service_name"], r["pid"], r["syscall"], r["call_ord"]) for r in rows.orderBy("call_ord").collect()] == [("svc3", "5", "AF", 0), ("svc3", "5", "AF", 1)]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "Filter" in line and "regexp_extract_all" in line]
