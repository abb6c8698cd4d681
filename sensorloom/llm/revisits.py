"""Operator 9, resolving not-modified revisit records of a web archive.

A revisit record says that a page had not changed since an earlier full response. It is joined, as of
its time, with the latest earlier response of the same canonical URL. The stored response answers the
revisit if the validators agree (entity tags by weak comparison, else the time of last modification).
Headers that a not-modified answer may update are taken from the revisit, all others from the
response.

A URL may hold any share of all records. Records are therefore cut into slices of about equal numbers, by ranges of
URL and time; the last response of each slice is carried to the next slices in a table of one row per URL and slice, and the
join inside a slice sees a bounded number of records. A response that answers very many revisits is copied, and
its revisits are dealt to the copies. Records are told apart by a number of their own, never by their id.

Defined cases: a record without URL or time resolves to nothing; of several responses with one time
the largest record id counts (a null id is the smallest), among equal ids any one of them, and a response at the very time of
the revisit is not earlier; a revisit without any validator is not resolved, its status says why; ids may be null or repeated, and
every revisit is one row of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sensorloom.operators.lookup import join_lookup
from sensorloom.session import materialise

#: Fixed: header fields that a not-modified answer may update.
UPDATABLE = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Revisits that one copy of a response answers.
REVISITS_PER_COPY = 10_000


def canonical_url(url: Column) -> Column:
    """Host in lower case without www, no scheme, fragment, default port, tracking fields or final slash."""
    bare = F.regexp_replace(url, r"#.*$", "")
    bare = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r"^www\.|:(80|443)$", "")
    rest = F.regexp_extract(bare, r"^[^/?]*(.*)$", 1)
    rest = F.regexp_replace(rest, r"([?&])utm_[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(rest, r"&+", "&"), r"\?&", "?")
    rest = F.regexp_replace(rest, r"[?&]$", "")
    return F.concat(host, F.regexp_replace(rest, r"/$", ""))


def weak_tag(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), r"^W/", "")


def header(headers: Column, name: str) -> Column:
    return F.element_at(headers, F.lit(name))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit: record_id, url_key, fetched, response_id, status, headers.

    ``records``: record_id LONG, url STRING, fetched TIMESTAMP (or TIMESTAMP_NTZ), kind STRING
    ('response' or 'revisit'), headers MAP<STRING, STRING> with lower-case names.
    status: resolved, no_response, no_validator, changed. Only resolved rows carry merged headers.
    """
    rows = materialise(records.select(
        F.monotonically_increasing_id().alias("row"), "record_id", canonical_url(F.col("url")).alias("url_key"), "fetched", "kind", "headers"))
    known = rows.filter("url_key IS NOT NULL AND fetched IS NOT NULL AND kind IN ('response', 'revisit')")
    slim = known.select("row", "record_id", "url_key", "kind", F.expr("unix_micros(CAST(fetched AS TIMESTAMP)) AS at"))
    # Records of one URL and time stay in one slice, so a response in an earlier slice is an earlier one.
    slim = materialise(slim.repartitionByRange("url_key", "at").withColumn("slice", F.spark_partition_id()))
    response = F.when(F.col("kind") == "response", F.struct("at", "record_id", "row"))
    per_slice = slim.groupBy("url_key", "slice").agg(F.max(response).alias("last"))
    carried = materialise(per_slice.withColumn("carried", F.max("last").over(
        Window.partitionBy("url_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))).select("url_key", "slice", "carried"))
    # Inside a slice: strictly earlier times only, so equal times form one step of the frame.
    inside = Window.partitionBy("url_key", "slice").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    found = materialise(
        slim.withColumn("inside", F.max(response).over(inside)).filter("kind = 'revisit'")
        .join(carried, ["url_key", "slice"])
        .select("row", F.coalesce("inside", "carried").alias("r"))
        .select("row", F.col("r.row").alias("response_row"), F.col("r.record_id").alias("response_id")).filter("response_row IS NOT NULL"))
    popular = found.groupBy("response_row").agg(F.ceil(F.count(F.lit(1)) / REVISITS_PER_COPY).alias("copies")).filter("copies > 1")
    popular = materialise(popular)
    placed = join_lookup(found, popular, ["response_row"], stored=True, how="left").withColumn("copy", F.expr("pmod(row, coalesce(copies, 1L))"))
    stored = rows.filter("kind = 'response'").select(F.col("row").alias("response_row"), F.col("headers").alias("_stored"))
    stored = join_lookup(stored, popular, ["response_row"], stored=True, how="left").withColumn(
        "copy", F.explode(F.expr("sequence(0L, coalesce(copies, 1L) - 1)"))).drop("copies")
    answered = placed.drop("copies").join(stored, ["response_row", "copy"]).select("row", "response_row", "response_id", "_stored")
    joined = rows.filter("kind = 'revisit'").drop("kind").join(answered, "row", "left")
    tag, stored_tag = weak_tag(header(F.col("headers"), "etag")), weak_tag(header(F.col("_stored"), "etag"))
    modified, stored_modified = header(F.col("headers"), "last-modified"), header(F.col("_stored"), "last-modified")
    status = (
        F.when(F.col("response_row").isNull(), "no_response")
        .when(tag.isNotNull() & stored_tag.isNotNull(), F.when(tag == stored_tag, "resolved").otherwise("changed"))
        .when(modified.isNotNull() & stored_modified.isNotNull(), F.when(modified == stored_modified, "resolved").otherwise("changed"))
        .otherwise("no_validator")
    )
    names = ", ".join(f"'{n}'" for n in UPDATABLE)
    merged = F.expr(
        "map_from_entries(array_sort(concat("
        f"filter(map_entries(_stored), e -> NOT (e.key IN ({names}) AND map_contains_key(coalesce(headers, map()), e.key))),"
        f"filter(map_entries(coalesce(headers, map())), e -> e.key IN ({names})))))")
    return joined.withColumn("status", status).select(
        "record_id", "url_key", "fetched", "response_id", "status", F.when(F.col("status") == "resolved", merged).alias("headers"))
