"""Bag-of-words encoding of log documents in long form.

A matrix is a table (document keys, term, value). Counting happens per document and
term, so a very frequent term is combined before any shuffle on the term.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sensorloom.functions.numeric import ratio
from sensorloom.functions.tokens import WORD_PATTERN, adjacent_pairs, call_names, neighbours, words
from sensorloom.operators.lookup import HEAVY_ROWS, join_lookup, join_terms
from sensorloom.operators.ordering import with_row_index
from sensorloom.session import materialise, task_count

TASK_TEXT_BYTES = 16 << 20


def extract_calls(df: DataFrame, text: str, pattern: str | None = None) -> DataFrame:
    """Adds ``calls`` ARRAY<STRING>: call names in order of appearance."""
    return df.withColumn("calls", call_names(F.col(text), pattern) if pattern else call_names(F.col(text)))


def tokenised(
    df: DataFrame, doc: Sequence[str], text: str, pattern: str = WORD_PATTERN, lowercase: bool = False, by_document: bool = False
) -> DataFrame:
    """(doc keys, tokens); documents without text are dropped.

    ``by_document`` places the texts by document first: one shuffle of the short text instead
    of two of its terms when both counts and row norms per document follow. The number of tasks
    follows the measured size of the texts, so a task holds the counts of ``TASK_TEXT_BYTES`` of them.
    """
    rows = df.filter(F.col(text).isNotNull()).select(*doc, text)
    if by_document:
        size = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
        rows = rows.repartition(task_count(df.sparkSession, size, TASK_TEXT_BYTES), *doc)
    return rows.select(*doc, words(F.col(text), pattern, lowercase).alias("tokens"))


def exploded_terms(tokens: DataFrame, doc: Sequence[str], column: Column) -> DataFrame:
    """One row per token. The outer form keeps the optimizer from adding a size filter, which would tokenise twice."""
    return tokens.select(*doc, F.explode_outer(column).alias("term")).filter(F.col("term").isNotNull())


def vocabulary(tokens: DataFrame, column: str = "tokens") -> DataFrame:
    """Distinct terms (T3), unordered; ``with_term_ids`` numbers them."""
    return exploded_terms(tokens, [], F.array_distinct(column)).distinct()


def with_term_ids(terms: DataFrame) -> DataFrame:
    """Adds ``term_id``: position in the sorted vocabulary, from a range-partitioned sort.

    The terms are stored first, because finding the ranges reads them a second time.
    """
    return with_row_index(materialise(terms), ["term"], "term_id")


def term_counts(
    tokens: DataFrame, doc: Sequence[str], vocab: DataFrame | None = None, column: str = "tokens"
) -> DataFrame:
    """(doc keys, term, n) over the given vocabulary, or over all terms (T4)."""
    counted = exploded_terms(tokens, doc, F.col(column)).groupBy(*doc, "term").agg(F.count("*").alias("n"))
    if vocab is None:
        return counted
    return join_terms(counted, vocab.select("term").distinct(), ["term"], F.xxhash64(*doc), how="left_semi")


def pair_tokens(tokens: DataFrame, ordered_only: bool = False, keep_single: bool = True) -> DataFrame:
    """Tokens plus neighbouring pairs (T6); pairs are built inside the row."""
    pairs = adjacent_pairs(F.col("tokens"), ordered_only)
    return tokens.withColumn("tokens", F.concat(F.col("tokens"), pairs) if keep_single else pairs)


def pair_rank(first: str, second: str, n: str) -> str:
    """Expression: position of the pair (first < second, both in 0 .. n - 1) among all pairs in their order."""
    return f"(({first}) * (2 * ({n}) - ({first}) - 1)) div 2 + ({second}) - ({first}) - 1"


def pair_members(rank: str, n: str) -> tuple[str, str]:
    """Expressions for both members of the pair at a position; the inverse of ``pair_rank``."""
    # Counted from the last pair, the pairs of the last k + 1 first members are a triangular number, exact enough for a root.
    back = f"(({n}) * (({n}) - 1) div 2 - 1 - ({rank}))"
    guess = f"CAST(floor((sqrt(8D * {back} + 1) - 1) / 2) AS LONG)"
    triangle = lambda k: f"(({k}) * (({k}) + 1) div 2)"
    # The root may be off by one.
    k = f"CASE WHEN {triangle(guess)} > {back} THEN {guess} - 1 WHEN {triangle(f'{guess} + 1')} <= {back} THEN {guess} + 1 ELSE {guess} END"
    first = f"(({n}) - 2 - {k})"
    return first, f"({rank}) - ({first} * (2 * ({n}) - {first} - 1)) div 2 + {first} + 1"


def joined_term_counts(tokens: DataFrame, doc: Sequence[str], terms: DataFrame) -> DataFrame:
    """(doc keys, term_id, n) over single terms and all pairs a < b of the vocabulary.

    ``terms`` (term, term_id) is the sorted vocabulary of n terms, stored. The joined vocabulary holds the terms and then their
    n (n - 1) / 2 pairs in order; a pair's number follows from its two terms, so the pairs are never listed. Counted are
    neighbouring tokens; terms outside the vocabulary and the pairs with them are left out.
    """
    n = terms.agg(F.count("*")).scalar()
    ids = lambda name: terms.select(F.col("term").alias(name), F.col("term_id").alias(f"{name}_id"))
    spread = F.xxhash64(*doc)
    # Counts are stored where a join reads them, which counts the rows of a term first if the vocabulary is large.
    single = materialise(term_counts(tokens, doc).withColumnRenamed("term", "a"))
    singles = join_terms(single, ids("a"), ["a"], spread, stored=True).select(*doc, F.col("a_id").alias("term_id"), "n")
    pairs = tokens.select(*doc, F.explode_outer(neighbours(F.col("tokens"))).alias("p")).filter("p.a < p.b").groupBy(
        *doc, F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("n"))
    for side in ("a", "b"):
        pairs = join_terms(materialise(pairs), ids(side), [side], spread, stored=True)
    numbered = pairs.withColumn("_n", n).select(*doc, F.expr(f"_n + {pair_rank('a_id', 'b_id', '_n')}").alias("term_id"), "n")
    return singles.unionByName(numbered)


def joined_term_names(matrix: DataFrame, terms: DataFrame) -> DataFrame:
    """Adds ``term``: the name behind each number of the joined vocabulary."""
    n = terms.agg(F.count("*")).scalar()
    first, second = pair_members("term_id - _n", "_n")
    placed = matrix.withColumn("_n", n).withColumns({
        "_a": F.expr(f"IF(term_id < _n, term_id, {first})"), "_b": F.expr(f"IF(term_id < _n, NULL, {second})")})
    named = lambda c, key: terms.select(F.col("term").alias(c), F.col("term_id").alias(key))
    left = materialise(join_lookup(materialise(placed), named("_left", "_a"), ["_a"], stored=True))
    joined = join_lookup(left, named("_right", "_b"), ["_b"], stored=True, how="left")
    return joined.withColumn("term", F.concat_ws(" ", "_left", "_right")).drop("_n", "_a", "_b", "_left", "_right")


def document_frequency(counts: DataFrame) -> DataFrame:
    """Documents per term. Reading ``n`` keeps the plan equal to the count table's own, so its shuffle is reused."""
    return counts.groupBy("term").agg(F.count_if(F.col("n") > 0).alias("df"))


def idf_table(counts: DataFrame, n_docs: Column) -> DataFrame:
    """(term, df, idf) with idf = ln((1 + n) / (1 + df)) + 1."""
    return document_frequency(counts).withColumn(
        "idf", F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    )


def tfidf_from_counts(counts: DataFrame, doc: Sequence[str], n_docs: Column) -> DataFrame:
    """(doc keys, term, n, tfidf): n * idf, scaled to length 1 per document (T5).

    The counts are stored, because weights and documents per term both come from them. The window is over one document's
    distinct terms. Terms join by broadcast or salted by document, because a term of every document would bring a row of
    each of them to one task.
    """
    counts = materialise(counts)
    idf = materialise(idf_table(counts, n_docs))
    heavy = idf.filter(F.col("df") >= HEAVY_ROWS).select("term")
    weighted = join_terms(counts, idf.select("term", "idf"), ["term"], F.xxhash64(*doc), stored=True, heavy=heavy).withColumn(
        "w", F.col("n") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*doc)))
    return weighted.select(*doc, "term", "n", ratio(F.col("w"), norm).alias("tfidf"))


def tfidf(tokens: DataFrame, doc: Sequence[str], vocab: DataFrame | None = None) -> DataFrame:
    """TF-IDF of tokenised documents; every row of ``tokens`` counts as a document."""
    return tfidf_from_counts(term_counts(tokens, doc, vocab), doc, tokens.agg(F.count("*")).scalar())


def top_idf(counts: DataFrame, n_docs: Column, k: int = 10) -> DataFrame:
    """The k terms of the highest IDF, ties by term (K7)."""
    return idf_table(counts, n_docs).orderBy(F.desc("idf"), "term").limit(k)


def minmax_rows(matrix: DataFrame, doc: Sequence[str], value: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Row-wise min-max over the stored values; null where all of them are equal."""
    row = Window.partitionBy(*doc)
    lo, hi = F.min(value).over(row), F.max(value).over(row)
    scaled = ratio(F.col(value) - lo, hi - lo) * F.lit(high - low) + F.lit(low)
    return matrix.withColumn("scaled", scaled)


def term_extremes(matrix: DataFrame, value: str, vocab: DataFrame) -> DataFrame:
    """Largest and smallest stored value per vocabulary term, 0 for an unused term."""
    found = matrix.filter(F.col(value) != 0).groupBy("term").agg(F.max(value).alias("hi"), F.min(value).alias("lo"))
    return vocab.select("term").join(found, "term", "left").select(
        "term", F.coalesce("hi", F.lit(0)).alias("max_value"), F.coalesce("lo", F.lit(0)).alias("min_value")
    )


def constant_terms(matrix: DataFrame, value: str, n_docs: Column, threshold: float = 0.0) -> DataFrame:
    """Terms whose variance over all documents, zeros included, does not exceed the threshold.

    The zeros are not stored: they enter through the document count.
    """
    x = F.col(value).cast("double")
    stats = matrix.groupBy("term").agg(
        F.count("*").alias("stored"), F.sum(x).alias("s"), F.var_pop(x).alias("v"), F.avg(x).alias("m"),
        F.min(x).alias("lo"), F.max(x).alias("hi"),
    ).withColumn("n_docs", n_docs.cast("double"))
    zeros = F.col("n_docs") - F.col("stored")
    variance = (F.col("v") * F.col("stored") + F.col("m") * F.col("m") * F.col("stored") * zeros / F.col("n_docs")) / F.col("n_docs")
    lo = F.when(zeros > 0, F.least(F.col("lo"), F.lit(0.0))).otherwise(F.col("lo"))
    hi = F.when(zeros > 0, F.greatest(F.col("hi"), F.lit(0.0))).otherwise(F.col("hi"))
    judged = stats.select("term", variance.alias("variance"), (hi - lo).alias("spread"))
    # Zero variance is decided on the exact spread, not on a rounded moment.
    return judged.filter(F.col("spread") == 0 if threshold == 0 else F.col("variance") <= threshold).select("term", "variance")
