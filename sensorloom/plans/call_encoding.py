"""System-call encoding job: archives -> calls -> vocabulary -> TF-IDF table (3.1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from sensorloom.operators.lookup import join_lookup
from sensorloom.operators.text import extract_calls, pair_tokens, term_counts, tfidf_from_counts, vocabulary
from sensorloom.sources.archives import read_archives


def call_documents(archives: DataFrame, keep_errors: bool = False) -> DataFrame:
    """(file_path, entry, timestamp, calls, label, device): one document per log.

    ``keep_errors`` adds the column ``error`` and the rows of unreadable archives and entries.
    """
    texts = read_archives(archives)
    if not keep_errors:
        texts = texts.filter(F.col("content").isNotNull()).drop("error")
    calls = extract_calls(texts, "content").drop("content")
    return join_lookup(calls, archives.select("file_path", "file_name", "label", "device"), ["file_path"])


def encode_documents(
    documents: DataFrame, doc: Sequence[str], tokens: str = "calls", vocab: DataFrame | None = None, pairs: bool = False,
    ordered_pairs_only: bool = False, min_length: int = 2,
) -> DataFrame:
    """(doc keys, term, n, tfidf) over the vocabulary of the documents or a given one.

    Terms shorter than two characters are not part of a vocabulary.
    """
    kept = F.filter(F.col(tokens), lambda t: F.length(t) >= min_length)
    rows = documents.filter(F.col(tokens).isNotNull()).select(*doc, kept.alias("tokens"))
    if pairs:
        rows = pair_tokens(rows, ordered_pairs_only)
    counts = term_counts(rows, doc, vocab)
    return tfidf_from_counts(counts, doc, rows.agg(F.count("*")).scalar())


def call_vocabulary(documents: DataFrame, tokens: str = "calls") -> DataFrame:
    return vocabulary(documents, tokens).filter(F.length("term") >= 2)
