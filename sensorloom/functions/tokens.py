"""Token and call-name expressions over log text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The call pattern of the tracer's log lines and the word pattern of the bag-of-words step.
CALL_PATTERN = r"(?U)(?<=\s)(\w+)(?=\(arg0)"
WORD_PATTERN = r"(?U)\b\w\w+\b"


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def call_names(text: Column, pattern: str = CALL_PATTERN) -> Column:
    """Ordered call names of one log text."""
    return find_all(text, pattern, 1)


def words(text: Column, pattern: str = WORD_PATTERN, lowercase: bool = False) -> Column:
    return find_all(F.lower(text) if lowercase else text, pattern, 0)


def neighbours(tokens: Column) -> Column:
    """Array of (a, b) for every two neighbouring tokens."""
    left = F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0)))
    right = F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0)))
    return F.arrays_zip(left.alias("a"), right.alias("b"))


def adjacent_pairs(tokens: Column, ordered_only: bool = False) -> Column:
    """'a b' for every two neighbouring tokens, built inside the row (no shuffle).

    ``ordered_only`` keeps pairs with a < b, the only ones a vocabulary of sorted
    combinations contains.
    """
    zipped = neighbours(tokens)
    if ordered_only:
        zipped = F.filter(zipped, lambda p: p["a"] < p["b"])
    return F.transform(zipped, lambda p: F.concat_ws(" ", p["a"], p["b"]))
