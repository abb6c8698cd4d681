"""Operator 6, quality rules: how much of a text lies inside repeated n-grams and lines.

For n = 2 .. 10 a rolling hash gives all n-grams of a text. Short ones (2 to 4 words) are judged by the one that
repeats most: the characters of its second and later occurrences. Longer ones (5 to 10) mark the words inside all
windows that repeat an earlier one, whose characters are counted. Lines are treated in the same way. Second and later
occurrences count, so a text that holds one passage twice is charged with it once.

Defined cases: a null or empty text has no words, all counts are 0 and it fails the base rule; equal
rows give equal rows; windows never cross texts; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from sensorloom.llm import words as W
from sensorloom.llm.batches import map_texts

SYMBOLS = b"#*$%&|<>"
# The usual limits on the share of word characters in the most repeated 2- to 4-gram, in repeated 5- to 10-grams, and
# on the shares of repeated lines and their bytes.
TOP_LIMITS = {2: 0.20, 3: 0.18, 4: 0.16}
GRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.30
LINE_BYTE_LIMIT = 0.20
#: N-grams that are looked at one by one, most frequent first, before all are.
TRIES = 20
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, "
    "dup_line_bytes long, line_bytes long, top_chars array<long>, later_chars array<long>"
)


def marked(starts: np.ndarray, n: int, n_words: int) -> np.ndarray:
    """Marks the words inside the n-grams of the given starts."""
    steps = np.zeros(n_words + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + n, -1)
    return np.cumsum(steps[:-1]) > 0


def covered(grams: np.ndarray, n: int, n_words: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Marks the words inside n-grams that occur at least twice, and inside their second and later
    occurrences; None if there are none."""
    order = np.sort(grams)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return None
    places = np.searchsorted(twice, grams)
    places[places == len(twice)] = 0
    starts = np.flatnonzero(twice[places] == grams)
    first = np.unique(grams[starts], return_index=True)[1]
    return marked(starts, n, n_words), marked(np.delete(starts, first), n, n_words)


def top_repeated(grams: np.ndarray, upto: np.ndarray, n: int) -> int:
    """Characters of the second and later occurrences of the n-gram that has most of them; 0 if none repeats."""
    ordered = np.sort(grams)
    begins = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    again = np.diff(np.append(begins, len(ordered))) - 1
    repeated = np.flatnonzero(again)
    if not len(repeated):
        return 0
    longest, best = int((upto[n:] - upto[:-n]).max()), 0
    for tried, k in enumerate(repeated[np.argsort(-again[repeated], kind="stable")].tolist()):
        if again[k] * longest <= best:
            return best
        if tried == TRIES:
            break
        at = int(np.argmax(grams == ordered[begins[k]]))
        best = max(best, int(again[k] * (upto[at + n] - upto[at])))
    else:
        return best
    _, first, count = np.unique(grams, return_index=True, return_counts=True)
    return int(((count - 1) * (upto[first + n] - upto[first])).max())


def repetition(word_hashes: np.ndarray, chars: np.ndarray, top: list[int], lengths: list[int]) -> tuple[int, list[int], list[int]]:
    """Words inside repeated n-grams of the first of ``lengths``; characters of the most repeated n-gram for each of
    ``top``; characters inside second and later occurrences of n-grams for each of ``lengths``."""
    repeated, most, later = 0, [0] * len(top), [0] * len(lengths)
    upto = np.concatenate(([0], np.cumsum(chars)))
    grams = word_hashes
    for n in range(2, max([*top, *lengths]) + 1):
        if len(grams) < 2:
            break
        grams = W.rolled(word_hashes, grams, n)
        if n in top:
            most[top.index(n)] = top_repeated(grams, upto, n)
        if n not in lengths:
            continue
        masks = covered(grams, n, len(word_hashes))
        if masks is None:  # longer n-grams cannot repeat either
            break
        mask, again = masks
        k = lengths.index(n)
        later[k] = int(chars[again].sum())
        if k == 0:
            repeated = int(mask.sum())
    return repeated, most, later


def repeated_lines(text: bytes) -> tuple[int, int, int, int]:
    """Lines with a word, those equal to an earlier one, and the bytes of both."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    again = again_bytes = 0
    if len(set(lines)) < len(lines):
        seen: set[bytes] = set()
        for line in lines:
            if line in seen:
                again += 1
                again_bytes += len(line)
            else:
                seen.add(line)
    return len(lines), again, again_bytes, sum(map(len, lines))


def measures(texts: list[bytes], top: list[int], lengths: list[int]) -> list[list]:
    words = W.Words(texts)
    # Characters are the bytes that do not continue one.
    upto = np.concatenate(([0], np.cumsum((words.flat & 0xC0) != 0x80)))
    chars = upto[words.ends] - upto[words.starts]
    rows = []
    for text, first, last in zip(texts, words.upto[:-1].tolist(), words.upto[1:].tolist()):
        repeated, most, later = repetition(words.hashes[first:last], chars[first:last], top, lengths)
        n_lines, again, again_bytes, line_bytes = repeated_lines(text)
        symbols = len(text) - len(text.translate(None, SYMBOLS))
        rows.append((last - first, int(chars[first:last].sum()), symbols, again, repeated, n_lines, again_bytes, line_bytes, most, later))
    return [list(x) for x in zip(*rows)]


def quality_rules(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", top_limits: dict[int, float] | None = None,
                  gram_limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT,
                  line_byte_limit: float = LINE_BYTE_LIMIT, min_words: int = MIN_WORDS,
                  max_repeat_percent: int = MAX_REPEAT_PERCENT, keep: list[str] | None = None) -> DataFrame:
    """Measures and the verdict per row: the id, the columns of ``keep``, counts, base_failed, kept.

    A text fails the base rule with fewer than ``min_words`` words or more than ``max_repeat_percent`` percent of them in
    repeated 5-word windows. It is kept if it passes the base rule and second and later occurrences hold at most the given shares: of its
    characters for each length of n-gram, of its lines, and of their bytes.
    """
    tops, limits = top_limits or TOP_LIMITS, gram_limits or GRAM_LIMITS
    short, lengths = sorted(tops), sorted(limits)
    if lengths[0] != 5 or short and short[-1] >= 5:
        raise ValueError("n-grams of five words are the shortest that are marked, those of fewer words are judged by the most repeated one")
    kept = [(id_column, id_column), *((c, c) for c in keep or [])]
    out = map_texts(docs, kept, text_column, lambda texts: measures(texts, short, lengths), COLUMNS)
    out = out.selectExpr("*", f"n_words < {min_words} OR 100 * n_repeat_words > {max_repeat_percent} * n_words AS base_failed")
    return out.selectExpr("*", f"NOT base_failed AND {' AND '.join(rules(tops, limits, line_limit, line_byte_limit).values())} AS kept")


def rules(tops: dict[int, float], limits: dict[int, float], line_limit: float, line_byte_limit: float) -> dict[str, str]:
    """Name and condition of every rule beside the base rule."""
    return {
        "repeated lines": f"n_dup_lines <= {line_limit}D * n_lines",
        "bytes of repeated lines": f"dup_line_bytes <= {line_byte_limit}D * line_bytes",
        **{f"most repeated {n}-gram": f"top_chars[{i}] <= {tops[n]}D * word_chars" for i, n in enumerate(sorted(tops))},
        **{f"repeated {n}-grams": f"later_chars[{i}] <= {limits[n]}D * word_chars" for i, n in enumerate(sorted(limits))},
    }
