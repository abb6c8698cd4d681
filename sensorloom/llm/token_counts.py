"""Operator 4, token counts of byte-level BPE with a shortcut for whole tokens.

The pre-tokeniser cuts a text into pre-tokens that are encoded independently. Offline, every
vocabulary string is encoded alone: those that give exactly one token (their own) form the whole
tokens, and a pre-token among them counts 1 without any merge. Only other pre-tokens are merged, each
distinct one once for a cache of bounded bytes.

The pre-tokeniser's pattern names Unicode classes, and regular expression libraries follow
different Unicode versions. Texts whose characters all lie in ``AGREED`` are cut here, with classes
spelled out from the character database; a test compares every character of these ranges with the
library. Any other text is cut by the library's own pre-tokeniser, and counted in the same way.

Defined cases: a null or empty text has no bytes and no tokens. Strings of special tokens inside a
text count as the library counts them by default, one token each.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame

from sensorloom.llm.batches import BoundedCache, keep_only, map_texts

# Latin, Greek, Cyrillic and general punctuation, as ranges of code points.
AGREED = ((0x0000, 0x052F), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20BF))
CACHE_BYTES = 64 << 20
PIECE_OF_LONG_TEXT = 200_000


def character_class(kinds: str) -> str:
    """Members of the agreed ranges whose general category starts with one of the letters."""
    members = [c for low, high in AGREED for c in range(low, high + 1) if unicodedata.category(chr(c))[0] in kinds]
    out = []
    for _, run in itertools.groupby(enumerate(members), lambda x: x[1] - x[0]):
        run = [c for _, c in run]
        out.append(f"\\u{run[0]:04x}-\\u{run[-1]:04x}")
    return "".join(out)


def pre_token_pattern() -> re.Pattern:
    """Contractions, words, numbers, other marks (each with one blank before it), white space."""
    letters, digits, white = character_class("L"), character_class("N"), "\\u0009-\\u000d\\u0020\\u0085\\u00a0"
    return re.compile(
        f"'(?:s|t|re|ve|m|ll|d)| ?[{letters}]+| ?[{digits}]+| ?[^{white}{letters}{digits}]+|[{white}]+(?![^{white}])|[{white}]+"
    )


def outside_pattern() -> re.Pattern:
    return re.compile("[^" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in AGREED) + "]")


class Counter:
    """Counts tokens with one vocabulary; built once per Python worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.pattern, self.outside = pre_token_pattern(), outside_pattern()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.whole = self.whole_tokens()
        self.rest = BoundedCache(self.merge, CACHE_BYTES)

    def whole_tokens(self) -> dict[str, int]:
        """Vocabulary strings that are one pre-token and that the library encodes as one token."""
        ids = self.library.get_vocab_size(with_added_tokens=False)
        strings = [s for s in self.library.decode_batch([[i] for i in range(ids)], skip_special_tokens=False) if s and "�" not in s]
        strings = [s for s in dict.fromkeys(strings) if s not in self.special and len(self.library_cuts(s)) == 1]
        encoded = self.library.encode_batch(strings, add_special_tokens=False)
        return {s: 1 for s, e in zip(strings, encoded) if len(e.ids) == 1}

    def library_cuts(self, text: str) -> list[str]:
        """Pre-tokens by the library's own pre-tokeniser."""
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def merge(self, pre_tokens: list[str]) -> list[int]:
        """Tokens of each pre-token, merged by the library's ranks."""
        encoded = self.library.encode(pre_tokens, is_pretokenized=True, add_special_tokens=False)
        counts = [0] * len(pre_tokens)
        for word in encoded.word_ids:
            counts[word] += 1
        return counts

    def pre_tokens(self, text: str):
        """Lists of pre-tokens; by the library's own cuts if the text holds characters beyond the agreed ones."""
        if self.outside.search(text):
            yield self.library_cuts(text)
            return
        if len(text) <= PIECE_OF_LONG_TEXT:
            yield self.pattern.findall(text)
            return
        found = (m.group() for m in self.pattern.finditer(text))
        while piece := list(itertools.islice(found, PIECE_OF_LONG_TEXT)):
            yield piece

    def count(self, texts: list[bytes]) -> list[int]:
        totals = [0] * len(texts)
        pending: list[tuple[int, list[str]]] = []
        held = 0
        for i, raw in enumerate(texts):
            text = raw.decode("utf-8")
            parts = [text]
            if self.cut_special and any(s in text for s in self.special):
                parts = self.cut_special.split(text)
                totals[i] += len(parts) // 2
                parts = parts[::2]
            for part in parts:
                for tokens in self.pre_tokens(part):
                    pending.append((i, tokens))
                    held += len(tokens)
                    if held > 2 * PIECE_OF_LONG_TEXT:
                        self.settle(pending, totals)
                        pending, held = [], 0
        self.settle(pending, totals)
        return totals

    def settle(self, pending: list[tuple[int, list[str]]], totals: list[int]) -> None:
        whole, others = self.whole, []
        for i, tokens in pending:
            rest = [t for t in tokens if t not in whole]
            totals[i] += len(tokens) - len(rest)
            others.append(rest)
        self.rest.fill(set(itertools.chain.from_iterable(others)))
        cost = self.rest.__getitem__
        for (i, _), rest in zip(pending, others):
            totals[i] += sum(map(cost, rest))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", limit: int = 1024) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``) per row, for a tokenizers .json file."""

    def compute(texts: list[bytes]) -> list[list]:
        keep_only("token counts", counter.cache_clear)
        counts = counter(vocabulary).count(texts)
        return [[len(t) for t in texts], counts, [n > limit for n in counts]]

    return map_texts(docs, [(id_column, id_column)], text_column, compute, "n_bytes long, n_tokens long, over_limit boolean")
