"""Operator 5, encoding and decoding with a merge-type sentencepiece vocabulary.

The normalised text is cut where no piece of the vocabulary reaches across: before a run of blanks,
around newlines, and between Latin letters and stops, as far as the vocabulary proves it. Each
distinct segment is encoded once for a cache of bounded bytes: its characters are the first symbols, the
adjacent pairs that form a piece are the agenda, and the pair with the best score (the leftmost among
equals) is joined until none is left. Every segment is compared with the sentencepiece library when
it enters the cache, in batches; a segment that differs sends its texts to the library and is counted
in ``n_segments_differing``.

Defined cases: a null or empty text gives the end id only and decodes to an empty text.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sensorloom.llm.batches import BoundedCache, keep_only, map_texts

BLANK = "▁"
CACHE_BYTES = 96 << 20
SCAN_LIMIT = 40
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
STOPS = ".,|"


class Pieces:
    """One vocabulary; built once per Python worker."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.library.get_piece_size()
        names = [self.library.id_to_piece(i) for i in range(size)]
        special = {i for i in range(size) if self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i)}
        self.ids = {p: i for i, p in enumerate(names) if i not in special}
        self.rank = {p: -self.library.get_score(i) for p, i in self.ids.items()}
        self.byte_ids = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.texts = [None if i in special else p.replace(BLANK, " ") for i, p in enumerate(names)]
        self.id_texts = [str(i) for i in range(size)]
        self.end = self.library.eos_id()
        self.build_pairs(size)
        self.probe = self.library.encode("\n")  # what precedes a segment in a check
        self.pattern = self.segment_pattern()
        self.all_plain = True  # every cached segment decodes to itself
        self.segments = BoundedCache(self.encode_segments, CACHE_BYTES)

    def segment_pattern(self) -> re.Pattern:
        """Cuts that no piece crosses; raises if the vocabulary does not allow even those at blanks."""
        pieces = list(self.ids)
        if any(BLANK in p.lstrip(BLANK) for p in pieces):
            raise ValueError("a piece holds a blank after another character: segments at blanks would be wrong")
        if any("\n" in p for p in pieces):
            return re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
        across = re.compile(f"[{LETTERS}][{STOPS}]|[{STOPS}][{LETTERS}]")
        if any(across.search(p) for p in pieces):
            return re.compile(f"{BLANK}+[^{BLANK}\n]*|\n|[^{BLANK}\n]+")
        return re.compile(
            f"{BLANK}*(?:[{LETTERS}]+(?=[{STOPS}{BLANK}\n]|\\Z)|[{STOPS}]+(?=[{LETTERS}{BLANK}\n]|\\Z)|[^{BLANK}\n]+)|\n|{BLANK}+"
        )

    def build_pairs(self, size: int) -> None:
        """Sorted (left id, right id) pairs that form a piece, with its rank and id; ids of single characters."""
        self.size = size
        joined = sorted(
            (self.ids[p[:k]] * size + self.ids[p[k:]], self.rank[p], i)
            for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids)
        # A last entry that no pair equals ends the search.
        self.pair_keys = np.array([*(k for k, _, _ in joined), np.iinfo(np.int64).max], np.int64)
        self.pair_ranks = np.array([*(r for _, r, _ in joined), np.inf])
        self.pair_ids = np.array([*(i for _, _, i in joined), -1], np.int64)
        self.character_ids = np.full(0x110000, -1, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.character_ids[ord(p)] = i

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (infinite if they form no piece) and id of what the symbols form."""
        keys = left * self.size + right
        place = np.searchsorted(self.pair_keys, keys)
        hit = self.pair_keys[place] == keys
        return np.where(hit, self.pair_ranks[place], np.inf), self.pair_ids[place]

    def merge_all(self, segments: list[str]) -> list[list[int]]:
        """Ids of many segments: those of one length advance together, each by its best pair."""
        out: list = [None] * len(segments)
        by_length: dict[int, list[int]] = {}
        for k, s in enumerate(segments):
            by_length.setdefault(len(s), []).append(k)
        for length, rows in by_length.items():
            if length > SCAN_LIMIT or len(rows) < 8:
                for k in rows:
                    out[k] = self.merge(segments[k])
                continue
            codes = np.frombuffer("".join([segments[k] for k in rows]).encode("utf-32-le"), np.uint32).reshape(len(rows), length)
            symbols = self.character_ids[codes].astype(np.int64)
            # A character that is no piece may be bytes or part of a longer piece.
            known = (symbols >= 0).all(axis=1)
            names = np.array(rows)
            for k in names[~known].tolist():
                out[k] = self.merge(segments[k])
            symbols, names = symbols[known], names[known]
            agenda, made = self.ranks(symbols[:, :-1], symbols[:, 1:])
            while len(names):
                if agenda.shape[1]:
                    at = agenda.argmin(axis=1)  # the leftmost of the best
                    line = np.arange(len(names))
                    going = agenda[line, at] < np.inf
                else:
                    going = np.zeros(len(names), bool)
                for k, ids in zip(names[~going].tolist(), symbols[~going].tolist()):
                    out[k] = ids
                if not going.any():
                    break
                symbols, agenda, made, names, at = symbols[going], agenda[going], made[going], names[going], at[going]
                line = np.arange(len(names))
                symbols[line, at] = made[line, at]
                symbols, agenda, made = without(symbols, at + 1), without(agenda, at), without(made, at)
                if agenda.shape[1]:
                    for pair in (at - 1, at):
                        here = (pair >= 0) & (pair < agenda.shape[1])
                        x, y = line[here], pair[here]
                        agenda[x, y], made[x, y] = self.ranks(symbols[x, y], symbols[x, y + 1])
        return out

    def merge(self, segment: str) -> list[int]:
        """Ids of a segment."""
        rank = self.rank
        symbols = list(segment)
        if len(symbols) > SCAN_LIMIT:
            symbols = self.merge_long(symbols)
        elif len(symbols) > 1:
            none = float("inf")
            agenda = [rank.get(a + b, none) for a, b in itertools.pairwise(symbols)]
            while agenda and (best := min(agenda)) < none:
                i = agenda.index(best)
                symbols[i] += symbols.pop(i + 1)
                agenda.pop(i)
                if i:
                    agenda[i - 1] = rank.get(symbols[i - 1] + symbols[i], none)
                if i < len(agenda):
                    agenda[i] = rank.get(symbols[i] + symbols[i + 1], none)
        ids, out = self.ids, []
        for s in symbols:
            known = ids.get(s)
            if known is not None:
                out.append(known)
            else:
                out.extend(self.byte_ids[b] for b in s.encode("utf-8"))
        return out

    def merge_long(self, symbols: list[str]) -> list[str]:
        """The same order of joins from a heap, for long segments."""
        rank, n = self.rank, len(symbols)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            joined = symbols[i] + symbols[j]
            if (score := rank.get(joined)) is not None:
                heapq.heappush(agenda, (score, i, j, joined))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, i, j, joined = heapq.heappop(agenda)
            if not symbols[i] or not symbols[j] or right[i] != j or symbols[i] + symbols[j] != joined:
                continue  # a neighbour has changed meanwhile
            symbols[i], symbols[j] = joined, ""
            right[i] = right[j]
            if right[i] >= 0:
                left[right[i]] = i
                offer(i, right[i])
            if left[i] >= 0:
                offer(left[i], i)
        return [s for s in symbols if s]

    def text_of(self, ids: list[int]) -> str:
        """Decoded text of the ids of a segment; runs of byte pieces are UTF-8."""
        texts = [self.texts[i] for i in ids]
        if None not in texts:
            return "".join(texts)
        out = bytearray()
        for i, text in zip(ids, texts):
            if text is None:
                out.append(self.byte_of[i])
            else:
                out += text.encode("utf-8")
        return out.decode("utf-8", "replace")

    def encode_segments(self, segments: list[str]) -> list[str | tuple[str, str] | None]:
        """Ids of each segment as text, with the decoded text where that is not the segment itself; None where the library differs."""
        own = self.merge_all(segments)
        skip = len(self.probe)
        checked = self.library.encode(["\n" + s for s in segments], num_threads=1)
        texts = list(map(self.text_of, own))
        decoded = self.library.decode([self.probe + ids for ids in own])
        out: list[str | tuple[str, str] | None] = []
        for segment, ids, seen, text, back in zip(segments, own, checked, texts, decoded):
            if ids != seen[skip:] or "\n" + text != back:
                out.append(None)
                continue
            named = " ".join([self.id_texts[i] for i in ids]) + " "
            out.append(named if text == segment.replace(BLANK, " ") else (named, text))
        self.all_plain = self.all_plain and all(type(x) is str for x in out)
        return out

    def encode(self, texts: list[bytes]) -> tuple[list[str], list[int], list[str], list[int]]:
        """Ids joined by blanks, number of ids (both with the end id), decoded texts, differing segments."""
        cut = [self.pattern.findall(BLANK + t.decode("utf-8").replace(" ", BLANK)) if t else [] for t in texts]
        self.segments.fill(set(itertools.chain.from_iterable(cut)))
        find = self.segments.__getitem__
        ids, decoded, differing = [], [], []
        for raw, segments in zip(texts, cut):
            found = list(map(find, segments))
            wrong = 0 if self.all_plain else sum(f is None for f in found)
            if wrong or not found:
                text = raw.decode("utf-8")
                own = [*self.library.encode(text), self.end]
                ids.append(" ".join(map(str, own)))
                decoded.append(self.library.decode(own))
            elif self.all_plain:
                ids.append("".join(found) + str(self.end))
                decoded.append("".join(segments).replace(BLANK, " ")[1:])
            else:
                ids.append("".join([f if type(f) is str else f[0] for f in found]) + str(self.end))
                decoded.append("".join([s.replace(BLANK, " ") if type(f) is str else f[1] for s, f in zip(segments, found)])[1:])
            differing.append(wrong)
        return ids, [x.count(" ") + 1 for x in ids], decoded, differing


def without(table: np.ndarray, column: np.ndarray) -> np.ndarray:
    """The table less one element of every row."""
    keep = np.ones(table.shape, bool)
    keep[np.arange(len(table)), column] = False
    return table[keep].reshape(len(table), table.shape[1] - 1)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def encode_pieces(docs: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text", digest: bool = False,
                  with_ids: bool = False) -> DataFrame:
    """id, n_tokens, ids, decoded, n_segments_differing; with ``digest`` SHA-256 of ids and decoded text instead of both.

    ``with_ids`` adds ``token_ids``, the ids as numbers.
    """
    columns = "n_tokens long, ids string, decoded string, n_segments_differing long"
    if digest:
        columns = "n_tokens long, ids_sha256 string, decoded_sha256 string, n_segments_differing long"

    columns += ", token_ids array<int>" if with_ids else ""

    def compute(texts: list[bytes]) -> list[list]:
        keep_only("pieces", pieces.cache_clear)
        ids, counts, decoded, differing = pieces(model).encode(texts)
        numbers = [pa.array([np.fromstring(x, np.int32, sep=" ") for x in ids], pa.list_(pa.int32()))] if with_ids else []
        if digest:
            ids, decoded = list(map(sha256, ids)), list(map(sha256, decoded))
        return [counts, ids, decoded, differing, *numbers]

    return map_texts(docs, [(id_column, id_column)], text_column, compute, columns)
