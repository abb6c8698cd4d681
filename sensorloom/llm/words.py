"""Words of UTF-8 texts as hashes, without making an object for each word, and n-gram hashes over them."""

from __future__ import annotations

import numpy as np

# Odd multipliers of the rolling hashes and of the final mixing.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
#: Fixed: the white space that separates words.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A random number for each byte value.
BYTES = np.random.default_rng(20240501).integers(0, 1 << 64, 256, np.uint64)
STRIDE = 1 << 18


class Powers:
    """Powers of the base and of its inverse modulo 2^64, as many as the longest stretch of bytes needs."""

    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    up = down = np.empty(0, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * STRIDE)
            cls.up, cls.down = (np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size - 1, b, np.uint64)))) for b in (BASE, cls.inverse))
        return cls.up[:n], cls.down


def mixed(values: np.ndarray) -> np.ndarray:
    """Spreads the entropy of the low bits over all bits."""
    values = (values ^ (values >> np.uint64(32))) * MIX
    values = (values ^ (values >> np.uint64(29))) * MIX
    return values ^ (values >> np.uint64(32))


class Words:
    """The words of several texts, one after another.

    ``hashes``: a 64-bit hash per word. ``starts``, ``ends``: its place in ``flat``, the joined bytes.
    ``upto``: number of words before each text, and in all.
    """

    def __init__(self, texts: list[bytes]):
        flat = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        white = WHITE[flat]
        before = np.empty_like(white)
        before[0], before[1:] = True, white[:-1]
        self.flat, self.white = flat, white
        self.starts, self.ends = np.flatnonzero(before & ~white), np.flatnonzero(white & ~before)
        self.begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))  # of the texts
        self.upto = np.searchsorted(self.starts, self.begins)
        self.hashes = np.empty(len(self.starts), np.uint64)
        done = 0
        while done < len(self.starts):
            # A stretch of whole words of about STRIDE bytes.
            first = self.starts[done]
            last = max(int(np.searchsorted(self.ends, first + STRIDE, side="right")), done + 1)
            self.hashes[done:last] = self.stretch(done, last)
            done = last

    def stretch(self, first: int, last: int) -> np.ndarray:
        """Polynomial hashes from differences of running sums."""
        begin, end = int(self.starts[first]), int(self.ends[last - 1])
        up, down = Powers.of(end - begin)
        sums = np.empty(end - begin + 1, np.uint64)
        sums[0] = 0
        np.cumsum(BYTES[self.flat[begin:end]] * up, out=sums[1:])
        starts, ends = self.starts[first:last] - begin, self.ends[first:last] - begin
        return mixed((sums[ends] - sums[starts]) * down[starts])


def rolled(word_hashes: np.ndarray, previous: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-grams from those of the (n-1)-grams: one multiplication and one addition each."""
    return previous[:-1] * BASE + word_hashes[n - 1:]


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of every text, their occurrences, and offsets per text.

    A text of fewer words is one shingle of all its words; a text without words has none.
    """
    words = Words(texts)
    sizes = np.diff(words.upto)
    grams = by_length = words.hashes
    lengths = {1: by_length}
    for size in range(2, n + 1):
        if len(grams) < 2:
            break
        grams = rolled(words.hashes, grams, size)
        lengths[size] = grams
    parts = np.minimum(sizes, n)
    counts = np.where(sizes > 0, sizes - parts + 1, 0)
    offsets = np.concatenate(([0], np.cumsum(counts)))
    flat = np.empty(offsets[-1], np.uint64)
    whole = sizes >= n
    if whole.any():
        # Windows that lie inside one text, in order.
        keep = np.zeros(len(words.hashes) + 1, np.int64)
        np.add.at(keep, words.upto[:-1][whole], 1)
        np.add.at(keep, words.upto[:-1][whole] + counts[whole], -1)
        inside = np.cumsum(keep[:-1])[: len(lengths[n])] > 0
        target = np.repeat(whole, counts)
        flat[target] = lengths[n][inside]
    for i in np.flatnonzero(~whole & (sizes > 0)):
        flat[offsets[i]] = lengths[int(sizes[i])][words.upto[i]]
    flat = mixed(flat)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        flat[a:b].sort()
    first = np.ones(len(flat), bool)
    first[1:] = flat[1:] != flat[:-1]
    first[offsets[:-1][counts > 0]] = True
    places = np.flatnonzero(first)
    return flat[places], np.diff(np.append(places, len(flat))), np.searchsorted(places, offsets)
