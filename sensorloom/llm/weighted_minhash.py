"""Operator 10, near-duplicate texts by improved consistent weighted sampling.

A text is a weighted set of shingles of five words (lower case): weight = occurrences x inverse
document frequency. The frequency part is ``1 + strength * ln(N / df) / ln(N)``: 1 for a shingle of all N
documents, ``1 + strength`` for one of a single document. Callers may bound it by ``share``: ``1 + strength *
ln(N / df) / ln(1 / share)``, and ``1 + strength`` below that share of all documents. Either way the number
of documents of every shingle is counted exactly: texts are dealt to chunks, a chunk sends its different
shingles to tasks by hash range, which add up the documents and send the sums back to the chunks.

Each text gets 64 consistent weighted samples: sample j of a shingle of weight w falls on the same
(shingle, level) in two texts with a probability equal to their weighted Jaccard similarity. The
random numbers of a shingle come from a table per sample, chosen by its hash; ties inside a table entry
are broken by the hash itself, so equal entries do no harm. Four samples make a band, sixteen bands
the buckets. At a similarity of 0.8 two texts share a bucket with a probability of 0.9998.

Candidates are pairs of a bucket that agree in at least 39 of their 64 samples (at a similarity of 0.8 a
pair falls below that with a probability of 0.0002). Every link is verified by the exact weighted
Jaccard similarity of both texts. First each text of a bucket is compared with one candidate of high
degree. Then, where candidates are in different components, all of them are compared, block by block,
each pair in the first band that it shares; pairs that are linked already are passed over.

Defined cases: equal texts are one class, and null is the empty text; other texts without words have
no shingles and no links; texts of fewer than five words are one shingle; a null id is a document like any other,
the class id is the smallest id that is not null; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sensorloom.llm import words as W
from sensorloom.llm.batches import bound_batches, keep_only, slices
from sensorloom.llm.components import components, joined_components
from sensorloom.llm.groups import Union, whole_groups
from sensorloom.session import materialise, task_count

WORDS = 5
THRESHOLD = 0.8
STRENGTH = 0.25
SHARE = 1 / 64
SAMPLES, ROWS_PER_BAND = 64, 4
BANDS = SAMPLES // ROWS_PER_BAND
ENTRIES = 1 << 14
REST_BITS = 32 - 14
BITMAP_BITS = 1 << 24
CHUNK_BYTES = 8 << 20  # texts whose shingles are counted together
RANGE_BYTES = 8 << 20  # texts for one range of shingle hashes
LEAST_EQUAL = 39  # samples in which candidates agree
SAMPLE_BLOCK = 1024  # texts whose samples meet in a task
STAR_CELL = 128  # texts that meet one candidate in a task
TEXT_BLOCK = 256  # texts of each side that meet in a task


def counted(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Distinct shingle hashes, their occurrences and the offsets of the texts, for bounded slices of texts."""
    for start, end in slices(texts):
        yield W.shingle_sets([t.decode("utf-8").lower().encode("utf-8") for t in texts.slice(start, end - start).to_pylist()], WORDS)


def texts_of(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text, doc = F.coalesce(F.col(f"`{text_column}`"), F.lit("")), F.col(f"`{id_column}`")
    return docs.select(doc.alias("doc"), F.unhex(F.md5(text)).alias("node"), F.encode(text, "UTF-8").alias("text"), F.xxhash64(doc).alias("doc_key"))


# --- document frequencies -------------------------------------------------------------------------

def in_chunks(texts: DataFrame) -> tuple[DataFrame, int, int]:
    """Compressed texts with their ``chunk``, about ``CHUNK_BYTES`` of text each; the numbers of chunks and of hash ranges.

    Texts go through two shuffles; each of them compressed alone takes half of what the shuffle's own blocks take.
    """
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = task_count(texts.sparkSession, size, CHUNK_BYTES)
    ranges = task_count(texts.sparkSession, size, RANGE_BYTES)
    placed = texts.select(F.pmod(F.xxhash64("doc_key", "node"), F.lit(n)).cast("int").alias("chunk"), "doc", "node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pressed = [len(x).to_bytes(8, "little") + pa.compress(x, "zstd", asbytes=True) for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(pressed, pa.binary())], batch.schema.names)

    return placed.mapInArrow(run, placed.schema), n, ranges


def plain_texts(pressed: pa.ChunkedArray) -> pa.Array:
    return pa.array([pa.decompress(x[8:], int.from_bytes(x[:8], "little"), "zstd", asbytes=True) for x in pressed.to_pylist()], pa.binary())


def packed(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest one needs."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0)))).tobytes()


def unpacked(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, f"u{len(blob) // n}").astype(np.int64) if n else np.empty(0, np.int64)


def planes(hashes: np.ndarray) -> bytes:
    """Sorted hashes as differences, byte by byte, so that the upper bytes compress."""
    steps = np.diff(hashes, prepend=np.uint64(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(blob: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(steps, dtype=np.uint64)


def chunk_shingles(chunked: DataFrame, n: int, ranges: int) -> DataFrame:
    """(part, chunk, hashes, counts): the different shingles of every chunk by hash range, with their documents in the chunk.

    A shingle of many documents is one entry per chunk, so no range gets more of it than there are chunks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["chunk"]):
            texts, chunks = table.column("text"), table.column("chunk").to_pylist()
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(table)]):
                sets = [shingles for shingles, _, _ in counted(plain_texts(texts.slice(start, end - start)))]
                hashes, docs = np.unique(np.concatenate(sets), return_counts=True)
                parts = (hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
                cuts = np.flatnonzero(np.diff(parts, prepend=np.uint64(ranges)))
                rows = [(int(parts[x]), chunks[start], planes(hashes[x:y]), packed(docs[x:y]))
                        for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(hashes)])]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), pa.int32(), pa.binary(), pa.binary()])],
                        ["part", "chunk", "hashes", "counts"])

    placed = chunked.select("chunk", "text").repartitionById(n, "chunk")
    return placed.sortWithinPartitions("chunk").mapInArrow(run, "part int, chunk int, hashes binary, counts binary")


def summed(blobs: DataFrame, ranges: int, answer, schema: str) -> DataFrame:
    """Adds up the documents of the shingles of each hash range, and gives ``answer(blobs, hashes, documents, place)`` for it.

    ``place`` is where the shingles of all blobs, one blob after another, stand among the different ones of the range.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["part"]):
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(table)]):
                group = table.slice(start, end - start)
                held = [from_planes(x) for x in group.column("hashes").to_pylist()]
                hashes, place = np.unique(np.concatenate(held), return_inverse=True)
                docs = np.concatenate([unpacked(x, len(h)) for x, h in zip(group.column("counts").to_pylist(), held)])
                yield answer(group, hashes, np.bincount(place, docs).astype(np.int64), place, [len(h) for h in held])

    return blobs.repartitionById(ranges, "part").sortWithinPartitions("part").mapInArrow(run, schema)


def chunk_frequencies(chunked: DataFrame, n: int, ranges: int) -> DataFrame:
    """(chunk, part, dfs): the documents of every shingle of a chunk, in the order of ``chunk_shingles``."""

    def answer(group, hashes, docs, place, sizes):
        dfs = [packed(x) for x in np.split(docs[place], np.cumsum(sizes)[:-1])]
        return pa.RecordBatch.from_arrays(
            [group.column("chunk").combine_chunks(), group.column("part").combine_chunks(), pa.array(dfs, pa.binary()), pa.array(sizes, pa.int32())],
            ["chunk", "part", "dfs", "n"])

    return summed(chunk_shingles(chunked, n, ranges), ranges, answer, "chunk int, part int, dfs binary, n int")


def document_frequencies(texts: DataFrame) -> tuple[int, dict[int, int]]:
    """(documents, frequency of every shingle in at least ``SHARE`` of them).

    All shingles are counted; only the frequent ones, at most (shingles per document) / SHARE, reach the driver.
    """
    total = texts.count()
    least = max(SHARE * total, 2)

    def answer(group, hashes, docs, place, sizes):
        often = docs >= least
        return pa.RecordBatch.from_arrays([pa.array(hashes[often].view(np.int64)), pa.array(docs[often])], ["h", "n"])

    chunked, n, ranges = in_chunks(texts)
    frequent = summed(chunk_shingles(chunked, n, ranges), ranges, answer, "h long, n long").toArrow()
    return total, dict(zip(frequent.column("h").to_pylist(), frequent.column("n").to_pylist()))


class Weights:
    """Weights of shingles by their numbers of documents; ``share`` bounds the frequency part, None leaves every one its own."""

    def __init__(self, total: int, strength: float, share: float | None = None):
        self.total, self.strength, self.most = max(total, 2), strength, 1 + strength
        self.least = max((share or 0) * total, 2)
        self.scale = math.log(1 / share if share else self.total)

    def of(self, dfs: np.ndarray, counts: np.ndarray) -> np.ndarray:
        weights = np.full(len(dfs), self.most)
        hit = np.flatnonzero(dfs >= self.least)
        weights[hit] = 1 + self.strength * np.clip(np.log(self.total / dfs[hit]) / self.scale, 0, 1)
        return weights * counts


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of (sorted shingles, weights)."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    least = float(np.minimum(a[1][i], b[1][j]).sum())
    return least / (float(a[1].sum()) + float(b[1].sum()) - least)


# --- samples --------------------------------------------------------------------------------------

@lru_cache(maxsize=4)
def tables(common_weight: float, seed: int):
    """Random numbers per (sample, entry), and what they give for the most common weight.

    r and c are gamma(2, 1), beta uniform. For weight w: t = floor(ln w / r + beta) and
    ln a = ln c - r (t - beta) - r; the shingle with the smallest a is the sample.
    """
    rng = np.random.default_rng(seed)
    shape = (SAMPLES, ENTRIES)
    r = rng.gamma(2.0, 1.0, shape).astype(np.float32)
    ln_c = np.log(rng.gamma(2.0, 1.0, shape)).astype(np.float32)
    beta = rng.random(shape, dtype=np.float32)
    odd = rng.integers(0, 1 << 31, SAMPLES, np.uint32) * np.uint32(2) + np.uint32(1)
    t, ln_a = level(r, ln_c, beta, np.float32(np.log(common_weight)))
    # Entries by rank, so that (rank, rest of the hash) is one integer to take the minimum of.
    by_rank = np.argsort(ln_a, axis=1, kind="stable").astype(np.uint32)
    rank = np.argsort(by_rank, axis=1, kind="stable").astype(np.uint32) << np.uint32(REST_BITS)
    return r, ln_c, beta, odd, t.astype(np.int64), in_order(ln_a), by_rank, rank


def level(r, ln_c, beta, ln_w):
    t = np.floor(ln_w / r + beta)
    return t, ln_c - r * (t - beta) - r


def in_order(values: np.ndarray) -> np.ndarray:
    """32-bit integers in the order of the floats, shifted to the upper half of 64 bits."""
    bits = np.ascontiguousarray(values, np.float32).view(np.uint32)
    return (bits ^ np.where(bits >> np.uint32(31), np.uint32(0xFFFFFFFF), np.uint32(0x80000000))).astype(np.uint64) << np.uint64(32)


def samples(shingles: np.ndarray, weights: np.ndarray, offsets: np.ndarray, common_weight: float, seed: int) -> np.ndarray:
    """(texts x SAMPLES) 16-bit values; equal samples have equal values. Texts without shingles mean nothing."""
    r, ln_c, beta, odd, common_t, common_a, by_rank, rank = tables(common_weight, seed)
    n = len(offsets) - 1
    best = np.full((SAMPLES, n), ~np.uint64(0))
    level_of = np.zeros((SAMPLES, n), np.int64)
    low = np.uint32((1 << REST_BITS) - 1)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    usual = weights == common_weight
    for part, plain in ((usual, True), (~usual, False)):
        upto = np.concatenate(([0], np.cumsum(part)))[offsets]
        rows = np.flatnonzero(np.diff(upto))
        if not len(rows):
            continue
        values, at = short[part], upto[rows]
        ln_w = None if plain else np.log(weights[part]).astype(np.float32)
        for j in range(SAMPLES):
            v = values * odd[j]
            entry = v >> np.uint32(REST_BITS)
            if plain:
                key = rank[j][entry]
                v &= low
                key |= v
                least = np.minimum.reduceat(key, at)
                entry = by_rank[j][least >> np.uint32(REST_BITS)]
                found = common_a[j][entry] | ((entry << np.uint32(REST_BITS)) | (least & low))
                t = common_t[j][entry]
            else:
                t, a = level(r[j][entry], ln_c[j][entry], beta[j][entry], ln_w)
                key = in_order(a) | v
                found = np.minimum.reduceat(key, at)
                hit = np.flatnonzero(key == np.repeat(found, np.diff(np.append(at, len(key)))))
                t = t[hit[np.searchsorted(hit, at)]].astype(np.int64)
            better = found < best[j, rows]
            best[j, rows] = np.where(better, found, best[j, rows])
            level_of[j, rows] = np.where(better, t, level_of[j, rows])
    return (W.mixed((best & np.uint64(0xFFFFFFFF)) + level_of.view(np.uint64) * W.BASE) >> np.uint64(48)).T.astype(np.uint16)


def signatures(texts: DataFrame, weights: Weights, seed: int) -> DataFrame:
    """doc, node, samples (64 x 16 bits), bands and dfs (documents of each shingle) per row; null for a text without words.

    The frequencies come back to the texts of a chunk: its different shingles in order are those of its ranges in order.
    """
    chunked, n, ranges = in_chunks(texts)
    doc_type = texts.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("samples", tables.cache_clear)
        for table, starts in whole_groups(batches, ["chunk"]):
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(table)]):
                group = table.slice(start, end - start).combine_chunks()
                known = len(group) - group.column("part").null_count
                answers = zip(*(group.column(c).slice(0, known).to_pylist() for c in ("dfs", "n")))
                dfs = np.concatenate([np.empty(0, np.int64), *(unpacked(*x) for x in answers)])
                rows = group.slice(known).combine_chunks()
                if len(rows):
                    yield from marked(rows, dfs)

    def marked(rows: pa.Table, dfs: np.ndarray) -> Iterator[pa.RecordBatch]:
        parts = list(counted(plain_texts(rows.column("text"))))
        place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)[1]
        done = at = 0
        for shingles, counts, offsets in parts:
            own = dfs[place[done:done + len(shingles)]]
            done += len(shingles)
            values = np.ascontiguousarray(samples(shingles, weights.of(own, counts), offsets, weights.most, seed))
            some = (np.diff(offsets) > 0).tolist()
            here = rows.slice(at, len(some))
            at += len(some)
            yield pa.RecordBatch.from_arrays(
                [here.column("doc").combine_chunks(), here.column("node").combine_chunks(),
                 pa.array([row.tobytes() if x else None for row, x in zip(values, some)], pa.binary()),
                 pa.array([row.view(np.int64) if x else None for row, x in zip(values, some)], pa.list_(pa.int64())),  # four samples are a band
                 pa.array([packed(own[x:y]) if y > x else None for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.binary())],
                ["doc", "node", "samples", "bands", "dfs"])

    rows = chunked.unionByName(chunk_frequencies(chunked, n, ranges), allowMissingColumns=True)
    placed = rows.repartitionById(n, "chunk").sortWithinPartitions("chunk", F.col("part").asc_nulls_last())
    return placed.mapInArrow(run, f"doc {doc_type}, node binary, samples binary, bands array<long>, dfs binary")


# --- candidates -----------------------------------------------------------------------------------

def equal_samples(values: np.ndarray) -> np.ndarray:
    """Number of equal samples for every two rows."""
    n = len(values)
    if n <= 64:
        return (values[:, None, :] == values[None, :, :]).sum(2)
    out = np.zeros((n, n), np.uint8)
    for column in values.T:
        out += column[:, None] == column[None, :]
    return out


def candidates(values: np.ndarray, left: int, inner: bool) -> np.ndarray:
    """Matrix of candidate pairs; without ``inner`` only between the first ``left`` rows and the others."""
    near = equal_samples(values) >= LEAST_EQUAL
    np.fill_diagonal(near, False)
    if not inner:
        near[:left, :left] = False
        near[left:, left:] = False
    return near


def cover(near: np.ndarray) -> list[tuple[int, int]]:
    """(row, centre) pairs that touch every row with a candidate; centres have many candidates."""
    pairs, open_rows = [], near.any(1)
    degree = near.sum(1)
    while open_rows.any():
        centre = int(np.argmax(np.where(open_rows, degree, 0)))
        around = near[centre] & open_rows
        if not around.any():  # all of its candidates are taken: it joins the strongest of them
            around = np.zeros(len(near), bool)
            pairs.append((centre, int(np.argmax(np.where(near[centre], degree, 0)))))
        pairs += [(int(k), centre) for k in np.flatnonzero(around)]
        open_rows &= ~around
        open_rows[centre] = False
    return pairs


def first_shared(values: np.ndarray, x: np.ndarray, y: np.ndarray, band: int) -> np.ndarray:
    """True for pairs that share no band before this one."""
    if not band or not len(x):
        return np.ones(len(x), bool)
    bands = values.view(np.int64)[:, :band]
    out = np.empty(len(x), bool)
    for at in range(0, len(x), 1 << 18):
        part = slice(at, at + (1 << 18))
        out[part] = ~(bands[x[part]] == bands[y[part]]).any(1)
    return out


def sample_cells(placed: DataFrame, stars: bool) -> DataFrame:
    """Reads cells of (a, b, cell, side, inner, node, grp, samples).

    With ``stars``: (node, centre) pairs that cover all candidates. Without: the rows (a, b, node, grp)
    that have a candidate in another component in this band first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["a", "b", "cell"]):
            sides, inner = table.column("side").to_numpy(), table.column("inner").to_numpy(zero_copy_only=False)
            nodes, groups = table.column("node").to_pylist(), table.column("grp").to_pylist()
            bucket, band, packed = table.column("a").to_numpy(), table.column("b").to_numpy(), table.column("samples").to_pylist()
            rows: list[tuple] = []
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(table)]):
                left = int((sides[start:end] == 0).sum())
                if end - start < 2 or not inner[start] and not 0 < left < end - start:
                    continue
                values = np.frombuffer(b"".join(packed[start:end]), np.uint16).reshape(end - start, SAMPLES)
                near = candidates(values, left, bool(inner[start]))
                if not near.any():
                    continue
                if stars:
                    rows += {(nodes[start + x], nodes[start + y]) for x, y in cover(near)}
                    continue
                names = np.unique(np.array(groups[start:end], object), return_inverse=True)[1]
                x, y = np.nonzero(near & (names[:, None] != names[None, :]))
                x, y = x[x < y], y[x < y]
                new = first_shared(values, x, y, int(band[start]))
                rows += [(int(bucket[start]), int(band[start]), nodes[start + k], groups[start + k]) for k in np.union1d(x[new], y[new]).tolist()]
            if rows:
                kinds = [pa.binary(), pa.binary()] if stars else [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                names = ["node", "centre"] if stars else ["a", "b", "node", "grp"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    ordered = placed.select("a", "b", "cell", "side", "inner", "node", "grp", "samples")
    return ordered.repartition("a", "b", "cell").sortWithinPartitions("a", "b", "cell", "side").mapInArrow(
        run, "node binary, centre binary" if stars else "a long, b int, node binary, grp binary")


def in_cells(rows: DataFrame, blocks: str, block: str) -> DataFrame:
    """Cells of every two blocks of a bucket (a, b): adds cell, side (1: the later block) and inner (one block with itself)."""
    return (
        rows.withColumn("blocks", F.expr(blocks)).withColumn("block", F.expr(block).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .withColumn("cell", F.least("block", "other") * F.col("blocks") + F.greatest("block", "other"))
        .withColumn("side", F.expr("IF(block > other, 1, 0)")).withColumn("inner", F.expr("block = other"))
        .drop("block", "other", "blocks")
    )


# --- verification ---------------------------------------------------------------------------------

def verified(cells: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """(u, v) links found in cells of (a, b, cell, side, inner, node, grp, samples, dfs, text).

    Rows of side 0 are compared with those of side 1, all rows with each other if ``inner`` is set.
    Pairs of one ``grp`` are linked already; pairs are candidates by their samples.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["a", "b", "cell"]):
            sides, inner = table.column("side").to_numpy(), table.column("inner").to_numpy(zero_copy_only=False)
            nodes, groups = table.column("node").to_pylist(), table.column("grp").to_pylist()
            texts, packed = table.column("text").combine_chunks(), table.column("samples").to_pylist()
            dfs = table.column("dfs").combine_chunks()
            found: list[tuple[bytes, bytes]] = []
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(table)]):
                left = int((sides[start:end] == 0).sum())
                n = end - start
                if n < 2 or not inner[start] and not 0 < left < n:
                    continue
                union = Union(n)
                first: dict = {}
                for k in range(n):
                    g = groups[start + k]
                    if g is not None and first.setdefault(g, k) != k:
                        union.join(first[g], k)
                sets: list = [None] * n

                def of(k: int):
                    if sets[k] is None:
                        shingles, counts, _ = next(counted(texts.slice(start + k, 1)))
                        held = weights.of(unpacked(dfs[start + k].as_py(), len(shingles)), counts)
                        sets[k] = (shingles, held, float(held.sum()))
                    return sets[k]

                values = np.frombuffer(b"".join(packed[start:end]), np.uint16).reshape(n, SAMPLES)
                for x, y in zip(*(k.tolist() for k in np.nonzero(np.triu(candidates(values, left, bool(inner[start])))))):
                    if union.find(x) == union.find(y):
                        continue
                    a, b = of(x), of(y)
                    # The smaller sum bounds the similarity.
                    if min(a[2], b[2]) >= threshold * max(a[2], b[2]) * (1 - 1e-12) and similarity(a[:2], b[:2]) >= threshold:
                        union.join(x, y)
                        found.append((nodes[start + x], nodes[start + y]))
            if found:
                u, v = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["u", "v"])

    ordered = cells.select("a", "b", "cell", "side", "inner", "node", "grp", "samples", "dfs", "text")
    return ordered.repartition("a", "b", "cell").sortWithinPartitions("a", "b", "cell", "side").mapInArrow(run, "u binary, v binary")


def bodies_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, samples, dfs, text of the wanted nodes, one row each.

    A bitmap of fixed size lets most other texts pass by before the join shuffles them.
    """
    bits = f"pmod(xxhash64(node), {BITMAP_BITS}L)"
    shared = texts.sparkSession.sparkContext.broadcast(bitmap_of(wanted.select(F.expr(bits).alias("bit"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in batches:
            bit = batch.column(3).to_numpy()
            found = pa.array((bitmap[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) > 0)
            yield batch.select([0, 1, 2]).filter(found)

    likely = texts.select("node", "doc_key", "text", F.expr(bits).alias("bit")).mapInArrow(run, "node binary, doc_key long, text binary")
    return materialise(likely.join(wanted, ["node", "doc_key"]).dropDuplicates(["node", "doc_key"]).select("node", "samples", "dfs", "text"))


def bitmap_of(bits: DataFrame) -> np.ndarray:
    """Words of 64 bits in which the given bits (below ``BITMAP_BITS``) are set; its size is fixed."""
    words = bits.groupBy(F.expr("bit DIV 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(bit % 64 AS INT)))").alias("mask")).toArrow()
    bitmap = np.zeros(BITMAP_BITS // 64, np.int64)
    bitmap[words.column("word").to_numpy()] = words.column("mask").to_numpy()
    return bitmap.view(np.uint64)


def near_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD,
               strength: float = STRENGTH, seed: int = 5, share: float | None = SHARE) -> DataFrame:
    """doc id, node (MD5 of the text), class_id, kept per row: one row of each class is kept.

    The kept row is the one with the smallest id; of several such rows (repeated rows) the node with
    the smallest hash, and ``near_duplicates_removed`` keeps one row of it. With ``share`` None every shingle
    weighs by its own number of documents; a number bounds the frequency part as said above.
    """
    if threshold < THRESHOLD:
        raise ValueError(f"bands and samples are made for a similarity of {THRESHOLD} or more")
    spark = docs.sparkSession
    bound_batches(spark)
    texts = texts_of(docs, id_column, text_column)
    weights = Weights(texts.count(), strength, share)
    marks = materialise(signatures(texts, weights, seed))
    # One node for each different text, with its smallest id.
    nodes = materialise(marks.groupBy("node").agg(F.min("doc").alias("doc"), F.min("samples").alias("samples"), F.min("bands").alias("bands"),
        F.min("dfs").alias("dfs")))
    entries = nodes.filter("bands IS NOT NULL").select("node", F.posexplode("bands").alias("b", "a"))
    company = materialise(
        entries.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        .select("a", "b", F.ceil(F.col("n") / SAMPLE_BLOCK).cast("int").alias("n_blocks")))
    members = materialise(in_cells(entries.join(company, ["a", "b"]), "n_blocks", "pmod(xxhash64(node), n_blocks)").drop("n_blocks"))
    held = nodes.select("node", "samples")
    # A candidate of high degree for each text.
    star = materialise(sample_cells(members.join(held, "node").withColumn("grp", F.lit(None).cast("binary")), stars=True).distinct())
    both = star.select("node").union(star.select(F.col("centre").alias("node"))).distinct()
    bodies = bodies_of(texts, materialise(both.join(nodes.select("node", "samples", "dfs", F.xxhash64("doc").alias("doc_key")), "node")))
    spread = materialise(star.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / STAR_CELL).cast("int").alias("cells")))
    around = star.join(spread, "centre").withColumn("cell", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int"))
    middle = spread.select("centre", F.col("centre").alias("node"), F.explode(F.expr("sequence(0, cells - 1)")).alias("cell"))
    placed = middle.select("centre", "node", "cell", F.lit(0).alias("side")).unionByName(around.select("centre", "node", "cell", F.lit(1).alias("side")))
    cells = placed.join(bodies, "node").withColumnRenamed("centre", "a").withColumns(
        {"b": F.lit(0), "inner": F.lit(False), "grp": F.lit(None).cast("binary")})
    links = materialise(verified(cells, weights, threshold))
    groups = materialise(components(links))
    # Candidates that are still in different components.
    apart = materialise(sample_cells(
        members.join(held, "node").join(groups, "node", "left").withColumn("grp", F.coalesce("component", "node")), stars=False).distinct())
    sizes = apart.groupBy("a", "b", "grp").agg(F.count(F.lit(1)).alias("n"))
    blocks = materialise(
        sizes.groupBy("a", "b").agg(F.max(F.struct("n", "grp")).alias("large"), F.sum("n").alias("n"))
        .select("a", "b", F.col("large.grp").alias("large"), F.expr(f"CAST(ceil(large.n / {TEXT_BLOCK}) AS INT)").alias("large_blocks"),
                F.expr(f"CAST(ceil((n - large.n) / {TEXT_BLOCK}) AS INT)").alias("small_blocks")))
    # Texts of the largest component stand in blocks of their own: among them no pair is open.
    placed = in_cells(
        apart.join(blocks, ["a", "b"]), "large_blocks + small_blocks",
        "IF(grp = large, pmod(xxhash64(node), large_blocks), large_blocks + pmod(xxhash64(node), small_blocks))")
    open_cells = materialise(
        placed.groupBy("a", "b", "cell").agg(F.min("grp").alias("low"), F.max("grp").alias("high")).filter("low <> high").select("a", "b", "cell"))
    more = materialise(verified(placed.join(open_cells, ["a", "b", "cell"]).join(bodies, "node"), weights, threshold))
    groups = joined_components(groups, more)
    classes = nodes.join(groups, "node", "left").select("node", "doc", F.coalesce("component", "node").alias("component"))
    heads = materialise(classes.groupBy("component").agg(
        F.min(F.struct(F.col("doc").isNull().alias("no_id"), F.col("doc"), F.col("node"))).alias("head")))
    named = materialise(
        classes.join(heads, "component")
        .select("node", F.col("head.doc").alias("class_id"), (F.col("node") == F.col("head.node")).alias("head")))
    return marks.select("doc", "node").join(named, "node").select(
        F.col("doc").alias(id_column), "node", "class_id", (F.col("head") & F.col("doc").eqNullSafe(F.col("class_id"))).alias("kept"))


def near_duplicates_removed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with one row for each class."""
    found = near_texts(docs, id_column, text_column, **options).filter("kept").select(F.col(f"`{id_column}`").alias("_doc"), "node").distinct()
    rows = docs.withColumn("_node", F.unhex(F.md5(F.coalesce(F.col(f"`{text_column}`"), F.lit("")))))
    kept = rows.join(found, (F.col("_node") == F.col("node")) & F.col(f"`{id_column}`").eqNullSafe(F.col("_doc")), "left_semi")
    # Rows that agree in id and text are repetitions.
    return kept.dropDuplicates([id_column, "_node"]).drop("_node")
