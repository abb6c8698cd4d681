"""Operator 1, near-duplicate embeddings by spherical-cap filters.

A filter is a direction; a unit vector belongs to every filter to which it is closer than a limit, and
to its nearest few in any case. The directions have structure: after a random rotation the space is
cut into two blocks, each block has its own random code, and a filter is a pair of code words. A
vector's filters are then listed from the sorted scores of both blocks without visiting all pairs.
Several independent codes make it practically certain that two close vectors share a filter.

Vectors meet in their common filters, inside their label. A pair that shares several filters is
counted only in the first one, so no list of pairs is shuffled: each filter gives out numbers of
links per vector and a spanning set of links for the components. Large filters are cut into blocks,
and every two blocks meet in a task. Equal vectors are one node with a count.

Recall: pairs at exactly the limit of 0.98 share a filter with a probability above 0.9999 (measured:
no miss in 20,000 random pairs); closer pairs do so more surely. Every link is verified.

Defined cases: null ids, labels or vectors, zero vectors and vectors with null or non-finite
components have no links; they are their own component. Vectors of different length never link.
Repeated rows are other vectors with cosine 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from sensorloom.llm.batches import bound_batches
from sensorloom.llm.components import components
from sensorloom.llm.groups import Union, whole_groups
from sensorloom.session import materialise

THRESHOLD = 0.98
CODES = 5
MEAN_FILTERS = 5  # of each code, on average
LEAST_FILTERS = 5  # of each code, nearest ones if the limit gives fewer
FILTERS_PER_VECTOR = 8  # directions of a code for each vector of the largest label
SMALLEST_CODE, LARGEST_CODE = 32, 4096
BLOCK = 512
TOP_WORDS = 96  # of a block, listed at first
SUMS = 1 << 21  # sums of word scores held at once
SLACK = 1e-9  # for rounding, where sums are bounded by parts


@lru_cache(maxsize=64)
def code(dims: int, words: int, number: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotation and the unit code words of both blocks."""
    rng = np.random.default_rng([seed, number, dims, words])
    rotation, _ = np.linalg.qr(rng.normal(size=(dims, dims)))
    parts = [rng.normal(size=(words, width)) for width in (dims - dims // 2, dims // 2)]
    first, second = (p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-300) for p in parts)
    return rotation, first, second


def strongest(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest scores of every row in descending order, with their places."""
    if k < scores.shape[1]:
        places = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        order = np.argsort(-np.take_along_axis(scores, places, 1), axis=1)
        places = np.take_along_axis(places, order, 1)
    else:
        places = np.argsort(-scores, axis=1)
    return np.take_along_axis(scores, places, 1), places


def decode(unit: np.ndarray, words: int, number: int, seed: int, top: int = TOP_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) pairs of one code, rows ascending: all filters beyond the limit, the nearest ``LEAST_FILTERS`` at least.

    The best ``top`` words of each block are listed; rows for which they do not suffice are listed again from all words.
    """
    n, dims = unit.shape
    rotation, first, second = code(dims, words, number, seed)
    turned = unit @ rotation
    half = dims - dims // 2
    limit = NormalDist().inv_cdf(1 - min(0.5, MEAN_FILTERS / words**2)) / np.sqrt(dims) * np.sqrt(2)
    a, order_a = strongest(turned[:, :half] @ first.T, top)
    b, order_b = strongest(turned[:, half:] @ second.T, top)
    least = min(LEAST_FILTERS, a.shape[1])
    sums = (a[:, :least, None] + b[:, None, :least]).reshape(n, -1)  # the nearest few lie among these
    reach = np.minimum(limit, np.partition(sums, -LEAST_FILTERS, axis=1)[:, -LEAST_FILTERS])[:, None]
    in_a, in_b = (a >= reach - b[:, :1] - SLACK).sum(1), (b >= reach - a[:, :1] - SLACK).sum(1)
    open_rows = np.flatnonzero(np.maximum(in_a, in_b) >= a.shape[1]) if a.shape[1] < words else np.empty(0, np.int64)
    rows, filters = [], []
    done = np.setdiff1d(np.arange(n), open_rows)
    at = 0
    while at < len(done):
        # As many rows at once as keep the table of sums small.
        step = 1024
        while step > 1 and step * in_a[done[at:at + step]].max() * in_b[done[at:at + step]].max() > SUMS:
            step //= 2
        part = done[at:at + step]
        wide, deep = in_a[part].max(), in_b[part].max()
        i, x, y = np.nonzero(a[part, :wide, None] + b[part, None, :deep] >= reach[part, :, None])
        i = part[i]
        rows.append(i)
        filters.append(number * words * words + order_a[i, x].astype(np.int64) * words + order_b[i, y])
        at += step
    if len(open_rows):
        i, found = decode(unit[open_rows], words, number, seed, words)
        rows.append(open_rows[i])
        filters.append(found)
    rows, filters = np.concatenate(rows), np.concatenate(filters)
    order = np.argsort(rows, kind="stable")
    return rows[order], filters[order]


def unit_vectors(column: pa.Array, usable: np.ndarray) -> dict[int, np.ndarray]:
    """Row -> unit vector, for the usable rows whose vectors have finite components and are not zero.

    Sums run along a row in one fixed order, so equal vectors have equal units in every batch.
    """
    out: dict[int, np.ndarray] = {}
    lengths = np.diff(column.offsets.to_numpy())
    holes = column.values.is_null().to_numpy(zero_copy_only=False)
    values = column.values.fill_null(np.nan).to_numpy(zero_copy_only=False) if holes.any() else column.values.to_numpy()
    starts = column.offsets.to_numpy()[:-1]
    for length in np.unique(lengths[usable]):
        rows = usable[lengths[usable] == length]
        if not length:
            continue
        block = values[starts[rows, None] + np.arange(length)]
        largest = np.abs(block).max(axis=1)
        good = np.isfinite(block).all(axis=1) & (largest > 0)
        block = block[good] / largest[good, None]
        block /= np.sqrt((block * block).sum(axis=1))[:, None]
        out.update(zip(rows[good].tolist(), block))
    return out


def valid_vectors(df: DataFrame, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """id, label, h (128-bit hash of label and vector), unit (doubles as bytes; null if the row can have no links)."""
    source = df.select(
        F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{label_column}`").cast("string").alias("label"),
        F.col(f"`{vector_column}`").cast("array<double>").alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, vectors = batch.column(0), batch.column(1), batch.column(2)
            known = [c.is_valid().to_numpy(zero_copy_only=False) for c in (ids, labels, vectors)]
            names = labels.to_pylist()
            hashes: list = [None] * len(ids)
            units: list = [None] * len(ids)
            for i, unit in unit_vectors(vectors, np.flatnonzero(known[0] & known[1] & known[2])).items():
                units[i] = unit.tobytes()
                hashes[i] = xxhash.xxh3_128_digest(names[i].encode() + b"\0" + units[i])
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array(hashes, pa.binary()), pa.array(units, pa.binary())], ["id", "label", "h", "unit"])

    return source.mapInArrow(run, "id long, label string, h binary, unit binary")


def with_filters(nodes: DataFrame, words: int, seed: int) -> DataFrame:
    """id, h, label, copies, unit, filters (sorted) per node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = batch.column(batch.schema.get_field_index("unit")).to_pylist()
            sizes = np.array([len(u) // 8 for u in units])
            at, filters = [], []
            for dims in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dims)
                block = np.frombuffer(b"".join(units[i] for i in rows.tolist())).reshape(len(rows), dims)
                if dims < 2:  # one component: the sign is the direction
                    at.append(rows)
                    filters.append((block[:, 0] > 0).astype(np.int64))
                    continue
                for c in range(CODES):
                    i, found = decode(block, words, c, seed)
                    at.append(rows[i])
                    filters.append(found + dims * CODES * LARGEST_CODE**2)  # vectors of another length have other filters
            rows, flat = np.concatenate(at), np.concatenate(filters)
            order = np.lexsort((flat, rows))
            offsets = np.searchsorted(rows[order], np.arange(len(units) + 1))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat[order]))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "filters"])

    return nodes.mapInArrow(run, "id long, h binary, label string, copies long, unit binary, filters array<long>")


def linked(units: np.ndarray, other: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of pairs with a cosine of at least the threshold; pairs inside ``units`` without ``other``."""
    if other is None:
        i, j = np.nonzero(units @ units.T >= threshold)
        return i[i < j], j[i < j]
    return np.nonzero(units @ other.T >= threshold)


def first_common(lists: list[np.ndarray], i: np.ndarray, j: np.ndarray, now: int) -> np.ndarray:
    """True for pairs whose smallest common filter is ``now``."""
    lower = [x[: np.searchsorted(x, now)] for x in lists]
    flat = np.concatenate(lower) if lower else np.empty(0, np.int64)
    if not len(flat):
        return np.ones(len(i), bool)
    names, place = np.unique(flat, return_inverse=True)
    member = np.zeros((len(lists), len(names)), np.float32)
    member[np.repeat(np.arange(len(lists)), [len(x) for x in lower]), place] = 1
    out = np.empty(len(i), bool)
    for at in range(0, len(i), 65_536):
        part = slice(at, at + 65_536)
        out[part] = np.einsum("ij,ij->i", member[i[part]], member[j[part]]) == 0
    return out


def links_in_cells(cells: DataFrame, threshold: float) -> DataFrame:
    """kind 0: n links of (id, h). kind 1: a link between (id, h) and (id2, h2) of a spanning set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["label", "filter", "cell"]):
            ids, hashes = table.column("id").to_numpy(), table.column("h").to_pylist()
            copies, sides = table.column("copies").to_numpy(), table.column("side").to_numpy()
            one_block = table.column("one_block").to_numpy()
            filters, units = table.column("filter").to_numpy(), table.column("unit").to_pylist()
            lists = table.column("filters")
            rows: list[tuple] = []
            for start, end in zip(starts, [*starts[1:], len(table)]):
                if end - start < 2:
                    continue
                size = len(units[start])
                block = np.frombuffer(b"".join(units[start:end])).reshape(end - start, size // 8)
                left = int((sides[start:end] == 0).sum())
                if one_block[start]:
                    i, j = linked(block, None, threshold)
                elif not 0 < left < end - start:
                    continue
                else:
                    i, j = linked(block[:left], block[left:], threshold)
                    j = j + left
                if not len(i):
                    continue
                near = [lists[int(k)].values.to_numpy() for k in range(start, end)]
                new = first_common(near, i, j, int(filters[start]))
                i, j = i[new], j[new]
                if not len(i):
                    continue
                n = end - start
                number = np.bincount(i, copies[start + j], n) + np.bincount(j, copies[start + i], n)
                groups = Union(n)
                for k in np.flatnonzero(number):
                    rows.append((0, int(ids[start + k]), hashes[start + k], int(number[k]), None, None))
                for x, y in zip(i.tolist(), j.tolist()):
                    if groups.join(x, y):
                        rows.append((1, int(ids[start + x]), hashes[start + x], 0, int(ids[start + y]), hashes[start + y]))
            if rows:
                columns = list(zip(*rows))
                kinds = [pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["kind", "id", "h", "n", "id2", "h2"])

    return cells.mapInArrow(run, "kind int, id long, h binary, n long, id2 long, h2 binary")


def near_embeddings(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
                    threshold: float = THRESHOLD, seed: int = 11) -> DataFrame:
    """id, n_links, component_id, kept per row; rows link inside a label with a cosine of at least the threshold.

    The codes are made for a threshold of 0.98 or more; below it pairs would be missed, so a lower one raises an error.
    """
    if threshold < THRESHOLD:
        raise ValueError(f"the filters are made for a cosine of {THRESHOLD} or more")
    bound_batches(df.sparkSession)
    rows = materialise(valid_vectors(df, id_column, vector_column, label_column))
    nodes = materialise(
        rows.filter("unit IS NOT NULL").groupBy("label", "h")
        .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("unit").alias("unit"))
        .select("id", "h", "label", "copies", "unit"))
    largest = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    words = SMALLEST_CODE
    while words < LARGEST_CODE and words**2 < FILTERS_PER_VECTOR * largest:
        words *= 2
    listed = materialise(with_filters(nodes, words, seed))
    # Ids only, to find the filters with company; vectors are attached to those alone.
    entries = listed.select("id", "h", "label", F.explode("filters").alias("filter"))
    company = materialise(
        entries.groupBy("label", "filter").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
        .withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int")))
    placed = (
        entries.join(company, ["label", "filter"])
        .withColumn("block", F.pmod(F.xxhash64("id", "h"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        # Cell of two blocks; side 1 is the block with the larger number.
        .withColumn("cell", F.least("block", "other") * F.col("blocks") + F.greatest("block", "other"))
        .withColumn("side", F.expr("IF(block > other, 1, 0)"))
        .withColumn("one_block", F.expr("block = other"))
        .select("id", "h", "label", "filter", "cell", "side", "one_block")
    )
    cells = (
        placed.join(listed.select("id", "h", "label", "copies", "unit", "filters"), ["id", "h", "label"])
        .repartition("label", "filter", "cell").sortWithinPartitions("label", "filter", "cell", "side")
    )
    found = materialise(links_in_cells(cells, threshold))
    # Copies of a vector link with each other, too.
    number = found.filter("kind = 0").groupBy("id", "h").agg(F.sum("n").alias("n"))
    node = lambda a, b: F.struct(F.col(a).alias("id"), F.col(b).alias("h"))
    groups = components(found.filter("kind = 1").select(node("id", "h").alias("u"), node("id2", "h2").alias("v")))
    groups = groups.select(F.col("node.id").alias("id"), F.col("node.h").alias("h"), F.col("component.id").alias("component_id"))
    result = materialise(
        nodes.select("id", "h", "label", "copies").join(number, ["id", "h"], "left").join(groups, ["id", "h"], "left")
        .select("label", "h", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("_links"), F.coalesce("component_id", "id").alias("_component")))
    return (
        rows.select("id", "label", "h").join(result, ["label", "h"], "left")
        .select(F.col("id").alias(id_column), F.coalesce("_links", F.lit(0).cast("long")).alias("n_links"),
                F.coalesce("_component", "id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col(f"`{id_column}`") == F.col("component_id"), F.lit(False)))
    )
