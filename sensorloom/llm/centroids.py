"""Operator 11, centroid clustering with a table of pivot distances (LAESA).

Vectors become integers, so sums and distances are exact and do not depend on the order of rows. A few
pivots, far from each other, are chosen once among the first centroids, and the distance of every vector
to every pivot is stored beside the vector. In each round the driver measures the centroids (k of them)
against the pivots; the largest difference of pivot distances is a lower bound of the distance between a
vector and a centroid. A vector takes its centroids in the order of their bounds and measures them
exactly until the next bound exceeds the best distance; the rest are left out without being measured.

A round is one pass over the stored table without a shuffle of vectors: a task returns one row of
component sums per centroid. The driver sees k centroids only, never vectors.

Defined cases: vectors that are null, have another length, or hold a null or non-finite component are
left out. A null id counts as an empty one in the choice of the first centroids. Equal ids are other
vectors; where their hashes tie, the smaller vector comes first. With fewer than k vectors there are as
many centroids as vectors; an empty table gives no rows. A component whose integer is beyond 2**26 raises an
error, because squared distances would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sensorloom.llm.batches import bound_batches
from sensorloom.session import materialise

CENTROIDS = 16
ROUNDS = 3
PIVOTS = 8
DIMS = 64
SCALE = 64
LARGEST = 1 << 26
SLACK = 1e-12  # relative, for square roots; a bound that is a little too low only costs a measurement


def integers(flat: np.ndarray, dims: int, scale: float) -> np.ndarray:
    """Rows of floor(scale * x)."""
    out = np.floor(flat * scale)
    if out.size and np.abs(out).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST / scale}: squared distances would not fit a long")
    return out.astype(np.int64).reshape(-1, dims)


def lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of a to all rows of b, as the square roots of exact integers."""
    return np.sqrt(np.stack([((a - x) ** 2).sum(axis=1) for x in b], axis=1).astype(np.float64))


def choose_pivots(centroids: np.ndarray, n: int) -> np.ndarray:
    """The first centroid, then again and again the one with the greatest sum of distances to those chosen."""
    between = lengths(centroids, centroids)
    chosen = [0]
    while len(chosen) < min(n, len(centroids)):
        total = between[:, chosen].sum(axis=1)
        total[chosen] = -1
        chosen.append(int(total.argmax()))
    return centroids[chosen]


def nearest(vectors: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (the smaller number among equals), squared distance, number of distances measured."""
    n = len(vectors)
    best, which, measured = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64), np.zeros(n, np.int64)
    bounds = np.zeros((n, len(centroids)))
    for p, centre in enumerate(lengths(centroids, pivots).T):
        mine = to_pivots[:, p:p + 1]
        np.maximum(bounds, np.abs(mine - centre) - SLACK * (mine + centre), out=bounds)
    bounds *= 1 - SLACK
    rows = np.arange(n)
    while len(rows):
        at = bounds[rows, :].argmin(axis=1)
        low = bounds[rows, at]
        going = low * low <= best[rows]
        rows, at = rows[going], at[going]
        bounds[rows, at] = np.inf
        exact = ((vectors[rows] - centroids[at]) ** 2).sum(axis=1)
        measured[rows] += 1
        better = (exact < best[rows]) | ((exact == best[rows]) & (at < which[rows]))
        best[rows[better]], which[rows[better]] = exact[better], at[better]
    return which, best, measured


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def lists(values: np.ndarray) -> pa.Array:
    flat = pa.array(values.ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), flat)


def pivot_table(kept: DataFrame, dims: int, scale: float, pivots: np.ndarray) -> DataFrame:
    """Stored table (id, integer vector, distances to the pivots)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = integers(matrix(batch.column(1), dims), dims, scale)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), lists(vectors.astype(np.int32)), lists(lengths(vectors, pivots))], ["id", "vector", "to_pivots"])

    kind = kept.schema["id"].dataType.simpleString()
    return materialise(kept.mapInArrow(run, f"id {kind}, vector array<int>, to_pivots array<double>"))


def read(batch: pa.RecordBatch, dims: int, n_pivots: int) -> tuple[np.ndarray, np.ndarray]:
    return matrix(batch.column(1), dims).astype(np.int64), matrix(batch.column(2), n_pivots)


def moved(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Centroids after a round: exact floors of the means, empty ones as before."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, dims + 1), np.int64)  # the last one counts
        for batch in batches:
            vectors, to_pivots = read(batch, dims, len(pivots))
            which, _, _ = nearest(vectors, to_pivots, centroids, pivots)
            for c in np.unique(which):
                mine = which == c
                sums[c, :dims] += vectors[mine].sum(axis=0)
                sums[c, dims] += mine.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), lists(sums)], ["cluster", "sums"])

    partial = table.mapInArrow(run, "cluster int, sums array<long>").select("cluster", F.posexplode("sums").alias("at", "x"))
    # k * (dims + 1) rows, whatever the size of the table.
    total = partial.groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    sums = {(r["cluster"], r["at"]): int(r["x"]) for r in total}
    out = centroids.copy()
    for c in range(k):
        if count := sums.get((c, dims), 0):
            out[c] = [sums[c, i] // count for i in range(dims)]
    return out


def centroid_clusters(
    df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", dims: int = DIMS, scale: float = SCALE,
    k: int = CENTROIDS, rounds: int = ROUNDS, n_pivots: int = PIVOTS,
) -> DataFrame:
    """id, cluster, distance, n_measured, cluster_inertia, inertia, centroid_sha256 per kept vector.

    ``n_measured`` is the number of centroids whose distance was measured in the last pass.
    """
    bound_batches(df.sparkSession)
    finite = "forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    kept = df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{vector_column}`").cast("array<double>").alias("vector")).filter(
        f"vector IS NOT NULL AND size(vector) = {dims} AND {finite}")
    drawn = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = kept.select(drawn.alias("h"), "vector").orderBy("h", "vector").limit(k).collect()
    result = f"`{id_column}` {kept.schema['id'].dataType.simpleString()}, cluster int, distance long, n_measured int"
    if not first:
        return df.sparkSession.createDataFrame([], f"{result}, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = integers(np.array([r["vector"] for r in first]), dims, scale)
    pivots = choose_pivots(centroids, n_pivots)
    table = pivot_table(kept, dims, scale, pivots)
    for _ in range(rounds):
        centroids = moved(table, centroids, pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, best, measured = nearest(*read(batch, dims, len(pivots)), centroids, pivots)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(which.astype(np.int32)), pa.array(best), pa.array(measured.astype(np.int32))],
                [id_column, "cluster", "distance", "n_measured"])

    assigned = materialise(table.mapInArrow(run, result))
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("x")).collect()  # k rows
    inertia = {r["cluster"]: int(r["x"]) for r in sums}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    per_cluster = F.array(*[F.lit(inertia.get(c, 0)).cast("long") for c in range(len(centroids))])
    return assigned.select(
        "*", F.get(per_cluster, F.col("cluster")).alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        F.get(F.array(*[F.lit(d) for d in digests]), F.col("cluster")).alias("centroid_sha256"))
