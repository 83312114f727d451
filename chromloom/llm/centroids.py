"""Centroid clustering of whole-number vectors by Walsh-Hadamard progressive search.

A vector's components become whole numbers, and both vectors and centroids are transformed by the
exact Walsh-Hadamard transform, which multiplies squared distances by the number of components. The
coefficients are compared from coarse (few changes of sign) to fine: the sum of squared differences
so far is a lower bound, the full distance to the centroid that leads after the first coefficients
an upper one. A centroid whose sum is above that bound is strictly worse and leaves; the others
finish all coefficients, so the nearest one and its distance are exact.

Each round is one pass over the vectors. Tasks send one row a cluster and component, whatever the
number of vectors, and the driver only sees the sums of the clusters: a cluster that holds most
vectors costs no more than another.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromloom.llm.common import stored

#: Components of a vector, centroids, rounds, and the number before the id in the starting hash.
DIM, CENTROIDS, ROUNDS, SEED = 64, 8, 10, 3
SCALE = 1024
#: Coefficients compared between two eliminations, coarse to fine.
BORDERS = (8, 16, 32, 64)
#: Components up to this size keep all sums of squares within 64 bits; beyond, Python's integers count.
SMALL = 1 << 24
#: Sums travel in digits of this base, so that they add up as longs whatever the components.
DIGIT = 1 << 30
#: Vectors compared at a time.
CHUNK = 4096
LONGEST = (1 << 63) - 1


def transform(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row, without division: whole numbers stay whole."""
    n, half = x.shape[1], 1
    while half < n:
        pairs = x.reshape(len(x), n // (2 * half), 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), n)
        half *= 2
    return x


def coarse_to_fine(n: int) -> np.ndarray:
    """Order of the coefficients by the changes of sign of their rows."""
    return np.argsort((np.diff(transform(np.eye(n, dtype=np.int64)), axis=1) != 0).sum(axis=1), kind="stable")


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(number of the nearest centroid, its squared distance)`` of each row; ties go to the
    smaller number. Both arrays are of int64 or both of Python integers."""
    n, dim = vectors.shape
    order = coarse_to_fine(dim)
    v, c = transform(vectors)[:, order], transform(centroids)[:, order]
    first = min(BORDERS[0], dim)
    gap = v[:, None, :first] - c[None, :, :first]
    begun = (gap * gap).sum(axis=2)
    leader = v - c[begun.argmin(axis=1)]
    bound = (leader * leader).sum(axis=1)
    row, number = np.nonzero(begun <= bound[:, None])
    total = begun[row, number]
    for start, end in zip(BORDERS, [*BORDERS[1:], dim]):
        if start >= dim:
            break
        gap = v[row, start:min(end, dim)] - c[number, start:min(end, dim)]
        total = total + (gap * gap).sum(axis=1)
        alive = total <= bound[row]
        row, number, total = row[alive], number[alive], total[alive]
    begins = np.searchsorted(row, np.arange(n))
    least = np.minimum.reduceat(total, begins) if n else total
    at = np.flatnonzero(total == least[row])
    at = at[np.unique(row[at], return_index=True)[1]]
    return number[at], least // dim


def kept_vectors(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """``(rows, components)`` of the vectors of ``dim`` finite components."""
    lists = batch.column(1)
    sizes = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == dim)
    flat = lists.take(pa.array(rows)).flatten()
    x = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(len(rows), dim)
    good = np.isfinite(x).all(axis=1)
    return rows[good], x[good]


def whole_number(x: float) -> int:
    """floor(1024 * x), exactly; scaling by a power of two only fails at the end of the doubles."""
    x = float(x)
    return int(x) * SCALE if abs(x) > 2.0**60 else math.floor(x * SCALE)


def _groups(x: np.ndarray, centroids: list[list[int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(places, integers, clusters, distances)`` of runs of vectors, small and large ones apart."""
    center_small = all(abs(a) <= SMALL for c in centroids for a in c)
    small = (np.abs(x) < SMALL // SCALE).all(axis=1) & center_small
    for flag in (True, False):
        places = np.flatnonzero(small == flag)
        for k in range(0, len(places), CHUNK):
            at = places[k:k + CHUNK]
            if flag:
                whole, c = np.floor(x[at] * SCALE).astype(np.int64), np.array(centroids, np.int64)
            else:
                whole = np.array([[whole_number(a) for a in r] for r in x[at]], object)
                c = np.array(centroids, object)
            yield at, whole, *nearest(whole, c)


def digits(value: int) -> list[int]:
    """Digits of a number, lowest first, all of its sign."""
    sign, value, out = (-1 if value < 0 else 1), abs(int(value)), []
    while value or not out:
        value, low = divmod(value, DIGIT)
        out.append(sign * low)
    return out


#: Places of a cluster's row count and its summed distance beside its component sums.
_COUNT, _SPREAD = -1, -2
_SUMS = "cluster int, place int, digit int, part long"


def _cluster_sums(kept: DataFrame, centroids: list[list[int]], dim: int) -> dict[tuple[int, int], int]:
    """Exact sums by (cluster, place) over all vectors."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], int] = defaultdict(int)
        for batch in batches:
            _, x = kept_vectors(batch, dim)
            for _, whole, cluster, distance in _groups(x, centroids):
                for k in np.unique(cluster):
                    own = cluster == k
                    sums[int(k), _COUNT] += int(own.sum())
                    sums[int(k), _SPREAD] += sum(distance[own].tolist())
                    for place, part in enumerate(whole[own].sum(axis=0)):
                        sums[int(k), place] += int(part)
        rows = [(k, place, d, part) for (k, place), v in sums.items() for d, part in enumerate(digits(v))]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
                names=["cluster", "place", "digit", "part"])

    parts = kept.mapInArrow(add_up, _SUMS).groupBy("cluster", "place", "digit").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part"))
    out: dict[tuple[int, int], int] = defaultdict(int)
    for r in parts.collect():  # at most clusters x (components + 2) x digits
        out[r.cluster, r.place] += int(r.part) * DIGIT ** r.digit
    return out


def _fit_long(value: int) -> int | None:
    return value if value <= LONGEST else None


def cluster(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS,
    seed: int = SEED, dim: int = DIM,
) -> DataFrame:
    """Cluster of every vector: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``.

    Vectors take part with exactly ``dim`` components (a power of two), none null or non-finite;
    component x counts as the integer floor(1024 * x). Centroids start as the ``k`` vectors with the smallest hexadecimal
    SHA-256 of ``seed:vec_id`` (no id: nothing after the colon; equal ids: the smaller vector
    first), or as all vectors if fewer. A round assigns all vectors and moves each non-empty
    centroid to the floor of its mean; a round that moves none is the last, as others would repeat
    it. Repeated rows count as often as they are there. Without vectors the result is empty. A
    distance or sum above the largest long is null; the clusters are exact all the same. Other
    columns of the input are left out.
    """
    if dim & (dim - 1) or dim < 1:
        raise ValueError("the number of components must be a power of two")
    spark = df.sparkSession
    own = F.col(f"`{vector}`")
    kind = df.schema[vector].dataType.simpleString()
    own = own if kind in ("array<float>", "array<double>") else own.cast("array<double>")
    id_type = df.schema[vec_id].dataType.simpleString()
    source = df.select(F.col(f"`{vec_id}`").alias("vec_id"), own.alias("vector"))

    def filter_kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.take(pa.array(kept_vectors(batch, dim)[0]))

    kept = stored(source.mapInArrow(filter_kept, source.schema), "centroid-vectors")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    starts = kept.select(key.alias("key"), "vector").orderBy("key", "vector").limit(k).collect()
    centroids = [[whole_number(a) for a in r.vector] for r in starts]
    if not centroids:
        return spark.createDataFrame([], f"vec_id {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        sums = _cluster_sums(kept, centroids, dim)
        moved = [
            [sums[c, p] // sums[c, _COUNT] for p in range(dim)] if sums[c, _COUNT] else old
            for c, old in enumerate(centroids)
        ]
        if moved == centroids:
            break
        centroids = moved
    sums = _cluster_sums(kept, centroids, dim)
    of_cluster = [_fit_long(sums[c, _SPREAD]) for c in range(len(centroids))]
    of_all = _fit_long(sum(sums[c, _SPREAD] for c in range(len(centroids))))
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = kept_vectors(batch, dim)
            number, far = np.zeros(len(x), np.int32), np.empty(len(x), object)
            for at, _, c, d in _groups(x, centroids):
                number[at], far[at] = c, d
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(number), pa.array([_fit_long(int(d)) for d in far], pa.int64()),
                pa.array([of_cluster[c] for c in number], pa.int64()), pa.array([of_all] * len(x), pa.int64()),
                pa.array([hashes[c] for c in number], pa.string()),
            ], names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return kept.mapInArrow(assign, f"vec_id {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
