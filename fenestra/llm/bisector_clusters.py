"""Centroid clustering in exact integer arithmetic, with a tournament of bisectors.

Vectors become integers, so every round gives the same centroids on any cluster. A point x is nearer to centroid j
than to centroid i exactly if ``x . 2(c_j - c_i) > |c_j|^2 - |c_i|^2``: the normals and thresholds of all pairs are made
once per round, and a vector is assigned by k - 1 such sign tests, the winner so far against the next number; zero
leaves the smaller number. Only the winner's distance is worked out.

Every round is one narrow pass: a task adds up its vectors per centroid, and one row per task, centroid and component
is shuffled, so a vector that makes up a third of the table costs no more than any other. The driver holds
the k centroids. The kept vectors are written once.

Sums are exact: the parts of a sum above and below 2**56 are added apart, in decimals. Components up to 2**27 are worked on
as 64-bit integers, larger ones as integers of any size.

Defined results: vectors that are null, of another length, or hold null or non-finite components take no part, nor do
those with a component beyond 2**160 after scaling (no 32-bit number is); an empty table gives no rows; fewer
vectors than ``k`` give as many centroids. A null id takes part and comes last among the starting vectors; rows of equal id
are vectors of their own, the least vector first. A distance or an inertia of more than 64 bits is null. Other columns are
left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fenestra.llm.common import ship
from fenestra.session import stage

ship(__name__)

K, ROUNDS, DIMENSION, SCALE, SEED = 8, 10, 64, 1024, 3
#: Largest component for which no test, distance or sum of a batch leaves 64 bits.
_NARROW = 1 << 27
_LARGEST = 2.0 ** 160
_LOW_BITS = 56


def integers(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Floor of the scaled components; Python integers where one is too large for exact 64-bit work."""
    scaled = np.floor(scale * vectors)
    if not scaled.size or np.abs(scaled).max() <= _NARROW:
        return scaled.astype(np.int64)
    return np.array([[int(v) for v in row] for row in scaled.tolist()], object).reshape(scaled.shape)


def bisectors(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normals (k, k, d) and thresholds (k, k): x is nearer to j than to i where x . normal > threshold."""
    squares = (centroids * centroids).sum(axis=1)
    return 2 * (centroids[None, :, :] - centroids[:, None, :]), squares[None, :] - squares[:, None]


def tournament(x: np.ndarray, normals: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """Number of the nearest centroid of every row, the smaller number of equals."""
    winner = np.zeros(len(x), np.int64)
    for j in range(1, len(thresholds)):
        against = normals[winner, j]
        side = (x * against).sum(axis=1) if x.dtype == object else np.einsum("ij,ij->i", x, against)
        winner[(side > thresholds[winner, j]).astype(bool)] = j
    return winner


def assign(vectors: np.ndarray, centroids: list[list[int]], scale: int = SCALE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(integer vectors, cluster, exact squared distance) of every row."""
    x, c = integers(vectors, scale), np.array(centroids, object)
    if x.dtype != object and max(abs(v) for row in centroids for v in row) <= _NARROW:
        c = c.astype(np.int64)
    else:
        x = x.astype(object)
    cluster = tournament(x, *bisectors(c))
    away = x - c[cluster]
    return x, cluster, (away * away).sum(axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _sums(points: DataFrame, centroids: list[list[int]], scale: int) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sum of every cluster that is not empty."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, cluster, _ = assign(_matrix(batch.column(0)), centroids, scale)
            for c in np.unique(cluster).tolist():
                own = totals.setdefault(c, [0, np.zeros(x.shape[1], object)])
                own[0] += int((cluster == c).sum())
                own[1] = own[1] + x[cluster == c].sum(axis=0).astype(object)
        rows = [(c, i, n, Decimal(int(s) >> _LOW_BITS), int(s) & ((1 << _LOW_BITS) - 1))
                for c, (n, sums) in totals.items() for i, s in enumerate(sums)]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)],
                                         names=["cluster", "i", "n", "high", "low"])

    parts = points.select("vector").mapInArrow(task, "cluster int, i int, n bigint, high decimal(38,0), low bigint")
    added = parts.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("high").alias("high"),
                                              F.sum(F.col("low").cast("decimal(28,0)")).alias("low"))
    found: dict[int, tuple[int, dict[int, int]]] = {}
    for r in added.collect():  # k times the number of components
        found.setdefault(r["cluster"], (r["n"], {}))[1][r["i"]] = (int(r["high"]) << _LOW_BITS) + int(r["low"])
    return {c: (n, [sums[i] for i in range(len(sums))]) for c, (n, sums) in found.items()}


def _assigned(points: DataFrame, centroids: list[list[int]], scale: int) -> DataFrame:
    id_type = points.schema["id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, cluster, distance = assign(_matrix(batch.column(1)), centroids, scale)
                fits = [int(d) if d < 1 << 63 else None for d in distance.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster, pa.int32()), pa.array(fits, pa.int64())],
                                                 names=["id", "cluster", "distance"])

    return points.select("id", "vector").mapInArrow(task, f"id {id_type}, cluster int, distance bigint")


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dimension: int = DIMENSION, scale: int = SCALE,
            seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that takes part."""
    raw = F.col(f"`{vector_col}`")
    finite = F.forall(raw, lambda v: F.coalesce(F.abs(v) * scale < _LARGEST, F.lit(False)) & ~F.isnan(v))
    points = stage(vectors.select(F.col(f"`{id_col}`").alias("id"), raw.alias("vector")).where(
        (F.size(raw) == dimension) & finite), "points")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = points.orderBy(drawn.asc_nulls_last(), "id", "vector").limit(k).select("vector").collect()
    if not first:
        kind = vectors.schema[id_col].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"`{id_col}` {kind}, cluster int, distance bigint, cluster_inertia bigint, "
                                                        "inertia bigint, centroid_sha256 string")
    centroids = [[int(v) for v in row] for row in integers(np.array([r["vector"] for r in first], np.float64), scale).tolist()]
    for _ in range(rounds):
        for c, (n, sums) in _sums(points, centroids, scale).items():
            centroids[c] = [s // n for s in sums]

    placed = stage(_assigned(points, centroids, scale), "assigned")
    total = F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(28,0)")))
    inertia = {r["cluster"]: r["s"] for r in placed.groupBy("cluster").agg(total.alias("s")).collect()}
    whole = None if None in inertia.values() else sum(inertia.values())
    fits = lambda s: F.lit(None if s is None or s >= 1 << 63 else int(s)).cast("bigint")
    of = lambda values: F.get(F.array(*values), F.col("cluster"))
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return placed.select(
        F.col("id").alias(id_col), "cluster", "distance",
        of([fits(inertia.get(c, 0)) for c in range(len(centroids))]).alias("cluster_inertia"),
        fits(whole).alias("inertia"), of([F.lit(s) for s in shas]).alias("centroid_sha256"))
