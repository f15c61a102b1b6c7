"""Centroid clustering with Ptolemaic pivots, in exact integers.

A round assigns every vector to its nearest centroid. Most centroids are ruled out
without their distance: for two pivots s, t Ptolemy's inequality gives

    d(v, c) >= |d(v, s) d(c, t) - d(v, t) d(c, s)| / d(s, t)

from distances to pivots alone. Those of a vector are computed once and stored with
it, those of a centroid once a round. Bounds are rounded down by more than all
floating-point error; a centroid whose bound does not exceed the distance to the
best one so far is checked exactly, in integers. So results do not depend on the
pivots, only the work does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, prepare

DIMENSION, SCALE = 64, 256
CLUSTERS, ROUNDS, SEED = 40, 5, 2
# Pivots are the first of the starting centroids; every pair of them gives a bound.
PIVOTS = 6
# Bounds are lowered by this share and squares by this much: far above rounding error.
SLACK = 1e-9
# Components beyond this size would let a squared distance leave 63 bits.
LARGEST = 2**27

KEPT = "vec_id long, v array<long>, pivots array<double>"
ASSIGNED = "vec_id long, cluster int, distance long"
SUMS = "cluster int, n long, sums array<long>"


def usable(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, v``: integer components of the vectors that have exactly ``DIMENSION`` finite ones."""
    rows = vectors.select(F.col(ident).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("d"))
    fine = F.forall("d", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    scaled = F.transform("d", lambda x: F.floor(x * F.lit(float(SCALE))))
    large = F.exists("v", lambda x: F.abs(x) > LARGEST)
    return (
        rows.where((F.size("d") == DIMENSION) & fine)
        .select("vec_id", scaled.alias("v"))
        .withColumn("v", F.when(large, F.raise_error(F.lit(f"components are limited to {LARGEST}"))).otherwise(F.col("v")))
    )


def starting_centroids(rows: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors with the smallest SHA-256 of ``seed:vec_id``; a null id comes last, ties go by components."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(name.asc_nulls_last(), "v").limit(clusters).collect()
    return np.array([r.v for r in first], np.int64).reshape(len(first), DIMENSION)


def _matrix(column: pa.Array, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of x to those of y."""
    squares = [((x - c) ** 2).sum(axis=1) for c in y]
    return np.sqrt(np.array(squares, np.float64).reshape(len(y), len(x)).T)


class Assigner:
    """Nearest centroids of integer vectors, by bounds and exact checks."""

    def __init__(self, centroids: np.ndarray, pivots: np.ndarray):
        self.centroids = centroids
        self.to_pivots = _distances(centroids, pivots)
        between = _distances(pivots, pivots)
        self.pairs = [(s, t, between[s, t]) for s in range(len(pivots)) for t in range(s) if between[s, t] > 0]
        self.checked = 0

    def bounds(self, cached: np.ndarray) -> np.ndarray:
        """Lower bounds of the squared distances, one row per vector."""
        low = np.zeros((len(cached), len(self.centroids)))
        for s, t, apart in self.pairs:
            a = cached[:, s, None] * self.to_pivots[None, :, t]
            b = cached[:, t, None] * self.to_pivots[None, :, s]
            np.maximum(low, (np.abs(a - b) - SLACK * (a + b)) / apart, out=low)
        return low * low * (1 - SLACK) - SLACK

    def nearest(self, x: np.ndarray, cached: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of and squared distance to the nearest centroid; ties go to the smaller number."""
        low = self.bounds(cached)
        best = np.argmin(low, axis=1)  # a likely one first: it bounds the others
        rows = np.arange(len(x))
        distance = ((x - self.centroids[best]) ** 2).sum(axis=1)
        low[rows, best] = np.inf
        for c, centroid in enumerate(self.centroids):
            open_rows = np.flatnonzero(low[:, c] <= distance)
            if len(open_rows):
                exact = ((x[open_rows] - centroid) ** 2).sum(axis=1)
                self.checked += len(open_rows)
                better = (exact < distance[open_rows]) | ((exact == distance[open_rows]) & (c < best[open_rows]))
                best[open_rows[better]], distance[open_rows[better]] = c, exact[better]
        return best, distance


def _with_pivots(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cached = _distances(_matrix(batch.column("v"), np.int64), pivots)
                stored = pa.FixedSizeListArray.from_arrays(pa.array(cached.ravel()), len(pivots)).cast(pa.list_(pa.float64()))
                yield pa.record_batch([batch.column("vec_id"), batch.column("v"), stored], ["vec_id", "v", "pivots"])

    return run


def _assign(centroids: np.ndarray, pivots: np.ndarray, sums: bool):
    """Per vector its cluster and distance, or per task and cluster the sum of the vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assigner = Assigner(centroids, pivots)
        count = np.zeros(len(centroids), np.int64)
        total = np.zeros_like(centroids)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("v"), np.int64)
            best, distance = assigner.nearest(x, _matrix(batch.column("pivots"), np.float64))
            if sums:
                count += np.bincount(best, minlength=len(count))
                order = np.argsort(best, kind="stable")
                present, at = np.unique(best[order], return_index=True)
                total[present] += np.add.reduceat(x[order], at, axis=0)
            else:
                yield pa.record_batch(
                    [batch.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(distance)],
                    ["vec_id", "cluster", "distance"],
                )
        if sums:
            used = np.flatnonzero(count)
            yield pa.record_batch(
                [pa.array(used.astype(np.int32)), pa.array(count[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))],
                ["cluster", "n", "sums"],
            )

    return run


def cluster(
    vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding",
    clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED,
) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance`` (squared) of every usable vector, and the final centroids.

    Vectors with another number of components, or with null or non-finite ones, take no
    part. Components are floor(256 x); one beyond 2**27 in size raises an error, as
    distances would not fit a long. Each row is a vector of its own, repeated or null
    ids included; rows with a null id never start a cluster unless too few others are
    there. Fewer rows than clusters start fewer clusters; an empty table gives no
    rows. An empty cluster keeps its centroid. Other columns are not read. Only
    centroids and their sums (clusters x 64 numbers) pass through the driver.
    """
    prepare(vectors.sparkSession)
    rows = usable(vectors, ident, vector)
    centroids = starting_centroids(rows, clusters, seed)
    pivots = np.unique(centroids, axis=0)[:PIVOTS]
    # Written once: every round reads the vectors with their cached pivot distances.
    stored = cut_lineage(rows.mapInArrow(_with_pivots(pivots), KEPT), "vectors")
    for _ in range(rounds if len(centroids) else 0):
        parts = stored.mapInArrow(_assign(centroids, pivots, sums=True), SUMS)
        added = parts.groupBy("cluster").agg(
            F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(DIMENSION)]).alias("sums")
        )
        centroids = centroids.copy()
        for r in added.collect():
            centroids[r.cluster] = [s // r.n for s in r.sums]  # floor, also of negative sums
    return stored.mapInArrow(_assign(centroids, pivots, sums=False), ASSIGNED), centroids


def inertias(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The assignment with ``cluster_inertia``, ``inertia`` and ``centroid_sha256``."""
    spark = assigned.sparkSession
    stored = cut_lineage(assigned, "assigned")
    sums = {r.cluster: r.s for r in stored.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    rows = [(int(c), s, sum(sums.values()), names[c]) for c, s in sums.items()]
    told = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return stored.join(F.broadcast(told), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
