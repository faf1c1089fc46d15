"""Centroid clustering of integer vectors by a tournament over bisecting planes.

For two centroids i < j the points as near to i as to j form a plane. Its integer normal
``2 * (c_j - c_i)`` and threshold ``|c_j|^2 - |c_i|^2`` are worked out once a round; a vector is
nearer to j where its product with the normal exceeds the threshold, and a product equal to it
favours the smaller number. A vector starts with centroid 0 as its champion and meets 1, 2, ... in
turn: after k - 1 sign tests only its nearest centroid is left. The distance to that one alone is
then computed, in exact integers.

Tasks sum the vectors of each cluster, Spark adds the sums up, and only clusters x components
numbers reach the driver, whatever the table's size. Every round reads the table anew, so nothing
is kept but the centroids, and a lost executor costs its running tasks.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLUSTERS = 16
ROUNDS = 3
DIMENSIONS = 64
FACTOR = 64
# components up to this size keep every product and sum of a 64-bit pass exact
_SAFE = 1 << 25

_KEPT = "vec_id long, row array<double>"


def kept_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, row): vectors of exactly ``dimensions`` components, none NULL or non-finite."""
    x = F.col("embedding")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    return vectors.where(x.isNotNull() & (F.size(x) == dimensions) & fine).select(
        F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("row"))


def integers(batch: pa.RecordBatch, dimensions: int, factor: int) -> np.ndarray:
    """floor(factor * x) of a batch's rows; Python integers where 64 bits could not hold a sum."""
    flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    whole = np.floor(factor * flat)
    if np.abs(whole).max(initial=0) <= _SAFE:
        return whole.astype(np.int64)
    return np.array([[int(v) for v in row] for row in whole], object).reshape(-1, dimensions)


class Bisectors:
    """Normals and thresholds of all centroid pairs, and the tournament over them."""

    def __init__(self, centroids: list[list[int]]):
        safe = max((abs(v) for c in centroids for v in c), default=0) <= _SAFE
        self.centroids = np.array(centroids, np.int64 if safe else object).reshape(len(centroids), -1)
        square = (self.centroids * self.centroids).sum(axis=1)
        self.normal = 2 * (self.centroids[None, :, :] - self.centroids[:, None, :])
        self.threshold = square[None, :] - square[:, None]

    def winners(self, rows: np.ndarray) -> np.ndarray:
        """Number of each row's nearest centroid, ties to the smaller one."""
        champion = np.zeros(len(rows), np.int64)
        for rival in range(1, len(self.centroids)):
            product = (rows * self.normal[champion, rival]).sum(axis=1)
            champion[product > self.threshold[champion, rival]] = rival
        return champion

    def distances(self, rows: np.ndarray, champion: np.ndarray) -> np.ndarray:
        """Squared distance of each row to its centroid."""
        apart = rows - self.centroids[champion]
        return (apart * apart).sum(axis=1)


def _first(vectors: DataFrame, clusters: int, dimensions: int, factor: int) -> list[list[int]]:
    """The vectors with the smallest sha256 of ``1:<vec_id>``; equal ids by their components."""
    name = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    rows = (vectors.where("vec_id is not null").select(name.alias("name"), "vec_id", "row")
            .orderBy("name", "row").limit(clusters).select("vec_id", "row").toArrow())
    return [[int(v) for v in row] for b in rows.to_batches() for row in integers(b, dimensions, factor)]


def _sums(vectors: DataFrame, centroids: list[list[int]], dimensions: int, factor: int) -> dict[int, tuple[int, list[int]]]:
    """Cluster -> (vectors in it, componentwise sum), over the whole table."""
    field = Bisectors(centroids)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = integers(batch, dimensions, factor)
            champion = field.winners(rows)
            # at most 2^25 * rows of a batch, so 64 bits hold the sums of safe rows
            for c in np.unique(champion):
                mine = rows[champion == c]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(c)] * (dimensions + 1), pa.int32()), pa.array(range(-1, dimensions), pa.int32()),
                     pa.array([str(len(mine)), *map(str, mine.sum(axis=0).tolist())])], ["cluster", "place", "part"])

    parts = vectors.mapInArrow(run, "cluster int, place int, part string")
    total = parts.groupBy("cluster", "place").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    found: dict[int, dict[int, int]] = {}
    for r in total.collect():  # clusters x (components + 1) rows
        found.setdefault(r["cluster"], {})[r["place"]] = int(r["total"])
    return {c: (t[-1], [t[j] for j in range(dimensions)]) for c, t in found.items()}


def centroids_of(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS,
                 factor: int = FACTOR) -> list[list[int]]:
    """Final integer centroids of ``kept_vectors`` rows after ``rounds`` rounds; empty clusters stay."""
    centroids = _first(vectors, clusters, dimensions, factor)
    for _ in range(rounds if centroids else 0):
        for c, (count, total) in _sums(vectors, centroids, dimensions, factor).items():
            centroids[c] = [t // count for t in total]  # floor, also of negative sums
    return centroids


def assign(vectors: DataFrame, centroids: list[list[int]], dimensions: int = DIMENSIONS, factor: int = FACTOR) -> DataFrame:
    """(vec_id, cluster, distance) of ``kept_vectors`` rows."""
    field = Bisectors(centroids)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = integers(batch, dimensions, factor)
            champion = field.winners(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(champion, pa.int32()), pa.array(field.distances(rows, champion).tolist(), pa.int64())],
                ["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS,
            factor: int = FACTOR) -> DataFrame:
    """Per kept row of ``vectors`` (vec_id, embedding): vec_id, cluster, distance, cluster_inertia,
    inertia, centroid_sha256.

    Vectors that are NULL, of another length, or hold a NULL or non-finite component give no row;
    other columns are ignored. Repeated rows count as often as they stand there, and may start
    several clusters. Rows with NULL vec_id are assigned and averaged like others but start no
    cluster; where no kept row has an id, or the table is empty, the result is empty. With fewer
    rows with ids than ``clusters`` each starts one. Components of any finite size are exact;
    squared distances beyond 64 bits raise an error.
    """
    vectors = kept_vectors(vectors, dimensions)
    centroids = centroids_of(vectors, clusters, rounds, dimensions, factor)
    spark = vectors.sparkSession
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    assigned = assign(vectors, centroids, dimensions, factor)
    inertia = {r["cluster"]: int(r["total"]) for r in assigned.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # one row a cluster
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    known = F.broadcast(spark.createDataFrame(
        [(c, inertia[c], sum(inertia.values()), digest[c]) for c in sorted(inertia)],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return assigned.join(known, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
