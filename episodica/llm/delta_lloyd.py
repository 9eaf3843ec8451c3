"""Centroid clustering by Lloyd's rounds that only redo what changed.

Vectors are rows of integers with the number of their cluster and the distance to its centroid, written after every round.
The sums and counts of all clusters are kept as exact integers (a row for each cluster).  In a round a vector whose own
centroid stood still is compared with the centroids that moved, any other vector with all; vectors that change cluster
are signed transfers, summed in each task first, and the kept sums are corrected by them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.llm.common import write_table

#: Components must be smaller than this in absolute value, so that squared distances of vectors of up to DIMENSIONS components fit into 64 bits.
LIMIT, DIMENSIONS = 1 << 26, 512


def usable(vector: Column, dim: int) -> Column:
    """Whether a vector has exactly dim components, none null or non-finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dim) & finite, F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(-1, dim)


def _nearest(x: np.ndarray, centroids: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of some centroids to each row (the one of smallest number of several), and the squared distance."""
    c = centroids[among]
    d = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
    at = d.argmin(1)
    return among[at], d[np.arange(len(x)), at]


def _assign(centroids: np.ndarray, moved: np.ndarray):
    """Rows (id, q, cluster, distance) with their new owners; was: the owner before."""
    every = np.arange(len(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), centroids.shape[1])
            was, distance = np.array(batch.column(2), np.int32), np.array(batch.column(3), np.int64)
            owner = was.copy()
            anew = (was < 0) | np.isin(was, moved)
            if anew.any():
                owner[anew], distance[anew] = _nearest(x[anew], centroids, every)
            rest = np.flatnonzero(~anew)
            if len(rest) and len(moved):
                by, d = _nearest(x[rest], centroids, moved)
                nearer = (d < distance[rest]) | (d == distance[rest]) & (by < owner[rest])
                owner[rest[nearer]], distance[rest[nearer]] = by[nearer], d[nearer]
            columns = [batch.column(0), batch.column(1), pa.array(owner, pa.int32()), pa.array(distance), pa.array(was, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "q", "cluster", "distance", "was"])

    return run


def _transfers(k: int, dim: int):
    """(cluster, n, sums): what the rows of a task that changed owner bring to each cluster, and take from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dim), object)
        for batch in batches:
            x, owner, was = _matrix(batch.column(0), dim), np.asarray(batch.column(1)), np.asarray(batch.column(2))
            part, left = np.zeros((k, dim), np.int64), was >= 0
            np.add.at(part, owner, x)
            np.subtract.at(part, was[left], x[left])
            n += np.bincount(owner, minlength=k) - np.bincount(was[left], minlength=k)
            sums += part  # exact: Python integers over batches
        some = [c for c in range(k) if n[c] or sums[c].any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([int(n[c]) for c in some], pa.int64()), pa.array([[str(v) for v in sums[c]] for c in some], pa.list_(pa.string()))], names=["cluster", "n", "sums"])

    return run


class Clusters:
    """rows: (id, q, cluster, distance) of every vector, written; centroids: their components, as lists of integers."""

    def __init__(self, rows: DataFrame, centroids: np.ndarray):
        self.rows, self.centroids = rows, centroids


def start(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of rows (id, q) whose sha256 of seed:id is least, in this order; of equal ids the lesser vector first."""
    first = rows.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"), "q").orderBy(F.col("h").asc_nulls_last(), "q").limit(k).collect()
    return np.array([r["q"] for r in first], np.int64)


def lloyd(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dim: int = 64, scale: int = 64, k: int = 16, rounds: int = 3, seed: int = 1) -> Clusters | None:
    """Clusters of the usable vectors of a table (see usable), each component x as the integer floor(scale * x).

    The first centroids are those of start().  Each of some rounds assigns every vector to its nearest centroid (squared
    Euclidean distance; of equal ones the smallest number) and moves every centroid that has vectors to the floor of their
    mean; then vectors are assigned once more.  Everything is exact integer arithmetic, so the result depends on no order and
    no number of tasks.  With fewer than k usable vectors there is a centroid for each; with none the result is None.
    Null keys keep their row and come last among starts; repeated rows count each.  A component of LIMIT or more raises.

    The vectors are never shuffled: a round reads the rows of the one before and writes them with their new owners, and
    what goes to the driver are at most k rows of sums a task, added up by cluster first."""
    if dim > DIMENSIONS:
        raise ValueError(f"vectors of more than {DIMENSIONS} components")
    x = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale))
    inside = F.forall("q", lambda x: F.abs(x) < LIMIT)
    q = F.when(inside, F.col("q")).otherwise(F.raise_error(F.lit(f"a component of {LIMIT} or more after scaling")).cast("array<bigint>"))
    rows = vectors.where(usable(F.col(vector), dim)).select(F.col(key).alias("id"), x.alias("q")).withColumn("q", q)
    rows = write_table(rows.select("id", "q", F.lit(-1).alias("cluster"), F.lit(0).cast("long").alias("distance")), "vectors")
    centroids = start(rows, k, seed)
    if not len(centroids):
        return None
    k = len(centroids)
    counts, sums, moved = np.zeros(k, np.int64), np.zeros((k, dim), object), np.arange(k)
    kind = dict(rows.dtypes)["id"]
    for step in range(rounds + 1):
        if not len(moved):
            break
        found = rows.mapInArrow(_assign(centroids, moved), f"id {kind}, q array<long>, cluster int, distance long, was int")
        rows = write_table(found, "vectors")
        if step == rounds:
            break
        changed = rows.where("cluster <> was").select("q", "cluster", "was").mapInArrow(_transfers(k, dim), "cluster int, n long, sums array<string>")
        summed = F.array(*[F.sum(F.col("sums")[d].cast("decimal(38,0)")) for d in range(dim)])
        for r in changed.groupBy("cluster").agg(F.sum("n").alias("n"), summed.alias("sums")).collect():
            counts[r["cluster"]] += r["n"]
            sums[r["cluster"]] += np.array([int(v) for v in r["sums"]], object)
        new = centroids.copy()
        for c in np.flatnonzero(counts):
            new[c] = [int(v) // int(counts[c]) for v in sums[c]]
        moved = np.flatnonzero((new != centroids).any(1))
        centroids = new
        rows = rows.drop("was")
    return Clusters(rows.select("id", "q", "cluster", "distance"), centroids)


def report(found: Clusters, key: str = "vec_id") -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia and centroid_sha256 (of the components, joined by commas) of every vector."""
    spark = found.rows.sparkSession
    digests = [(c, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(found.centroids.tolist())]
    sums = {r["cluster"]: r["s"] for r in found.rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    table = [(c, sums.get(c, 0), sum(sums.values()), h) for c, h in digests]
    clusters = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.rows.join(F.broadcast(clusters), "cluster").select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
