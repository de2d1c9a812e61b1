"""Centroid clustering with integer arithmetic and dot products kept between rounds.

Vectors and centroids have integer components, so squared distances are exact:
``|x|^2 - 2 x.c + |c|^2``.  The products ``x.c`` of every vector with all centroids are kept
in a table beside the vector.  When centroids move, only the components that changed are
multiplied: ``x.c' = x.c + x.(c' - c)``; a centroid that stayed costs nothing.  Nearest
centroids are then taken anew from the products.

A round is two passes over the table: one that brings products up to date and assigns, one
that sums vectors per cluster, first within tasks.  The driver holds the centroids only, as
many as were asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.workspace import Workspace

#: Components must stay below this in size: distances and sums of them then fit 64 bits.
LARGEST = 1 << 26


def integers(vector: str, factor: float) -> Column:
    """Each component times the factor, as double, rounded down; finite components only."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(factor)) * x.cast("double")))


def complete(vector: str, length: int) -> Column:
    """A vector of that many components, none null or non-finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == length) & finite, F.lit(False))


def first_centroids(rows: DataFrame, clusters: int, seed: str) -> np.ndarray:
    """The components of the vectors whose seeded keys have the smallest digests; as many as there are, at most ``clusters``.

    Rows of one key have one digest; the smaller components go first.  Rows without a key go last.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")).cast("binary"), 256)
    best = rows.select("x", digest.alias("digest")).orderBy(F.col("digest").asc_nulls_last(), "x").limit(clusters)
    return np.array([r.x for r in best.collect()], dtype=np.int64)  # ``clusters`` rows


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _lists(matrix: np.ndarray) -> pa.Array:
    offsets = np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()))


def _assign(table: DataFrame, old: np.ndarray, new: np.ndarray) -> DataFrame:
    """``table`` with its products taken from the old centroids to the new ones, and the nearest of these."""
    change, squares = new - old, (new * new).sum(axis=1)
    moved = [(c, np.flatnonzero(row)) for c, row in enumerate(change) if row.any()]

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, dots = _matrix(batch["x"], new.shape[1]), _matrix(batch["dots"], len(new)).copy()
            for c, parts in moved:
                dots[:, c] += x[:, parts] @ change[c, parts]
            distances = (x * x).sum(axis=1)[:, None] - 2 * dots + squares
            nearest = distances.argmin(axis=1)  # the first of equals
            least = distances[np.arange(len(nearest)), nearest]
            yield pa.RecordBatch.from_arrays(
                [batch["key"], batch["x"], _lists(dots), pa.array(nearest.astype(np.int32)), pa.array(least)],
                names=["key", "x", "dots", "cluster", "distance"],
            )

    key = table.schema["key"].dataType.simpleString()
    return table.mapInArrow(update, f"key {key}, x array<bigint>, dots array<bigint>, cluster int, distance bigint")


def _means(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floor of each cluster's mean; where a cluster is empty, its centroid stays."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            cluster = batch["cluster"].to_numpy()
            count += np.bincount(cluster, minlength=len(centroids))
            np.add.at(total, cluster, _matrix(batch["x"], centroids.shape[1]))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(count[used]), _lists(total[used])], names=["cluster", "n", "sums"]
        )

    within = table.select("cluster", "x").mapInArrow(sums, "cluster int, n bigint, sums array<bigint>")
    pieces = within.select("cluster", "n", F.posexplode("sums").alias("part", "value"))
    wide = pieces.groupBy("cluster", "part").agg(F.sum("n").alias("n"), F.sum("value").alias("value"))
    means = centroids.copy()
    for row in wide.collect():  # clusters x components rows
        means[row.cluster, row.part] = row.value // row.n
    return means


def cluster(
    ws: Workspace,
    vectors: DataFrame,
    clusters: int,
    rounds: int,
    length: int,
    key: str = "vec_id",
    vector: str = "embedding",
    factor: float = 64.0,
    seed: str = "1",
) -> tuple[DataFrame, np.ndarray]:
    """``(key, x, cluster, distance)`` for every kept vector, and the last centroids.

    Vectors that are null, of another length, or hold a null or non-finite component take no part.  Each row is a
    vector of its own, also where keys repeat or are null.  With fewer rows than clusters there are as many
    clusters as rows; without any the result is empty.  Components beyond ``LARGEST`` raise, as distances would
    not fit.  Other columns are left behind.
    """
    kept = vectors.where(complete(vector, length)).select(F.col(key).alias("key"), integers(vector, factor).alias("x"))
    outside = F.exists("x", lambda v: (v >= LARGEST) | (v <= -LARGEST))
    table = ws.write(kept.withColumn("dots", F.array_repeat(F.lit(0).cast("long"), clusters)), "vectors", outside=outside)
    if ws.count(table, "outside"):
        raise ValueError(f"{ws.count(table, 'outside')} vectors have components of {LARGEST} or more after scaling")
    new = first_centroids(table, clusters, seed)
    if not len(new):
        empty = table.select(F.col("key").alias(key), "x", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return empty.where("false"), new
    if len(new) < clusters:
        table = table.withColumn("dots", F.slice("dots", 1, len(new)))
    old = np.zeros_like(new)
    for remaining in range(rounds, -1, -1):
        assigned = ws.write(_assign(table, old, new), "assigned")
        ws.drop(table)
        table = assigned
        if remaining:
            old, new = new, _means(table, new)
    return table.select(F.col("key").alias(key), "x", "cluster", "distance"), new


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned`` with distances summed per cluster and over all, and a digest of the cluster's centroid."""
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    per_cluster = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    inertia = F.lit(assigned.agg(F.sum("distance")).first()[0]).cast("long").alias("inertia")
    # As many rows as clusters.
    joined = assigned.join(F.broadcast(per_cluster), "cluster").select("*", inertia)
    digest = F.get(F.array(*map(F.lit, digests)), F.col("cluster")) if digests else F.lit(None).cast("string")
    return joined.withColumn("centroid_sha256", digest)
