"""Nearest neighbours by inner product with cross-polytope hashing.

Vectors are scaled by the largest norm and given one more coordinate that makes them unit
vectors, so that the largest inner product is the nearest direction.  A table's hash
multiplies by random signs and a Hadamard matrix three times, a fast stand-in for a random
rotation, and takes the nearest of the axes and their opposites.  Every vector is in one
bucket of each of ``TABLES`` tables; a query looks in its ``PROBES`` nearest axes of each.
What it meets there is ranked by exact inner products (Andoni et al. 2015).

Equal vectors are one vector with a list of keys, so that copies cost nothing.  A bucket and
its queries are compared in tiles of bounded size, dealt over the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.workspace import Workspace

TABLES = 12
PROBES = 16
#: Vectors of either side that are compared in one go.
TILE = 4_096


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Each row times the orthogonal Hadamard matrix; its length is a power of two."""
    n, size, half = *rows.shape, 1
    while half < size:
        pairs = rows.reshape(n, -1, 2, half)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, size)
        half *= 2
    return rows / np.sqrt(size)


def rotated(vectors: np.ndarray, table: int) -> np.ndarray:
    """The table's pseudo-rotation, in the next power of two of dimensions."""
    size = 1 << max(1, (vectors.shape[1] - 1).bit_length())
    rows = np.zeros((len(vectors), size), np.float32)
    rows[:, : vectors.shape[1]] = vectors
    rng = np.random.default_rng([table, 17])
    for _ in range(3):
        rows = hadamard(rows * rng.choice(np.array([-1, 1], np.float32), size))
    return rows


def axes(vectors: np.ndarray, probes: int, tables: int) -> np.ndarray:
    """Numbers of the nearest signed axes, nearest first, for each vector: ``tables`` times ``probes`` buckets."""
    found = []
    for table in range(tables):
        rows = rotated(vectors, table)
        both = np.concatenate([rows, -rows], axis=1)
        near = np.argsort(-both, axis=1, kind="stable")[:, :probes]
        found.append(near + table * both.shape[1])
    return np.concatenate(found, axis=1)


def usable(vector: str) -> Column:
    """Neither null nor zero, and without a null or non-finite component."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _buckets(scale: float, probes: int, tables: int, query: bool) -> Column:
    @F.pandas_udf("array<int>")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            v = np.stack(batch.to_numpy()).astype(np.float64)
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            v = v / (norm if query else scale)
            more = np.zeros_like(norm) if query else np.sqrt(np.maximum(0, 1 - (norm / scale) ** 2))
            found = axes(np.concatenate([v, more], axis=1), probes, tables)
            yield pd.Series(list(found.astype(np.int32)), dtype=object)

    return hashed


def _exact(one: str, two: str) -> Column:
    """Inner product in double precision, added from the first component to the last."""
    products = F.zip_with(one, two, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def nearest(
    ws: Workspace,
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    key: str = "vec_id",
    vector: str = "embedding",
    tables: int = TABLES,
    probes: int = PROBES,
) -> DataFrame:
    """``(query_id, rank, key, score)``: each query's k nearest found, its own row left out.

    Nearest first by inner product, ties to the smaller key.  Vectors that are null, zero, not finite, of
    another length than most, or without a key take no part.  Repeated rows count once.  A key with several
    vectors is near with the nearest of them, and asks with all of them.  A table without a usable vector gives
    no rows; other columns are left behind.
    """
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("vector"), is_query.alias("asks"))
    rows = ws.write(rows.where(usable("vector") & F.col("id").isNotNull()), "vectors")
    length = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("vector") == (length["n"] if length else 0))
    # One row per distinct vector: its smallest keys, as many as can ever be answers, and a name.
    by_key = Window.partitionBy("vector").orderBy("id")
    first = rows.withColumn("_n", F.dense_rank().over(by_key)).where(F.col("_n") <= k + 1)
    folded = first.groupBy("vector").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))
    # Names rise with the smallest key, so that ties among vectors go to smaller keys.
    named = folded.orderBy(F.get("ids", F.lit(0))).withColumn("v", F.monotonically_increasing_id())
    folded = ws.write(named.withColumn("norm", norm), "folded")
    scale = folded.agg(F.max("norm")).first()[0] or 1.0

    asking = rows.where("asks").select("vector", F.col("id").alias("query_id"))
    queries = ws.write(asking.join(folded.select("vector", "v"), "vector").select("query_id", "v").distinct(), "queries")
    asked = folded.join(queries.select("v").distinct(), "v", "left_semi")

    data = folded.withColumn("bucket", F.explode(_buckets(scale, 1, tables, False)("vector")))
    probing = asked.withColumn("bucket", F.explode(_buckets(scale, probes, tables, True)("vector")))
    data, probing = (ws.write(t.select("bucket", "v", "vector"), "buckets") for t in (data, probing))

    def parts(table: DataFrame, name: str) -> DataFrame:
        return table.groupBy("bucket").agg(F.ceil(F.count("*") / TILE).cast("int").alias(name))

    tiles = ws.write(parts(data, "cols").join(parts(probing, "rows"), "bucket"), "tiles")

    def dealt(table: DataFrame, own: str, others: str, rank: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("v"), F.col(own)).cast("int").alias("own")
        every = F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias("other")
        placed = table.join(tiles, "bucket").select("bucket", mine, every, "v", "vector")
        row, col = ("own", "other") if rank == 0 else ("other", "own")
        return placed.select("bucket", F.col(row).alias("row"), F.col(col).alias("col"), F.lit(rank).alias("rank"), "v", "vector")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tile, sides = None, ([], [], [], [])
        for batch in batches:
            for t, group in batch.groupby(["bucket", "row", "col"], sort=False):
                if t != tile:
                    yield from best(*sides)
                    tile, sides = t, ([], [], [], [])
                for rank in (0, 1):
                    part = group[group["rank"] == rank]
                    sides[2 * rank].append(part["v"].to_numpy())
                    sides[2 * rank + 1].extend(part["vector"])
        yield from best(*sides)

    def best(q_ids: list, q: list, d_ids: list, d: list) -> Iterator[pd.DataFrame]:
        if not q or not d:
            return
        scores = np.stack(q).astype(np.float64) @ np.stack(d).astype(np.float64).T
        most = min(k + 1, len(d))
        at = np.argpartition(-scores, most - 1, axis=1)[:, :most]
        asked_by, found = np.concatenate(q_ids), np.concatenate(d_ids)
        yield pd.DataFrame({"q": np.repeat(asked_by, most), "v": found[at].ravel(), "near": np.take_along_axis(scores, at, 1).ravel()})

    met = dealt(probing, "rows", "cols", 0).unionByName(dealt(data, "cols", "rows", 1))
    met = met.repartition("bucket", "row", "col").sortWithinPartitions("bucket", "row", "col", "rank")
    found = met.mapInPandas(compare, "q long, v long, near double").groupBy("q", "v").agg(F.max("near").alias("near"))
    # A little more than needed goes on, as the last digits decide ties; a query's own vector always takes part.
    by_near = Window.partitionBy("q").orderBy(F.desc("near"), "v")
    short = found.withColumn("_n", F.row_number().over(by_near)).where(F.col("_n") <= 2 * k + 2).select("q", "v")
    short = short.union(asked.select(F.col("v").alias("q"), "v")).distinct()
    one, two = folded.select("v", F.col("vector").alias("theirs"), "ids"), folded.select(F.col("v").alias("q"), F.col("vector").alias("own"))
    scored = short.join(one, "v").join(two, "q").select("q", "ids", _exact("own", "theirs").alias("score"))
    answers = scored.select("q", "score", F.explode("ids").alias(key)).groupBy("q", key).agg(F.max("score").alias("score"))
    order = [F.desc("score"), F.col(key)]
    kept = answers.withColumn("_n", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("_n") <= k + 1)
    lists = ws.write(kept.select("q", "score", key), "answers")
    own = lists.join(queries.withColumnRenamed("v", "q"), "q").where(F.col(key) != F.col("query_id"))
    own = own.groupBy("query_id", key).agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).alias("rank")
    return own.select("query_id", rank, key, "score").where(F.col("rank") <= k)
