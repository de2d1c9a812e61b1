"""Mergeable sketches in long form, with their own accuracy figures."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.functions.hashing import MODULUS, as_number, cell, kmv_hash
from ledgerweave.functions.scoring import whole_weight

# Default sketch sizes.
KMV_K = 128
CMS_WIDTH = 4096
CMS_DEPTH = 6


def kmv_samples(members: DataFrame, k: int = KMV_K) -> DataFrame:
    """The ``k`` smallest distinct hashes per component, as ``(component, h)``.

    Spark limits each group to ``k`` rows before the shuffle, so a giant
    component sends at most ``k`` rows per task.
    """
    number = as_number(F.col("account"), members.schema["account"].dataType)
    return _smallest(members.select("component", kmv_hash(number).alias("h")), k)


def merge_kmv(left: DataFrame, right: DataFrame, k: int = KMV_K) -> DataFrame:
    """Samples of a union from the samples of its parts; hashes are not hashed again."""
    return _smallest(left.union(right), k)


def _smallest(hashes: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("component").orderBy("h")
    return hashes.withColumn("_n", F.dense_rank().over(order)).where(F.col("_n") <= k).drop("_n").distinct()


def kmv_estimate(samples: DataFrame, k: int = KMV_K) -> DataFrame:
    """Distinct estimate and its figures: k, samples, k-th hash, expected relative error."""
    found = samples.groupBy("component").agg(
        F.count(F.lit(1)).alias("n_samples"), F.max("h").alias("largest")
    )
    full = (F.col("n_samples") >= k) & (F.col("largest") > 0)
    estimate = (k - 1) * (F.lit(float(MODULUS)) / F.col("largest"))
    return found.select(
        "component",
        F.lit(k).alias("k"),
        "n_samples",
        F.when(F.col("n_samples") >= k, F.col("largest")).alias("r_k"),
        F.lit(1.0 / math.sqrt(k)).alias("rel_error_theory"),
        F.when(full, estimate).otherwise(F.col("n_samples").cast("double")).alias("estimate"),
    )


def theta_distinct(members: DataFrame) -> DataFrame:
    """Distinct accounts per component by Spark's own theta sketch, as ``(component, sketch, estimate)``."""
    sketched = members.groupBy("component").agg(F.expr("theta_sketch_agg(account)").alias("sketch"))
    return sketched.withColumn("estimate", F.expr("theta_sketch_estimate(sketch)"))


def merge_theta(sketches: DataFrame) -> DataFrame:
    """One sketch per component from several partial ones."""
    merged = sketches.groupBy("component").agg(F.expr("theta_union_agg(sketch)").alias("sketch"))
    return merged.withColumn("estimate", F.expr("theta_sketch_estimate(sketch)"))


def _rows_and_cells(number, width: int, depth: int):
    cells = [F.struct(F.lit(i).alias("row"), cell(number, i, width).alias("cell")) for i in range(depth)]
    return F.array(*cells)


def cms_cells(
    txn: DataFrame,
    members: DataFrame,
    account: str = "sender",
    width: int = CMS_WIDTH,
    depth: int = CMS_DEPTH,
) -> DataFrame:
    """Weighted Count-Min cells per component: ``(component, row, cell, total)``.

    Weights are summed per account before they are spread over the rows.
    """
    weight = whole_weight(F.col("amount"))
    flows = txn.groupBy(F.col(account).alias("account")).agg(F.sum(weight).alias("weight"))
    number = as_number(F.col("account"), members.schema["account"].dataType)
    return (
        flows.join(members, "account")
        .select("component", "weight", F.inline(_rows_and_cells(number, width, depth)))
        .groupBy("component", "row", "cell")
        .agg(F.sum("weight").alias("total"))
    )


def merge_cms(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.union(right).groupBy("component", "row", "cell").agg(F.sum("total").alias("total"))


def cms_query(
    cells: DataFrame, members: DataFrame, width: int = CMS_WIDTH, depth: int = CMS_DEPTH
) -> DataFrame:
    """``(account, component, estimate)``: the least of the account's cells, 0 if unseen."""
    number = as_number(F.col("account"), members.schema["account"].dataType)
    asked = members.select("account", "component", F.inline(_rows_and_cells(number, width, depth)))
    return (
        asked.join(cells, ["component", "row", "cell"], "left")
        .groupBy("account", "component")
        .agg(F.min(F.coalesce("total", F.lit(0))).alias("estimate"))
    )


def cms_figures(stats: DataFrame, width: int = CMS_WIDTH, depth: int = CMS_DEPTH) -> DataFrame:
    """Width, depth, error rates and bounds on the overestimate per component."""
    epsilon = 1.0 / width
    published = math.e / width
    return stats.select(
        "component",
        F.lit(width).alias("w"),
        F.lit(depth).alias("d"),
        F.lit(epsilon).alias("epsilon"),
        F.lit(published).alias("epsilon_published"),
        F.lit(math.exp(-depth)).alias("delta"),
        F.col("out_flow").alias("n_out"),
        F.col("in_flow").alias("n_in"),
        (epsilon * F.col("out_flow")).alias("bound_out"),
        (epsilon * F.col("in_flow")).alias("bound_in"),
        (published * F.col("out_flow")).alias("bound_out_published"),
    )
