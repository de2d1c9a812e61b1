"""Size, density and flow per component, flow per account, and extremes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.functions.scoring import density, flow_weight, whole_weight
from ledgerweave.operators.ordering import running_sum


def account_flow(txn: DataFrame) -> DataFrame:
    """Per account: edges sent, whole-number outflow and inflow.

    One shuffle after partial sums, so a busy account is one row per task.
    """
    whole = whole_weight(F.col("amount"))
    real = flow_weight(F.col("amount"))
    ends = F.array(
        F.struct(
            F.col("sender").alias("account"),
            F.lit(1).alias("sent"),
            whole.alias("out_whole"),
            F.lit(0).cast("long").alias("in_whole"),
            real.alias("out_flow"),
            F.lit(0.0).alias("in_flow"),
        ),
        F.struct(
            F.col("receiver").alias("account"),
            F.lit(0).alias("sent"),
            F.lit(0).cast("long").alias("out_whole"),
            whole.alias("in_whole"),
            F.lit(0.0).alias("out_flow"),
            real.alias("in_flow"),
        ),
    )
    figures = ["sent", "out_whole", "in_whole", "out_flow", "in_flow"]
    return txn.select(F.inline(ends)).groupBy("account").agg(*[F.sum(c).alias(c) for c in figures])


def component_stats(txn: DataFrame, members: DataFrame) -> DataFrame:
    """Accounts, edges, flows and density per component.

    Edges are summed per account before the join, so it moves one row per account.
    """
    return stats_of_flows(account_flow(txn), members)


def stats_of_flows(flows: DataFrame, members: DataFrame) -> DataFrame:
    return (
        members.join(flows, "account", "left")
        .groupBy("component")
        .agg(
            F.count(F.lit(1)).alias("accounts"),
            F.coalesce(F.sum("sent"), F.lit(0)).alias("edges"),
            F.coalesce(F.sum("out_flow"), F.lit(0.0)).alias("out_flow"),
            F.coalesce(F.sum("in_flow"), F.lit(0.0)).alias("in_flow"),
        )
        .withColumn("density", density(F.col("edges"), F.col("accounts")))
    )


def extremes(stats: DataFrame) -> DataFrame:
    """One row: how many components, the largest and the densest; ties to the smaller id.

    Like the report it feeds, it names no densest component while all densities are 0.
    """
    size_rank = F.struct(-F.col("accounts"), F.col("component"))
    density_rank = F.struct(-F.col("density"), F.col("component"))
    dense = F.when(F.col("density") > 0, F.col("component"))
    return stats.agg(
        F.count(F.lit(1)).alias("num_components"),
        F.sum("edges").alias("num_edges"),
        F.min_by("component", size_rank).alias("largest"),
        F.max("accounts").alias("largest_accounts"),
        F.min_by(dense, density_rank).alias("densest"),
        F.coalesce(F.max("density"), F.lit(0.0)).alias("largest_density"),
    )


def running_outflow(txn: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Each edge with its sender's whole-number outflow up to and including it."""
    weighted = txn.withColumn("weight", whole_weight(F.col("amount")))
    return running_sum(weighted, "sender", "seq", "weight", "out_hh", hot).drop("weight")


def last_edges(txn: DataFrame, n: int) -> DataFrame:
    """The ``n`` edges that arrived last."""
    newest = txn.agg(F.max("seq").alias("newest"))
    return txn.join(F.broadcast(newest), F.col("seq") > F.col("newest") - n).drop("newest")


def recent_senders(txn: DataFrame, n: int = 10_000) -> DataFrame:
    """Senders of the last ``n`` edges with the arrival number of first sight there."""
    return last_edges(txn, n).groupBy(F.col("sender").alias("account")).agg(F.min("seq").alias("first_seq"))


def top_senders(
    txn: DataFrame,
    members: DataFrame,
    k: int = 5,
    recent: int = 10_000,
    width: int = 4096,
    stats: DataFrame | None = None,
    outflow: DataFrame | None = None,
) -> DataFrame:
    """The ``k`` recent senders with the most outflow, and how far a sketch could overstate it.

    ``outflow`` may bring sketched figures as ``(account, est_out)``; the default
    is exact.  Senders without a component are left out.
    """
    if outflow is None:
        outflow = account_flow(txn).select("account", F.col("out_whole").alias("est_out"))
    if stats is None:
        stats = component_stats(txn, members)
    candidates = recent_senders(txn, recent).join(outflow, "account").join(members, "account")
    bound = stats.select("component", (F.col("out_flow") / width).alias("bound"))
    best = candidates.orderBy(F.desc("est_out"), "first_seq").limit(k)
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("est_out"), "first_seq")
    return (
        best.join(bound, "component", "left")
        .withColumn("place", F.row_number().over(order))  # over k rows
        .select("place", "account", "component", "est_out", "bound")
    )
