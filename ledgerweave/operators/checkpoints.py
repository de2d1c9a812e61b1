"""The summary as it stood after every n-th edge.

All checkpoints are worked out together.  A component's state after an edge holds until its
chain's next edge or its merge into another, so states are intervals of checkpoints.  The
largest component only grows, which makes it a running extreme.  The densest does not: each
interval is cut into the nodes of a binary tree over the checkpoints (two a level at most),
the best is kept per node, and a checkpoint takes the best of the nodes above it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.functions import scoring
from ledgerweave.operators.components import merge_forest
from ledgerweave.operators.merges import mark_merges
from ledgerweave.operators.mergetree import along_chains, merge_tree
from ledgerweave.operators.ordering import running
from ledgerweave.operators.skew import GROUP_ROWS
from ledgerweave.workspace import Workspace


def tree_nodes(low: Column, beyond: Column, levels: int) -> Column:
    """Nodes ``(level, node)`` whose leaves make up ``low <= leaf < beyond``; node i of level l has leaves from i 2^l on."""

    def at(level: int) -> list[Column]:
        size = 1 << level
        first, last = F.ceil(low / size).cast("long"), F.floor(beyond / size).cast("long")
        found = F.struct(F.lit(level).alias("level"), first.alias("node"))
        other = F.struct(F.lit(level).alias("level"), (last - 1).alias("node"))
        return [F.when((first < last) & (first % 2 == 1), found), F.when((first < last) & (last % 2 == 1), other)]

    nodes = F.array(*[node for level in range(levels) for node in at(level)])
    return F.array_distinct(F.filter(nodes, lambda n: n.isNotNull()))


def _upto(per_point: DataFrame, sums: dict[str, Column], least: dict[str, Column], group_rows: int) -> DataFrame:
    """Running figures over the checkpoints, in slices."""
    one = per_point.sparkSession.createDataFrame([(0,)], "_all int")
    return running(per_point.withColumn("_all", F.lit(0)), "_all", "point", sums, least, one, group_rows).drop("_all")


def summary_every(
    ws: Workspace,
    txn: DataFrame,
    every: int = 200_000,
    topk: int = 5,
    recent: int = 10_000,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """One row per ``every`` edges and one at the end, as of edge ``upto``.

    Columns: ``upto, num_components, num_edges, largest, largest_accounts, densest, largest_density`` and
    ``top_senders``, the senders among the ``recent`` last edges with the most outflow, as an array of
    ``(place, account, est_out)``.  Ties go to the smaller component, and to the sender seen first.  An empty
    table has no rows.
    """
    edges = ws.rows(txn)
    points = -(-edges // every)
    levels = max(1, points.bit_length())
    point = F.ceil(F.col("seq") / every).cast("long")
    forest = merge_forest(ws, txn, group_rows=group_rows)
    tree = merge_tree(ws, forest, group_rows)
    marked = mark_merges(ws, txn, forest, tree, group_rows, to_the_end=True)
    placed = ws.write(marked.where("chain IS NOT NULL").select("seq", "chain", "merges"), "placed")
    states = ws.write(along_chains(ws, placed, tree, None, group_rows), "states")

    # Components: accounts seen, less merges; the largest of all so far is still there, or part of a larger one.
    seen = txn.select(F.explode(F.array("sender", "receiver")).alias("root"), "seq").groupBy("root").agg(F.min("seq").alias("seq"))
    born = seen.select(point.alias("point"), F.lit(1).alias("change"), F.lit(1).cast("long").alias("accounts"), "root")
    merged = states.where("merges").select(point.alias("point"), F.lit(-1).alias("change"), "accounts", "root")
    size_rank = F.struct((-F.col("accounts")).alias("less"), "root")
    changes = born.unionByName(merged).groupBy("point").agg(F.sum("change").alias("change"), F.min(size_rank).alias("best"))
    every_point = ws.spark.range(1, points + 1).withColumnRenamed("id", "point")
    counted = _upto(
        every_point.join(changes, "point", "left"),
        {"num_components": F.col("change")}, {"biggest": F.col("best")}, group_rows,
    )

    # Densest: the last state of a chain at each checkpoint it changed by, until it changes again or is left.
    last = states.groupBy("chain", point.alias("point")).agg(F.max_by(F.struct("root", "accounts", "edges"), "seq").alias("state"))
    left = tree.chains.select("chain", F.ceil(F.get("steps", F.lit(0))["until"] / every).cast("long").alias("gone"))
    following = F.lead("point").over(Window.partitionBy("chain").orderBy("point"))
    beyond = F.least(following, "gone", F.lit(points + 1).cast("long"))
    held = last.join(left, "chain", "left").select(
        "point", beyond.alias("beyond"), F.col("state.root").alias("root"),
        scoring.density(F.col("state.edges"), F.col("state.accounts")).alias("density"),
    ).where("density > 0 AND point < beyond")
    density_rank = F.struct((-F.col("density")).alias("less"), "root")
    nodes = held.select(F.inline(tree_nodes(F.col("point"), F.col("beyond"), levels)), density_rank.alias("rank"))
    best = nodes.groupBy("level", "node").agg(F.min("rank").alias("rank"))
    above = F.inline(F.array(*[F.struct(F.lit(i).alias("level"), F.shiftright("point", i).alias("node")) for i in range(levels)]))
    densest = every_point.select("point", above).join(best, ["level", "node"]).groupBy("point").agg(F.min("rank").alias("dense"))

    # Top senders: an edge counts at the checkpoints that follow it closely.
    at = F.least(F.col("point") * every, F.lit(edges))
    reach = F.least(F.floor((F.col("seq") + recent - 1) / every) + 1, F.lit(points)).cast("long")
    near = marked.select("seq", "sender", "out_hh", F.explode(F.sequence(point, F.greatest(point, reach))).alias("point"))
    sent = near.where(F.col("seq") > at - recent).groupBy("point", "sender").agg(
        F.max("out_hh").alias("est_out"), F.min("seq").alias("first_seq")
    )
    place = F.row_number().over(Window.partitionBy("point").orderBy(F.desc("est_out"), "first_seq"))
    entry = F.struct("place", F.col("sender").alias("account"), "est_out")
    top = sent.withColumn("place", place).where(F.col("place") <= topk).groupBy("point").agg(
        F.sort_array(F.collect_list(entry)).alias("top_senders")
    )
    return counted.join(densest, "point", "left").join(top, "point", "left").select(
        at.cast("long").alias("upto"), "num_components", at.cast("long").alias("num_edges"),
        F.col("biggest.root").alias("largest"), (-F.col("biggest.less")).alias("largest_accounts"),
        F.col("dense.root").alias("densest"), F.coalesce(-F.col("dense.less"), F.lit(0.0)).alias("largest_density"), "top_senders",
    )
