"""Tighten suspicious components to blocks linked by two-way transfers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.functions.scoring import density, flow_weight
from ledgerweave.operators.components import components
from ledgerweave.operators.ordering import latest
from ledgerweave.operators.pairs import mutual_pairs
from ledgerweave.operators.skew import GROUP_ROWS, hot_keys, lookup
from ledgerweave.operators.stats import component_stats, last_edges
from ledgerweave.workspace import Workspace


@dataclass(frozen=True)
class Refined:
    blocks: DataFrame  # (component, block, refined, accounts, edges, out_flow, density)
    members: DataFrame  # (account, block, component), accounts of the new blocks


def refine(
    ws: Workspace,
    txn: DataFrame,
    members: DataFrame,
    flagged: DataFrame,
    window_edges: int | None = None,
    component_edges: int | None = None,
    group_rows: int = GROUP_ROWS,
) -> Refined:
    """Split each flagged component by the two-way pairs among its edges.

    All edges count, unless ``window_edges`` or ``component_edges`` say how many of the latest do,
    overall and per component.  Block figures come from those edges alone.  A component without a
    two-way pair is kept as it is, with ``refined`` false.
    """
    suspects = ws.write(_of_flagged(ws, members, flagged, group_rows), "suspects")
    recent = txn if window_edges is None else last_edges(txn, window_edges)
    if component_edges is None:
        window = _of_suspects(ws, ws.write(_folded(recent), "folded"), suspects, "receiver", group_rows)
    else:
        recent = ws.write(recent, "recent")
        tagged = _of_suspects(ws, recent, suspects, "seq", group_rows)
        hot_components = None
        if ws.rows(recent) > group_rows:
            tagged = ws.write(tagged, "tagged")
            hot_components = hot_keys(ws, tagged, "component", group_rows)
        window = _folded(latest(tagged, "component", "seq", component_edges, hot_components), "component")
    window = ws.write(window, "window")
    mutual = ws.write(mutual_pairs(window, by=("component",)), "mutual")
    blocks = components(ws, mutual, "lo", "hi", group_rows).withColumnRenamed("component", "block")
    owner = mutual.select("component", F.explode(F.array("lo", "hi")).alias("account")).distinct()
    located = ws.write(blocks.join(owner, "account"), "blocks")
    inside = _inside(ws, window, located, group_rows)
    refined = _block_stats(inside, located)
    kept = _kept(ws, txn, suspects, located, group_rows)
    return Refined(refined.unionByName(kept), located)


def _folded(edges: DataFrame, *by: str) -> DataFrame:
    """A row per sender and receiver: its edges and their flow."""
    return edges.groupBy(*by, "sender", "receiver").agg(
        F.count(F.lit(1)).alias("edges"), F.sum(flow_weight(F.col("amount"))).alias("out_flow")
    )


def _of_suspects(ws: Workspace, edges: DataFrame, suspects: DataFrame, spread: str, group_rows: int) -> DataFrame:
    """Edges of the flagged components, with their component."""
    hot = hot_keys(ws, edges, "sender", group_rows)
    return lookup(edges, "sender", suspects, "account", spread, hot, "inner")


def _inside(ws: Workspace, window: DataFrame, located: DataFrame, group_rows: int) -> DataFrame:
    """Folded edges whose two ends share a block."""
    one = located.select("account", F.col("block").alias("from_block"))
    two = located.select("account", F.col("block").alias("to_block"))
    hot = {end: hot_keys(ws, window, end, group_rows) for end in ("sender", "receiver")}
    left = lookup(window, "sender", one, "account", "receiver", hot["sender"], "inner")
    both = lookup(left, "receiver", two, "account", "sender", hot["receiver"], "inner")
    return both.where("from_block = to_block").withColumnRenamed("from_block", "block").drop("to_block")


def _block_stats(inside: DataFrame, located: DataFrame) -> DataFrame:
    sizes = located.groupBy("component", "block").agg(F.count(F.lit(1)).alias("accounts"))
    flows = inside.groupBy("block").agg(F.sum("edges").alias("edges"), F.sum("out_flow").alias("out_flow"))
    return sizes.join(flows, "block").select(
        "component", "block", F.lit(True).alias("refined"), "accounts", "edges", "out_flow",
        density(F.col("edges"), F.col("accounts")).alias("density"),
    )


def _of_flagged(ws: Workspace, members: DataFrame, flagged: DataFrame, group_rows: int) -> DataFrame:
    hot = hot_keys(ws, members, "component", group_rows)
    names = flagged.select("component").distinct()
    return lookup(members, "component", names, "component", "account", hot, "inner").select(
        "account", "component"
    )


def _kept(
    ws: Workspace, txn: DataFrame, suspects: DataFrame, located: DataFrame, group_rows: int
) -> DataFrame:
    refined = located.select("component").distinct().withColumn("split", F.lit(True))
    hot = hot_keys(ws, suspects, "component", group_rows)
    marked = lookup(suspects, "component", refined, "component", "account", hot)
    stats = component_stats(txn, marked.where("split IS NULL").select("account", "component"))
    return stats.select(
        "component", F.col("component").alias("block"), F.lit(False).alias("refined"),
        "accounts", "edges", "out_flow", "density",
    )
