"""Cheapest directed distance from a set of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.operators.components import contract_entities, project
from ledgerweave.operators.skew import GROUP_ROWS, hot_keys
from ledgerweave.workspace import Workspace


class NegativeWeight(ValueError):
    """A weight below zero: cheapest distances would not be defined."""


def cheapest_distances(
    ws: Workspace,
    edges: DataFrame,
    sources: DataFrame,
    group_rows: int = GROUP_ROWS,
    cutoff: float | None = None,
    nearest: bool = False,
) -> DataFrame:
    """``(source, node, dist)`` for every node reached from each source.

    ``edges`` has ``src, dst, w`` and ``sources`` has ``source, node``.  With ``cutoff`` nodes further away
    are left out; with ``nearest`` each node keeps its nearest source only (ties to the smaller), which is a
    row per node whatever the number of sources.

    Chains of nodes with one way in and one way out are bypassed first, so a path takes rounds by the
    logarithm of its length.  Then all sources share the rounds: nodes whose distance fell are joined to
    their outgoing edges, and what falls below the known distances is written, and nothing else.
    """
    if not edges.where("w < 0").isEmpty():
        raise NegativeWeight("edge weights must not be negative")
    cheapest = ws.write(
        edges.where("src <> dst").groupBy("src", "dst").agg(F.min("w").alias("w")), "cheapest"
    )
    starts = ws.write(sources.select("source", "node", F.lit(0.0).alias("dist")).distinct(), "starts")
    graph, inner = _bypassed(ws, cheapest, starts)
    hot = hot_keys(ws, graph, "src", group_rows)
    frontier = ws.write(_best(starts, nearest), "dist")
    paths = [ws.path(frontier)]
    while ws.rows(frontier):
        known = _best(ws.spark.read.schema(frontier.schema).parquet(*paths), nearest)
        near = _relax(frontier, graph, hot)
        near = _best(near if cutoff is None else near.where(F.col("dist") <= cutoff), nearest)
        keys = ["node"] if nearest else ["source", "node"]
        old = known.select(*keys, F.col("dist").alias("old"), F.col("source").alias("old_source"))
        met = near.join(old if nearest else old.drop("old_source"), keys, "left")
        fell = F.col("old").isNull() | (F.col("dist") < F.col("old"))
        if nearest:
            fell = fell | ((F.col("dist") == F.col("old")) & (F.col("source") < F.col("old_source")))
        frontier = ws.write(met.where(fell).select("source", "node", "dist"), "dist")
        paths.append(ws.path(frontier))
    found = _best(ws.spark.read.schema(frontier.schema).parquet(*paths), nearest)
    if inner is None:
        return found
    onward = found.withColumnRenamed("node", "entry").join(inner, "entry")
    filled = onward.select("source", "node", (F.col("dist") + F.col("far")).alias("dist"))
    return found.unionByName(filled if cutoff is None else filled.where(F.col("dist") <= cutoff))


def _best(reached: DataFrame, nearest: bool) -> DataFrame:
    """The least distance of a node from each source, or from the nearest."""
    if not nearest:
        return reached.groupBy("source", "node").agg(F.min("dist").alias("dist")).select("source", "node", "dist")
    first = reached.groupBy("node").agg(F.min(F.struct("dist", "source")).alias("first"))
    return first.select("first.source", "node", "first.dist")


def _bypassed(ws: Workspace, cheapest: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The graph without nodes inside chains, and ``(node, entry, far)`` for these.

    A node inside a chain has one edge in and one out, and is no source.  Pointers to the node before are
    followed by doubling, until they leave the chain: there is the entry, the only way in.  Rings without
    an entry can't be reached.
    """
    nothing = F.lit(None)
    kinds = dict(cheapest.dtypes)
    ends = F.array(
        F.struct(F.col("src").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in"), F.col("dst").alias("next"), F.col("w").alias("w_next"),
                 nothing.cast(kinds["src"]).alias("prev"), nothing.cast(kinds["w"]).alias("w_prev")),
        F.struct(F.col("dst").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in"), nothing.cast(kinds["dst"]).alias("next"), nothing.cast(kinds["w"]).alias("w_next"),
                 F.col("src").alias("prev"), F.col("w").alias("w_prev")),
    )
    nodes = cheapest.select(F.inline(ends)).groupBy("node").agg(
        F.sum("out").alias("out"), F.sum("in").alias("in"), *[F.max(c).alias(c) for c in ("next", "w_next", "prev", "w_prev")]
    )
    inside = ws.write(nodes.where("out = 1 AND in = 1").join(starts.select("node").distinct(), "node", "left_anti"), "inside")
    if not ws.rows(inside):
        return cheapest, None
    names = inside.select(F.col("node").alias("_node"), F.lit(True).alias("is_inside"))
    back = inside.select("node", F.col("prev").alias("entry"), F.col("w_prev").cast("double").alias("far"))
    marked = back.join(names, F.col("entry") == F.col("_node"), "left").drop("_node").withColumn("open", F.coalesce("is_inside", F.lit(False)))
    back = ws.write(marked.select("node", "entry", "far", "open"), "back", open="open")
    for _ in range(ws.rows(inside).bit_length() + 1):
        if not ws.count(back, "open"):
            break
        step = back.select(F.col("node").alias("_node"), F.col("entry").alias("_entry"), F.col("far").alias("_far"), F.col("open").alias("_open"))
        moved = back.where("open").join(step, F.col("entry") == F.col("_node")).select(
            "node", F.col("_entry").alias("entry"), (F.col("far") + F.col("_far")).alias("far"), F.col("_open").alias("open")
        )
        back = ws.write(back.where("NOT open").unionByName(moved), "back", open="open")
    inner = back.where("NOT open").select("node", "entry", "far")
    leaving = inside.join(names, F.col("next") == F.col("_node"), "left_anti").select("node", "next", "w_next")
    shortcuts = inner.join(leaving, "node").select(
        F.col("entry").alias("src"), F.col("next").alias("dst"), (F.col("far") + F.col("w_next")).alias("w")
    )
    kept = cheapest
    for end in ("src", "dst"):
        kept = kept.join(names, F.col(end) == F.col("_node"), "left_anti")
    both = kept.withColumn("w", F.col("w").cast("double")).unionByName(shortcuts.where("src <> dst"))
    return ws.write(both.groupBy("src", "dst").agg(F.min("w").alias("w")), "graph"), inner


def _relax(frontier: DataFrame, cheapest: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Candidate distances one edge further; hot nodes' edges are split over tasks."""
    if hot is None:
        reached = frontier.join(cheapest, frontier["node"] == cheapest["src"])
    else:
        marks = F.broadcast(hot.select(F.col("src").alias("_hot"), "slices"))
        slices = F.coalesce("slices", F.lit(1))
        edges = (
            cheapest.join(marks, cheapest["src"] == marks["_hot"], "left")
            .withColumn("_part", F.pmod(F.xxhash64("dst"), slices).cast("int"))
            .drop("_hot", "slices")
        )
        ends = (
            frontier.join(marks, frontier["node"] == marks["_hot"], "left")
            .withColumn("_front_part", F.explode(F.sequence(F.lit(0), slices - 1)))
            .drop("_hot", "slices")
        )
        reached = ends.join(
            edges, (ends["node"] == edges["src"]) & (ends["_front_part"] == edges["_part"])
        )
    return reached.select("source", F.col("dst").alias("node"), (F.col("dist") + F.col("w")).alias("dist"))


def risk_distances(
    ws: Workspace,
    accounts: DataFrame,
    links: DataFrame,
    edges: DataFrame,
    source_accounts: DataFrame,
    group_rows: int = GROUP_ROWS,
    cutoff: float | None = None,
    nearest: bool = False,
) -> DataFrame:
    """Contract entities, project the edges, and measure from the sources' entities.

    ``accounts`` and ``source_accounts`` have ``account``; ``links`` has ``a, b``;
    ``edges`` has ``src, dst, w``.  Returns ``(source, component, distance)``; see :func:`cheapest_distances`
    for ``cutoff`` and ``nearest``, which bound it.
    """
    members = ws.write(contract_entities(ws, accounts, links), "members")
    hot_src, hot_dst = (hot_keys(ws, edges, end, group_rows) for end in ("src", "dst"))
    between = project(edges, members, hot_src=hot_src, hot_dst=hot_dst)
    starts = source_accounts.join(members, "account").select(
        F.col("component").alias("source"), F.col("component").alias("node")
    )
    graph = between.select(F.col("cu").alias("src"), F.col("cv").alias("dst"), "w")
    found = cheapest_distances(ws, graph, starts, group_rows, cutoff, nearest)
    return found.select("source", F.col("node").alias("component"), F.col("dist").alias("distance"))
