"""Scores for the moments at which two components join.

Merges are the edges of the forest; their figures and their past come from the merge tree
(:mod:`ledgerweave.operators.mergetree`), so no component is replayed.  A run may start from
what earlier arrivals left (a :class:`Book`), which is how the streaming job uses it: the nodes
of its tree are then the components at the start.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.functions import scoring
from ledgerweave.functions.scoring import whole_weight
from ledgerweave.operators import mergetree as mt
from ledgerweave.operators.components import MergeForest, merge_forest
from ledgerweave.operators.ordering import running_sum
from ledgerweave.operators.skew import GROUP_ROWS, hot_keys, lookup
from ledgerweave.workspace import Workspace

SNAPSHOT = "array<struct<seq:bigint,distinct:double,out_hh:double,density:double>>"


@dataclass(frozen=True)
class Book:
    """What is known of the components after some number of arrivals."""

    members: DataFrame  # (account, component)
    stats: DataFrame  # (component, accounts, edges)
    history: DataFrame  # (component, history): the last snapshots, oldest first

    @staticmethod
    def empty(txn: DataFrame) -> "Book":
        kind = txn.schema["sender"].dataType.simpleString()
        new = txn.sparkSession.createDataFrame
        return Book(
            new([], f"account {kind}, component {kind}"),
            new([], f"component {kind}, accounts bigint, edges bigint"),
            new([], f"component {kind}, history {SNAPSHOT}"),
        )


def _placed(edges: DataFrame) -> DataFrame:
    """Edges with their chain in place of the list; those after their component's last merge have none."""
    needed = F.when(F.col("seq") <= F.col("last_seq"), mt.chain_at("seq"))
    return edges.withColumn("chain", needed).drop("steps", "last_seq")


def mark_merges(
    ws: Workspace,
    txn: DataFrame,
    forest: MergeForest,
    tree: mt.MergeTree,
    group_rows: int = GROUP_ROWS,
    to_the_end: bool = False,
) -> DataFrame:
    """Edges with ``merges`` (does it join two components), running outflow, and chain.

    Edges after their component's last merge tell nothing of a merge; they are left out before anything is summed,
    unless ``to_the_end``.  The marks of the forest are laid among the edges of both of its ends, so that
    outflow and marks come from one shuffle by sender.
    """
    hot = hot_keys(ws, txn, "sender", group_rows)
    weight = whole_weight(F.col("amount")).alias("weight")
    edges = txn.select("seq", "tnum", "sender", "receiver", "amount", weight, F.lit(False).alias("mark"))
    listed = lookup(edges, "sender", tree.places, "account", "seq", hot)
    if to_the_end:
        listed = listed.withColumn("last_seq", F.col("seq"))
    else:
        listed = listed.where("seq <= last_seq")
    marks = forest.seqs.select(
        "seq", F.explode(F.array("u", "v")).alias("sender"), F.lit(0).cast("long").alias("weight"), F.lit(True).alias("mark")
    )
    laid = _placed(listed).unionByName(marks, allowMissingColumns=True)
    summed = running_sum(laid, "sender", "seq", "weight", "out_hh", hot, group_rows)
    marked = summed.withColumn("merges", F.max("mark").over(Window.partitionBy("sender", "seq"))).where("NOT mark")
    return ws.write(marked.drop("mark", "weight"), "marked")


def flag(edges: DataFrame, forest: MergeForest) -> DataFrame:
    joins = forest.seqs.select("seq", F.lit(True).alias("merges"))
    return edges.join(joins, "seq", "left").withColumn("merges", F.coalesce("merges", F.lit(False)))


def at_start(ws: Workspace, edges: DataFrame, book: Book, group_rows: int) -> DataFrame:
    """Edges with the components of both ends before the first of them, ``a`` and ``b``."""
    for end, name in (("sender", "a"), ("receiver", "b")):
        known = book.members.withColumnRenamed("component", name)
        hot = hot_keys(ws, edges, end, group_rows)
        found = lookup(edges, end, known, "account", "seq", hot).withColumn(name, F.coalesce(name, end))
        edges = ws.know(found, edges)
    return edges


def _scored(
    ws: Workspace,
    marked: DataFrame,
    tree: mt.MergeTree,
    book: Book | None,
    depth: int,
    block: int,
    group_rows: int,
) -> DataFrame:
    """Merge events with figures, z values, score and level, as a table."""
    placed = ws.write(marked.where("chain IS NOT NULL").select("seq", "chain", "merges", "out_hh"), "placed")
    start = history = None
    if book is not None:
        start = book.stats.withColumnRenamed("component", "account")
        history = book.history.select(F.col("component").alias("account"), F.inline("history"))
    found = mt.figures(ws, placed, tree, start, group_rows)
    z = mt.standing(ws, found, tree, history, depth, block)
    s = scoring.score(F.col("z_distinct"), F.col("z_out_hh"), F.col("z_density"))
    rows = marked.where("merges").select("seq", "tnum", "sender", "receiver", "amount")
    events = rows.join(found, "seq").join(z, "seq").withColumn("s", s).withColumn("level", scoring.level(F.col("s")))
    return ws.write(
        events.select(
            "seq", "tnum", "sender", "receiver", "amount", "root", F.col("accounts").cast("double").alias("distinct"), "edges",
            F.col("out_hh").cast("double").alias("out_hh"), "density", *[f"z_{f}" for f in mt.FIELDS], "s", "level",
        ),
        "scored",
    )


def merge_scores(
    ws: Workspace,
    txn: DataFrame,
    forest: MergeForest | None = None,
    group_rows: int = GROUP_ROWS,
    depth: int = scoring.HISTORY_DEPTH,
    block: int = mt.BLOCK,
) -> DataFrame:
    """One row per merge event, in the state the merge leaves.

    Columns: ``seq, tnum, sender, receiver, amount, root, distinct, edges,
    out_hh, density, z_distinct, z_out_hh, z_density, s, level``.
    """
    forest = forest or merge_forest(ws, txn, group_rows=group_rows)
    tree = mt.merge_tree(ws, forest, group_rows)
    marked = mark_merges(ws, txn, forest, tree, group_rows)
    return _scored(ws, marked, tree, None, depth, block, group_rows)


def advance(
    ws: Workspace,
    marked: DataFrame,
    book: Book,
    forest: MergeForest,
    group_rows: int = GROUP_ROWS,
    depth: int = scoring.HISTORY_DEPTH,
    block: int = mt.BLOCK,
) -> tuple[DataFrame, Book]:
    """Score the merges among ``marked`` and bring the book up to date.

    ``marked`` have ``seq, tnum, sender, receiver, amount, out_hh, merges`` and the components ``a, b``
    of both ends at the start; ``forest`` joins these.
    """
    tree = mt.merge_tree(ws, forest, group_rows)
    hot = hot_keys(ws, marked, "a", group_rows)
    placed = ws.know(_placed(lookup(marked, "a", tree.places, "account", "seq", hot)), marked)
    scored = _scored(ws, placed, tree, book, depth, block, group_rows)
    return scored, _next_book(ws, marked, forest.members, scored, book, depth, group_rows)


def _next_book(
    ws: Workspace, edges: DataFrame, joined: DataFrame, scored: DataFrame, book: Book, depth: int, group_rows: int
) -> Book:
    """Members renamed, sizes and edges added, and the newest snapshots of what joined."""
    ends = F.array(
        F.struct(F.col("sender").alias("account"), F.col("a").alias("component"), F.lit(1).alias("sent")),
        F.struct(F.col("receiver").alias("account"), F.col("b").alias("component"), F.lit(0).alias("sent")),
    )
    touched = edges.select(F.inline(ends)).groupBy("account", "component").agg(F.sum("sent").alias("sent"))
    touched = ws.write(touched, "touched")
    newcomers = touched.join(book.members.select("account"), "account", "left_anti").select("account", "component")
    renamed = F.coalesce("grp", "component").alias("component")
    named = joined.select(F.col("account").alias("_a"), F.col("component").alias("grp"))
    known = book.members.union(newcomers)
    # A newcomer is a component of its own, so only earlier members can crowd one.
    hot = hot_keys(ws, book.members, "component", group_rows)
    members = lookup(known, "component", named, "_a", "account", hot).select("account", renamed)
    added = touched.groupBy("component").agg(F.sum("sent").alias("edges"))
    sizes = newcomers.groupBy("component").agg(F.count(F.lit(1)).alias("accounts"))
    grown = (
        book.stats.unionByName(added.withColumn("accounts", F.lit(0).cast("long")))
        .unionByName(sizes.withColumn("edges", F.lit(0).cast("long")))
    )
    stats = (
        grown.join(named, grown["component"] == named["_a"], "left")
        .groupBy(renamed)
        .agg(F.sum("accounts").alias("accounts"), F.sum("edges").alias("edges"))
    )
    fields = ["seq", *mt.FIELDS]
    grouped = named.withColumnRenamed("_a", "component")
    past = book.history.select("component", F.inline("history")).join(grouped, "component")
    fresh = scored.select(F.col("root").alias("component"), *fields).join(grouped, "component")
    kept = mt.newest_of(past.unionByName(fresh).select("grp", *fields), "grp", depth)
    folded = kept.groupBy(F.col("grp").alias("component")).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("history"))
    untouched = book.history.join(named.withColumnRenamed("_a", "component"), "component", "left_anti")
    return Book(
        ws.write(members, "members"), ws.write(stats, "stats"), ws.write(untouched.unionByName(folded), "history")
    )


def alerts(scored: DataFrame, min_level: str = "LOW") -> DataFrame:
    """Alert rows with the sink's columns, order and rounding."""
    levels = ["LOW", "MED", "HIGH"]
    wanted = levels[levels.index(min_level) :]
    return scored.where(F.col("level").isin(wanted)).select(
        F.col("tnum").alias("time"),
        F.col("root").cast("string").alias("root"),
        F.col("sender").cast("string").alias("src"),
        F.col("receiver").cast("string").alias("dst"),
        "amount",
        F.round("s", 4).alias("S"),
        "level",
        F.round("distinct", 3).alias("distinct"),
        F.round("out_hh", 3).alias("out_hh"),
        F.round("density", 6).alias("density"),
        F.round("z_distinct", 3).alias("z_distinct"),
        F.round("z_out_hh", 3).alias("z_out_hh"),
        F.round("z_density", 3).alias("z_density"),
    )
