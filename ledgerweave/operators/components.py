"""Connected components, entity contraction and merge events by graph contraction.

Each round every node points at one neighbour, pointers are followed to their
roots, and the edges are rewritten between roots.  Edges inside a root vanish and
parallel ones fold together, so the graph shrinks by a factor in each round and
a round costs a few shuffles of what is left.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.operators.skew import GROUP_ROWS, hot_keys, lookup
from ledgerweave.workspace import Workspace


def _both_ways(pairs: DataFrame, *extra: str) -> DataFrame:
    ends = F.array(
        F.struct(F.col("lo").alias("node"), F.col("hi").alias("other"), *extra),
        F.struct(F.col("hi").alias("node"), F.col("lo").alias("other"), *extra),
    )
    return pairs.select(F.inline(ends))


def _hop(ws: Workspace, parent: DataFrame, hops: int, group_rows: int) -> DataFrame:
    """``(node, parent, was)``: the pointer that many steps further, and the one before it."""
    step = parent.select(F.col("node").alias("_node"), F.col("parent").alias("next"))
    moved = parent
    for _ in range(hops):
        hot = hot_keys(ws, parent, "parent", group_rows) if hops == 1 else None
        far = lookup(moved, "parent", step, "_node", "node", hot, "inner")
        moved = far.select("node", F.col("parent").alias("was"), F.col("next").alias("parent"))
    return ws.write(moved, "parent", moved="parent <> was")


def _roots(ws: Workspace, parent: DataFrame, size: int, group_rows: int) -> DataFrame:
    """Replace each node's parent by the root of its pointer chain.

    Every job at least doubles the distance covered, so a chain of length d takes
    about log2(d) jobs.  Tables that fit one task take three hops per job, and the
    first job reads the pointers as they are computed.
    """
    hops = 3 if size <= group_rows else 1
    moved = _hop(ws, parent if hops > 1 else ws.write(parent, "parent"), hops, group_rows)
    while ws.count(moved, "moved"):
        further = _hop(ws, moved.select("node", "parent"), hops, group_rows)
        ws.drop(moved)
        moved = further
    return moved


def _rewrite(pairs: DataFrame, roots: DataFrame, hot: dict[str, DataFrame | None]) -> DataFrame:
    """Pairs between roots; pairs inside a root are gone."""
    one, two = (roots.select("node", F.col("parent").alias(end)) for end in ("a", "b"))
    lo = lookup(pairs, "lo", one, "node", "hi", hot["lo"])
    ends = lookup(lo, "hi", two, "node", "lo", hot["hi"])
    return ends.where("a <> b").drop("lo", "hi").select(
        F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), *_rest(pairs)
    )


def _rest(pairs: DataFrame) -> list[str]:
    return [c for c in pairs.columns if c not in ("lo", "hi")]


def _hot_ends(ws: Workspace, pairs: DataFrame, group_rows: int) -> dict[str, DataFrame | None]:
    return {end: hot_keys(ws, pairs, end, group_rows) for end in ("lo", "hi")}


def _compose(ws: Workspace, maps: list[DataFrame], group_rows: int) -> DataFrame:
    """``(account, root)`` from the rounds' maps, joined from the smallest upwards."""
    result = maps[-1].select("node", "parent")
    for earlier in reversed(maps[:-1]):
        upper = result.select(F.col("node").alias("_node"), F.col("parent").alias("root"))
        hot = hot_keys(ws, earlier, "parent", group_rows)
        result = lookup(earlier, "parent", upper, "_node", "node", hot).select(
            "node", F.coalesce("root", "parent").alias("parent")
        )
    return result.select(F.col("node").alias("account"), F.col("parent").alias("root"))


def components(
    ws: Workspace,
    edges: DataFrame,
    a: str = "sender",
    b: str = "receiver",
    group_rows: int = GROUP_ROWS,
    folded: bool = False,
) -> DataFrame:
    """``(account, component)`` for every end of an edge, direction ignored.

    ``folded`` says that ``edges`` is a written table with each pair once, the lesser end as ``a``.  The component is named after its smallest account.  Every node points at its
    smallest neighbour or itself, so the smallest account ends up as the root.
    """
    if folded:
        pairs = ws.know(edges.select(F.col(a).alias("lo"), F.col(b).alias("hi")), edges)
    else:
        pairs = ws.write(
            edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).distinct(), "pairs"
        )
    if ws.rows(pairs) == 0:
        return pairs.select(F.col("lo").alias("account"), F.col("lo").alias("component"))
    maps: list[DataFrame] = []
    while not maps or ws.rows(pairs):
        smallest = _both_ways(pairs).groupBy("node").agg(F.min("other").alias("other"))
        parent = smallest.select("node", F.least("node", "other").alias("parent"))
        roots = _roots(ws, parent, ws.rows(pairs), group_rows)
        maps.append(roots)
        shrunk = ws.write(
            _rewrite(pairs, roots, _hot_ends(ws, pairs, group_rows)).distinct(), "pairs"
        )
        ws.drop(pairs)
        pairs = shrunk
    return _compose(ws, maps, group_rows).withColumnRenamed("root", "component")


def contract_entities(
    ws: Workspace, accounts: DataFrame, links: DataFrame, a: str = "a", b: str = "b"
) -> DataFrame:
    """``(account, component)`` for all accounts, where links say "same entity"."""
    linked = ws.write(components(ws, links, a, b), "entities")
    return accounts.select("account").join(linked, "account", "left").select(
        "account", F.coalesce("component", "account").alias("component")
    )


@dataclass(frozen=True)
class MergeForest:
    """The edges that join two components, and the components they leave."""

    seqs: DataFrame  # (seq, u, v), the arrival number and the two ends
    members: DataFrame  # (account, component)
    # Per round of contraction: (node, seq), the edge each node took, and (node, parent), what it became part of.
    rounds: tuple[tuple[DataFrame, DataFrame], ...] = ()


def merge_forest(
    ws: Workspace,
    txn: DataFrame,
    a: str = "sender",
    b: str = "receiver",
    order: str = "seq",
    group_rows: int = GROUP_ROWS,
) -> MergeForest:
    """Edges that join two components when taken in the order of ``seq``.

    They are the minimum spanning forest for weight ``seq``, which is unique as
    arrival numbers do not repeat.  In each round every component takes its
    earliest outgoing edge, so at least half of the components disappear.
    """
    ends = txn.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), F.col(order).alias("seq"))
    everyone = ws.write(ends.groupBy("lo", "hi").agg(F.min("seq").alias("seq")), "pairs", joining="lo <> hi")
    # u and v keep the ends the edge had at first, while lo and hi are contracted.
    pairs = everyone.where("lo <> hi").select("lo", "hi", "seq", F.col("lo").alias("u"), F.col("hi").alias("v"))
    left = ws.count(everyone, "joining")
    chosen: list[DataFrame] = []
    maps: list[DataFrame] = []
    rounds: list[tuple[DataFrame, DataFrame]] = []
    while left:
        pick = _both_ways(pairs, "seq", "u", "v").groupBy("node").agg(*_first_of("other", "u", "v"))
        if left > group_rows:
            pick = ws.write(pick, "pick")
        # Two nodes that took the same edge point at each other: the smaller one is the root.
        back = pick.select(F.col("node").alias("back_node"), F.col("seq").alias("back_seq"))
        mutual = (F.col("seq") == F.col("back_seq")) & (F.col("node") < F.col("other"))
        hot = hot_keys(ws, pick, "other", group_rows) if left > group_rows else None
        faced = lookup(pick, "other", back, "back_node", "node", hot)
        parent = F.when(mutual, F.col("node")).otherwise(F.col("other")).alias("parent")
        pointers = ws.write(faced.select("node", "seq", "u", "v", parent), "pointers")
        roots = _roots(ws, pointers.select("node", "parent"), ws.rows(pointers), group_rows)
        chosen.append(pointers.select("seq", "u", "v"))
        maps.append(roots)
        rounds.append((pointers, roots))
        fewer = _rewrite(pairs, roots, _hot_ends(ws, pairs, group_rows))
        shrunk = ws.write(fewer.groupBy("lo", "hi").agg(*_first_of("u", "v")), "pairs")
        ws.drop(pairs)
        pairs, left = shrunk, ws.rows(shrunk)
    forest = _as_forest(ws, everyone, chosen, maps, group_rows)
    return MergeForest(forest.seqs, forest.members, tuple(rounds))


def _first_of(*columns: str) -> list[Column]:
    """The least ``seq`` of a group and what came with it."""
    return [F.min("seq").alias("seq"), *[F.min_by(c, "seq").alias(c) for c in columns]]


def _as_forest(
    ws: Workspace, everyone: DataFrame, chosen: list[DataFrame], maps: list[DataFrame], group_rows: int
) -> MergeForest:
    nodes = _both_ways(everyone).select(F.col("node").alias("account")).distinct()
    if not maps:
        alone = nodes.select("account", F.col("account").alias("component"))
        nothing = everyone.select("seq", F.col("lo").alias("u"), F.col("hi").alias("v")).limit(0)
        return MergeForest(nothing, alone)
    seqs = chosen[0]
    for more in chosen[1:]:
        seqs = seqs.union(more)
    linked = _compose(ws, maps, group_rows)
    hot = None
    if 2 * ws.rows(everyone) > group_rows:
        linked = ws.write(linked, "linked")
        hot = hot_keys(ws, linked, "root", group_rows)
    names = linked.groupBy("root").agg(F.min("account").alias("component"))
    named = lookup(linked, "root", names, "root", "account", hot).select("account", "component")
    members = nodes.join(named, "account", "left").select(
        "account", F.coalesce("component", "account").alias("component")
    )
    return MergeForest(ws.write(seqs.distinct(), "forest"), ws.write(members, "members"))


def tag(
    ws: Workspace, txn: DataFrame, members: DataFrame, end: str = "sender", group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Transactions with the component of one end."""
    hot = hot_keys(ws, txn, end, group_rows)
    return ws.know(lookup(txn, end, members, "account", "seq", hot), txn)


def project(
    edges: DataFrame,
    members: DataFrame,
    src: str = "src",
    dst: str = "dst",
    keep: tuple[str | Column, ...] = ("w",),
    hot_src: DataFrame | None = None,
    hot_dst: DataFrame | None = None,
) -> DataFrame:
    """Directed edges between components; parallel edges stay, internal ones go."""
    left = members.select(F.col("account").alias("_a"), F.col("component").alias("cu"))
    right = members.select(F.col("account").alias("_b"), F.col("component").alias("cv"))
    one = lookup(edges, src, left, "_a", dst, hot_src, "inner")
    both = lookup(one, dst, right, "_b", src, hot_dst, "inner")
    return both.where("cu <> cv").select("cu", "cv", *keep)
