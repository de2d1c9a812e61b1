"""The tree in which components join, as chains that need no replay.

Every merge makes a node whose children are the two components it joins.  The rounds of the
merge forest cut this tree into chains.  In round r every node V of the contracted graph takes
its earliest outgoing edge; call its arrival number the exit of V.  The chain of V holds the
merges inside V that come before its exit and after the exit of every part of V they lie in.
These merges are nested: each one's component holds that of the one before.  At its exit the
chain's component joins that of a chain of a later round.  So

* at any time an account lies in the component of one chain: the first of the nodes around it,
  from round 0 on, whose exit lies later;
* an account passes through at most one chain a round, so at most log2(accounts) of them; the
  list is written beside the account, and an edge's chain is found by one join with its sender;
* size, edges and smallest account of a merge are running sums along its chain, of the edges
  there and of what enters at each merge;
* the last snapshots before a merge are among the last of its chain and the last of each chain
  that enters within that reach, so a chain can be cut in blocks that overlap by that many.

No step holds a component: accounts, edges and merges are rows throughout, a chain of any length is
summed in slices and scored in blocks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.functions import scoring
from ledgerweave.operators.components import MergeForest
from ledgerweave.operators.ordering import running
from ledgerweave.operators.skew import GROUP_ROWS, hot_keys, lookup
from ledgerweave.workspace import Workspace

#: Merges of one chain that are scored in one go.
BLOCK = 65_536
FIELDS = ["distinct", "out_hh", "density"]

LIGHT, OWN = 0, 1


@dataclass(frozen=True)
class MergeTree:
    """``steps`` are the chains passed through, each with the arrival number at which it is left (null: never)."""

    places: DataFrame  # (account, steps, last_seq), the last being that of the component's last merge
    chains: DataFrame  # (chain, steps) of chains that are left some time, beginning with the chain itself


def _name(level: int, node: str) -> Column:
    return F.concat(F.lit(f"{level}:"), F.col(node).cast("string"))


def merge_tree(ws: Workspace, forest: MergeForest, group_rows: int = GROUP_ROWS) -> MergeTree:
    """The chains, from the last round of the forest down to the accounts.

    Rounds halve the nodes, so all lists together are about twice as many as accounts.  Accounts without
    a merge have no place.
    """
    above: DataFrame | None = None
    lists: list[DataFrame] = []
    for level in reversed(range(len(forest.rounds))):
        taken, parts = forest.rounds[level]
        joined = taken.select("node", "seq").join(parts.select("node", F.col("parent").alias("root")), "node")
        top = F.array(F.struct(_name(level + 1, "root").alias("chain"), F.lit(None).cast("long").alias("until")))
        if above is None:
            known = joined.withColumn("rest", top)
        else:
            hot = hot_keys(ws, parts, "parent", group_rows)
            hot = None if hot is None else hot.withColumnRenamed("parent", "root")
            rest = above.select("node", F.col("steps").alias("rest"))
            known = lookup(joined, "root", rest, "node", "node", hot).withColumn("rest", F.coalesce("rest", top))
        own = F.array(F.struct(_name(level, "node").alias("chain"), F.col("seq").alias("until")))
        later = F.filter("rest", lambda s: s["until"].isNull() | (s["until"] > F.col("seq")))
        above = ws.write(known.select("node", F.concat(own, later).alias("steps")), "steps")
        lists.append(above)
    if above is None:
        kind = forest.members.schema["account"].dataType.simpleString()
        steps = "steps array<struct<chain: string, until: bigint>>"
        new = ws.spark.createDataFrame
        return MergeTree(new([], f"account {kind}, {steps}, last_seq bigint"), new([], f"chain string, {steps}"))
    chains = lists[0]
    for more in lists[1:]:
        chains = chains.union(more)
    # The last to enter the last chain does so by the component's last merge.
    ended = ws.know(
        above.select(F.col("node").alias("account"), "steps", F.element_at("steps", -1)["chain"].alias("top")), above
    )
    newest = ended.groupBy("top").agg(F.max(F.element_at("steps", -2)["until"]).alias("last_seq"))
    placed = lookup(ended, "top", newest, "top", "account", hot_keys(ws, ended, "top", group_rows))
    return MergeTree(
        ws.write(placed.select("account", "steps", "last_seq"), "places"),
        chains.select(F.get("steps", F.lit(0))["chain"].alias("chain"), "steps"),
    )


def chain_at(seq: str) -> Column:
    """The chain in whose component the holder of ``steps`` lies right after ``seq``."""
    return F.get(F.filter("steps", lambda s: s["until"].isNull() | (s["until"] > F.col(seq))), F.lit(0))["chain"]


def entered() -> Column:
    """Arrival numbers of the merges at which the holder of ``steps`` goes over to another chain."""
    return F.transform(F.slice("steps", F.lit(1), F.size("steps") - 1), lambda s: s["until"])


def along_chains(
    ws: Workspace, placed: DataFrame, tree: MergeTree, start: DataFrame | None = None, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """``placed`` with the component's state after each edge: ``root, accounts, edges``, and ``at``, the merges of the chain so far.

    ``placed`` has ``(seq, chain, merges)`` of all edges up to the last that matters.  ``start`` may say how many accounts and edges a node begins with, as ``(account, accounts, edges)``; the
    rest begin with one account and no edge.
    """
    begun = tree.places.select("account", entered().alias("entered"))
    if start is None:
        begun = begun.select("*", F.lit(1).cast("long").alias("accounts"), F.lit(0).cast("long").alias("edges"))
    else:
        begun = begun.join(start, "account", "left")
    begun = begun.select(
        F.explode("entered").alias("seq"), F.coalesce("accounts", F.lit(1)).alias("accounts"),
        F.coalesce("edges", F.lit(0)).alias("edges"), F.col("account").alias("root"),
    )
    totals = placed.groupBy("chain").agg(F.count(F.lit(1)).alias("edges"))
    nobody = F.lit(None).cast(begun.schema["root"].dataType).alias("root")
    brought = totals.join(tree.chains, "chain").select(
        F.explode(entered()).alias("seq"), F.lit(0).cast("long").alias("accounts"), "edges", nobody
    )
    entering = begun.unionByName(brought).groupBy("seq").agg(
        F.sum("accounts").alias("new_accounts"), F.sum("edges").alias("new_edges"), F.min("root").alias("new_root")
    )
    hot = hot_keys(ws, placed, "chain", group_rows)
    # Along a chain every row is an edge of the component, and every merge brings in what enters there.
    return running(
        placed.join(entering, "seq", "left"),
        "chain",
        "seq",
        {"at": F.col("merges").cast("long"), "edges": F.lit(1) + F.coalesce("new_edges", F.lit(0)), "accounts": F.col("new_accounts")},
        {"root": F.col("new_root")},
        hot,
        group_rows,
    ).drop("new_accounts", "new_edges", "new_root")


def figures(
    ws: Workspace, placed: DataFrame, tree: MergeTree, start: DataFrame | None = None, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Per merge: ``seq, chain, at`` (its number in the chain), ``root, accounts, edges, out_hh, density``.

    ``placed`` has ``out_hh`` too; see :func:`along_chains`.
    """
    found = along_chains(ws, placed, tree, start, group_rows).where("merges").select(
        "seq", "chain", "at", "root", "accounts", "edges", "out_hh", scoring.density(F.col("edges"), F.col("accounts")).alias("density")
    )
    return ws.write(found, "figures")


def snapshots(found: DataFrame) -> DataFrame:
    """What the history keeps of a merge."""
    return found.select(
        "chain", "at", "seq", F.col("accounts").cast("double").alias("distinct"), F.col("out_hh").cast("double").alias("out_hh"), "density"
    )


def newest_of(rows: DataFrame, key: str, depth: int) -> DataFrame:
    """At most ``depth`` rows of each key; Spark limits groups before it shuffles them."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("seq")))
    return rows.withColumn("_n", rank).where(F.col("_n") <= depth).drop("_n")


def standing(
    ws: Workspace,
    found: DataFrame,
    tree: MergeTree,
    history: DataFrame | None = None,
    depth: int = scoring.HISTORY_DEPTH,
    block: int = BLOCK,
) -> DataFrame:
    """``(seq, z_distinct, z_out_hh, z_density)``: each merge against the last ``depth`` of its two components.

    ``history`` may bring earlier snapshots of a node, as ``(account, seq, distinct, out_hh, density)``.
    """
    own = snapshots(found)
    fields = ["seq", *FIELDS]
    late = newest_of(own, "chain", depth).join(tree.chains.where("size(steps) > 1"), "chain")
    light = late.select(F.explode(entered()).alias("enters"), *fields)
    if history is not None:
        earlier = history.join(tree.places.select("account", "steps"), "account")
        light = light.unionByName(earlier.select(F.explode(entered()).alias("enters"), *fields))
    met = newest_of(light, "enters", depth).join(
        found.select(F.col("seq").alias("enters"), "chain", "at"), "enters"
    )
    items = own.select("chain", "at", F.lit(OWN).alias("kind"), *fields).unionByName(
        met.select("chain", "at", F.lit(LIGHT).alias("kind"), *fields)
    )
    # Later merges of the chain push out what lies ``depth`` of them back, so blocks need no longer memory.
    home = F.floor(F.col("at") / block)
    reach = F.sequence(home, F.floor((F.col("at") + depth) / block))
    blocks = items.withColumn("home", home).withColumn("block", F.explode(reach))
    # Beyond the chain's end nobody looks.
    longest = found.groupBy("chain").agg(F.max("at").alias("long"))
    used = blocks.where("block = home").unionByName(
        blocks.where("block > home").join(longest, "chain").where(F.col("block") <= F.floor(F.col("long") / block)).drop("long")
    )
    ordered = used.repartition("chain", "block").sortWithinPartitions("chain", "block", "at", "kind", "seq")
    rows = ordered.select("chain", "block", (F.col("block") == F.col("home")).alias("here"), "kind", *fields)
    return rows.mapInPandas(_against_past(depth), "seq long, " + ", ".join(f"z_{f} double" for f in FIELDS))


class _Past:
    """The newest snapshots seen, at most ``depth``, in order of arrival."""

    def __init__(self, depth: int):
        self.depth = depth
        self.rows = np.empty((4 * depth + 4, 1 + len(FIELDS)))
        self.low = self.high = 0

    def add(self, row: np.ndarray) -> None:
        if self.high == len(self.rows):
            kept = self.rows[self.low : self.high].copy()
            self.low, self.high = 0, len(kept)
            self.rows[: self.high] = kept
        at = self.high
        if at > self.low and self.rows[at - 1, 0] > row[0]:
            at = self.low + int(np.searchsorted(self.rows[self.low : self.high, 0], row[0]))
            self.rows[at + 1 : self.high + 1] = self.rows[at : self.high].copy()
        self.rows[at] = row
        self.high += 1
        self.low = max(self.low, self.high - self.depth)

    def z(self, now: np.ndarray) -> np.ndarray:
        series = self.rows[self.low : self.high, 1:]
        if not len(series):
            return np.zeros(len(FIELDS))
        middle = len(series) // 2
        median = np.sort(series, axis=0)[middle]
        mad = np.sort(np.abs(series - median), axis=0)[middle]
        return (now - median) / np.maximum(scoring.MAD_FACTOR * mad, scoring.MIN_SCALE)


def _against_past(depth: int):
    """For ``mapInPandas`` over rows sorted by chain, block, place and kind; holds ``depth`` snapshots."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, past = None, _Past(depth)
        for batch in batches:
            values = batch[["seq", *FIELDS]].to_numpy(dtype=np.float64)
            scored, z = [], []
            for i, (chain, block, here, kind) in enumerate(
                zip(batch["chain"], batch["block"].tolist(), batch["here"].tolist(), batch["kind"].tolist())
            ):
                if (chain, block) != current:
                    current, past = (chain, block), _Past(depth)
                if kind == OWN and here:
                    scored.append(i)
                    z.append(past.z(values[i, 1:]))
                past.add(values[i])
            made = np.array(z).reshape(-1, len(FIELDS))
            frame = {"seq": batch["seq"].to_numpy()[scored]}
            yield pd.DataFrame(frame | {f"z_{f}": made[:, j] for j, f in enumerate(FIELDS)})

    return run
