"""Blocks inside a sliding window of transfers, kept by a stream without recomputing them.

The recency of a pair of accounts is the arrival number up to which the pair is linked in every
window that reaches back that far: the smaller of the latest numbers of its two directions where
both are asked for, else the larger.  The stream keeps the maximum spanning forest of recency.
Two accounts share a block of a window just if forest edges within the window join them, as an
edge left out closes a cycle of later ones.  So a link that expires is a filter, and a block that
falls apart needs no search for another way.

A recency only rises.  A batch therefore replaces the forest by that of its edges and of the pairs
the batch has raised: fewer rows than accounts, whatever the window holds.  The latest numbers of
pairs are a log like that of :mod:`ledgerweave.streaming.ledger`, folded every ``compact_every``
batches, when pairs older than the longest window are left out.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerweave.operators.components import components, merge_forest
from ledgerweave.operators.ordering import number_rows
from ledgerweave.operators.skew import GROUP_ROWS
from ledgerweave.workspace import Workspace, delete, is_there

#: Columns of the state tables; {id} is the type of accounts.
PAIRS = "lo {id}, hi {id}, up bigint, down bigint"
FOREST = "lo {id}, hi {id}, recency bigint"
ENTRY = "last bigint, base bigint, id string, part string"

#: Fixed value: transfers looked back on.
WINDOW_EDGES = 2_000_000


@dataclass(frozen=True)
class Kept:
    """What a version consists of."""

    last: int  # the arrival number of the last transfer
    base: int  # the version whose table of pairs is full, or -1
    id: str  # type of the accounts
    parts: dict[int, str]  # folders by version, from the base on

    @property
    def newest(self) -> str:
        return self.parts[max(self.parts)]


class RecentBlocks:
    """Versioned forest of recency in a shared folder."""

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        mutual: bool = True,
        window_edges: int = WINDOW_EDGES,
        compact_every: int = 8,
        group_rows: int = GROUP_ROWS,
    ):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.mutual = mutual
        self.window_edges = window_edges
        self.compact_every = compact_every
        self.group_rows = group_rows

    def start(self, edges: DataFrame, checkpoint: str) -> StreamingQuery:
        """Take what a stream of ``(tnum, sender, receiver, amount)`` holds, and end."""
        writer = edges.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        return writer.trigger(availableNow=True).start()

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Advance from version ``batch_id - 1`` to ``batch_id``; a repeated batch replaces its version."""
        ws = Workspace(self.spark, f"recent-{batch_id}")
        before = self._version(batch_id - 1, batch.schema["sender"].dataType.simpleString())
        arrived = ws.write(batch.select("tnum", "sender", "receiver", "amount"), "batch")
        # Self loops link nothing, but count as transfers of the window.
        numbered = number_rows(ws, arrived, [F.col("tnum").asc_nulls_last(), "sender", "receiver", "amount"])
        seq = F.col("seq") + before.last
        last = before.last + ws.rows(arrived)
        up = F.max(F.when(F.col("sender") < F.col("receiver"), seq)).alias("up")
        down = F.max(F.when(F.col("sender") > F.col("receiver"), seq)).alias("down")
        ends = [F.least("sender", "receiver").alias("lo"), F.greatest("sender", "receiver").alias("hi")]
        touched = ws.write(numbered.where("sender <> receiver").groupBy(*ends).agg(up, down), "touched")
        earlier = self._pairs(before).join(touched.select("lo", "hi"), ["lo", "hi"], "left_semi")
        raised = ws.write(_latest(touched.unionByName(earlier)), "raised")
        recency = self._recency()
        offered = raised.select("lo", "hi", recency.alias("recency")).where("recency IS NOT NULL")
        known = self._forest(before).join(touched.select("lo", "hi"), ["lo", "hi"], "left_anti")
        alive = known.unionByName(offered).where(F.col("recency") > last - self.window_edges)
        candidates = ws.write(alive.withColumn("late", -F.col("recency")), "candidates")
        forest = merge_forest(ws, candidates, "lo", "hi", "late", self.group_rows).seqs

        part = f"{self.folder}/parts/v={batch_id}-{uuid.uuid4().hex}"
        forest.select(F.col("u").alias("lo"), F.col("v").alias("hi"), (-F.col("seq")).alias("recency")).write.parquet(f"{part}/forest")
        base = before.base
        if base < 0 or (batch_id + 1) % self.compact_every == 0:
            base = batch_id
            whole = _latest(self._pairs(before).unionByName(touched))
            whole.where(F.greatest("up", "down") > last - self.window_edges).write.parquet(f"{part}/pairs")
        else:
            raised.write.parquet(f"{part}/pairs")
        entry = self.spark.createDataFrame([(last, base, before.id, part)], ENTRY)
        entry.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/versions/v={batch_id}")
        self._forget(batch_id)
        ws.close()

    def forest(self, version: int, window_edges: int | None = None) -> DataFrame:
        """``(lo, hi, recency)``: the forest edges of the last transfers up to a version."""
        kept = self._version(version)
        return self._forest(kept).where(F.col("recency") > kept.last - self._window(window_edges))

    def blocks(self, ws: Workspace, version: int, window_edges: int | None = None) -> DataFrame:
        """``(account, block)`` among the last ``window_edges`` transfers up to a version.

        A window may be any up to the longest one, which is that of the class.
        """
        linked = ws.write(self.forest(version, window_edges), "linked")
        return components(ws, linked, "lo", "hi", self.group_rows).withColumnRenamed("component", "block")

    def _window(self, asked: int | None) -> int:
        if asked is not None and asked > self.window_edges:
            raise ValueError(f"a window of {asked} is longer than what is kept, {self.window_edges}")
        return self.window_edges if asked is None else asked

    def _recency(self):
        if self.mutual:  # null while one direction is missing; least() would skip the null
            return F.when(F.col("up").isNotNull() & F.col("down").isNotNull(), F.least("up", "down"))
        return F.greatest("up", "down")

    def _pairs(self, kept: Kept) -> DataFrame:
        return self._read([f"{p}/pairs" for p in kept.parts.values()], PAIRS.format(id=kept.id))

    def _forest(self, kept: Kept) -> DataFrame:
        return self._read([f"{kept.newest}/forest"] if kept.parts else [], FOREST.format(id=kept.id))

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _version(self, number: int, id: str = "bigint") -> Kept:
        if number < 0:
            return Kept(0, -1, id, {})
        entries = self._entries(number)
        entry = entries[number]
        return Kept(entry["last"], entry["base"], entry["id"], {v: e["part"] for v, e in sorted(entries.items()) if v >= entry["base"]})

    def _entries(self, upto: int) -> dict[int, dict]:
        """One small row per version."""
        rows = self.spark.read.schema(ENTRY + ", v int").parquet(f"{self.folder}/versions").where(F.col("v") <= upto).collect()
        return {r["v"]: r.asDict() for r in rows}

    def _forget(self, number: int) -> None:
        """Remove tables of pairs that a repeat of this batch no longer reads."""
        entries = self._entries(number)
        before = entries.get(number - 1)
        for v, entry in entries.items():
            if before and v < before["base"] and is_there(self.spark, f"{entry['part']}/pairs"):
                delete(self.spark, f"{entry['part']}/pairs")


def _latest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("lo", "hi").agg(F.max("up").alias("up"), F.max("down").alias("down"))
