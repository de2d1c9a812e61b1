"""Component state kept up to date by a stream of transfers.

State is a log.  Micro-batch ``b`` reads version ``b - 1`` and writes what it changed: accounts
seen first, components that took another's name, and the figures of components and senders it
touched.  Every ``compact_every`` batches the log is folded into full tables.  Reading a version
takes the last full tables and the changes since; a batch looks up the accounts and components it
touches and rewrites nothing else.

A version counts once its entry is there, a single small file written last, which names the
parts that belong to it.  A repeated batch reads the same version, writes parts of its own and
replaces the entry, so nothing is counted twice and a reader never sees half a batch.

With a ``lag`` transfers are held back until none earlier is expected, and applied in order of
time; :meth:`Ledger.drain` applies what is still held.

Every transfer applied is kept, unless ``window_edges`` says how many of the latest are.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ledgerweave.functions.scoring import HIGH_THRESHOLD, whole_weight
from ledgerweave.operators import merges
from ledgerweave.operators.components import MergeForest, merge_forest
from ledgerweave.operators.ordering import number_rows
from ledgerweave.operators.refine import Refined, refine
from ledgerweave.operators.skew import GROUP_ROWS, hot_keys, lookup
from ledgerweave.operators.stats import running_outflow
from ledgerweave.sources.sinks import write_alerts
from ledgerweave.workspace import Workspace, delete, is_file, is_there

#: Columns of the state tables; {id} is the type of accounts.
STATE = {
    "members": "account {id}, component {id}, v bigint",
    "names": "old {id}, new {id}",
    "stats": "component {id}, accounts bigint, edges bigint, v bigint",
    "history": "component {id}, history " + merges.SNAPSHOT + ", v bigint",
    "flow": "account {id}, outflow bigint",
    "held": "tnum double, sender {id}, receiver {id}, amount double",
}
ENTRY = "last bigint, base bigint, frontier double, id string, part string"


def edge_stream(spark: SparkSession, path: str, schema: T.StructType | str, files_per_batch: int = 1000) -> DataFrame:
    """Transfers from a folder of Parquet files as they appear there; the path may also be that of a single file."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if is_file(spark, path):
        # The source watches folders, so a file is picked out of its own.
        folder, name = path.rstrip("/").rsplit("/", 1)
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


@dataclass(frozen=True)
class Version:
    """The state after a micro-batch, as lazy reads of its parts."""

    spark: SparkSession
    folder: str
    number: int
    last: int  # the arrival number of the last transfer applied
    base: int  # the version whose tables are full, or -1
    frontier: float | None  # transfers up to this time have been applied
    id: str  # type of the accounts
    parts: dict[int, str]  # folders of the parts, by version, from the base on

    def table(self, kind: str) -> DataFrame:
        """All rows of a kind since the base; of names and held transfers the newest table is whole."""
        versions = [self.number] if kind in ("names", "held") else sorted(self.parts)
        paths = [f"{self.parts[v]}/{kind}" for v in versions if v in self.parts]
        schema = STATE[kind].format(id=self.id)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def renamed(self, table: DataFrame) -> DataFrame:
        """``component`` by its present name."""
        names = self.table("names").withColumnRenamed("old", "component")
        return table.join(names, "component", "left").withColumn("component", F.coalesce("new", "component")).drop("new")

    def newest(self, kind: str, wanted: DataFrame | None = None) -> DataFrame:
        """The latest row of each component still there, or of those wanted."""
        rows = self.table(kind)
        if wanted is not None:
            rows = rows.join(wanted, "component", "left_semi")
        else:
            rows = rows.join(self.table("names").select(F.col("old").alias("component")), "component", "left_anti")
        newest = F.row_number().over(Window.partitionBy("component").orderBy(F.desc("v")))
        return rows.withColumn("_n", newest).where("_n = 1").drop("_n", "v")

    def members(self, wanted: DataFrame | None = None) -> DataFrame:
        rows = self.table("members").select("account", "component")
        rows = rows if wanted is None else rows.join(wanted, "account", "left_semi")
        return self.renamed(rows).select("account", "component")

    def flow(self, wanted: DataFrame | None = None) -> DataFrame:
        rows = self.table("flow")
        rows = rows if wanted is None else rows.join(wanted, "account", "left_semi")
        return rows.groupBy("account").agg(F.sum("outflow").alias("outflow"))

    def book(self) -> merges.Book:
        return merges.Book(self.members(), self.newest("stats"), self.newest("history"))


class Ledger:
    """Versioned component state in a shared folder."""

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        refine_on_high: bool = False,
        window_edges: int | None = None,
        component_edges: int | None = None,
        group_rows: int = GROUP_ROWS,
        csv_folder: str | None = None,
        lag: float | None = None,
        compact_every: int = 8,
    ):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.refine_on_high = refine_on_high
        self.window_edges, self.component_edges = window_edges, component_edges
        self.group_rows = group_rows
        self.csv_folder = csv_folder
        self.lag = lag
        self.compact_every = compact_every

    def start(self, edges: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        """Feed ``(tnum, sender, receiver, amount)`` from a stream.

        With ``available_now`` the query takes what is there, in as many
        micro-batches as the source is set to, and ends.
        """
        writer = edges.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Advance from version ``batch_id - 1`` to ``batch_id``."""
        self._advance(batch, batch_id, self.lag)

    def drain(self, version: int) -> int:
        """Apply what is held back at a version, as the next one, and return its number.

        A stream that goes on writes that version anew, from the one before, as if it had not been drained.
        """
        nothing = self.version(version).table("held").where("false")
        self._advance(nothing, version + 1, None)
        return version + 1

    def _advance(self, batch: DataFrame, number: int, lag: float | None) -> None:
        ws = Workspace(self.spark, f"batch-{number}")
        before = self.version(number - 1, batch.schema["sender"].dataType.simpleString())
        columns = ["tnum", "sender", "receiver", "amount"]
        pool = ws.write(before.table("held").select(columns).union(batch.select(columns)), "pool")
        released, held, frontier = self._released(pool, lag, before.frontier)
        order = [F.col("tnum").asc_nulls_last(), "sender", "receiver", "amount"]
        numbered = number_rows(ws, released, order)
        arrived = numbered.withColumn("seq", F.col("seq") + before.last)
        timed = ws.write(arrived.withColumn("tnum", F.coalesce("tnum", (F.col("seq") - 1).cast("double"))), "timed")
        last = before.last + ws.rows(timed)

        ends = timed.select(F.explode(F.array("sender", "receiver")).alias("account")).distinct()
        known = ws.write(before.members(ends), "known")
        touched = known.select("component").distinct()
        book = merges.Book(known, ws.write(before.newest("stats", touched), "stats"), ws.write(before.newest("history", touched), "history"))
        edges = ws.write(merges.at_start(ws, timed, book, self.group_rows), "edges")
        forest = merge_forest(ws, edges, "a", "b", group_rows=self.group_rows)
        senders = timed.select(F.col("sender").alias("account")).distinct()
        marked = self._marked(ws, edges, before.flow(senders), forest)
        scored, after = merges.advance(ws, marked, book, forest, self.group_rows)

        part = f"{self.folder}/parts/v={number}-{uuid.uuid4().hex}"
        changed = forest.members.where("account <> component").select(F.col("account").alias("old"), F.col("component").alias("new"))
        changed = changed.join(touched.withColumnRenamed("component", "old"), "old", "left_semi")
        earlier = before.table("names").join(changed.select(F.col("old").alias("new"), F.col("new").alias("_now")), "new", "left")
        names = earlier.select("old", F.coalesce("_now", "new").alias("new")).union(changed)
        flow = edges.groupBy(F.col("sender").alias("account")).agg(F.sum(whole_weight(F.col("amount"))).alias("outflow"))
        v = F.lit(number).cast("long").alias("v")
        written = {
            "members": after.members.join(known, "account", "left_anti").select("account", "component", v),
            "names": names,
            "stats": after.stats.select("component", "accounts", "edges", v),
            "history": after.history.select("component", "history", v),
            "flow": flow,
            "held": held,
            "edges": timed.select("seq", *columns),
            "alerts": merges.alerts(scored),
        }
        for kind, table in written.items():
            table.write.parquet(f"{part}/{kind}")
        now = Version(self.spark, self.folder, number, last, before.base, frontier, before.id, before.parts | {number: part})
        now = self._folded(ws, now, scored)
        if self.csv_folder:
            write_alerts(self.spark.read.parquet(f"{part}/alerts"), f"{self.csv_folder}/batch={number}")
        entry = self.spark.createDataFrame([(last, now.base, frontier, now.id, now.parts[number])], ENTRY)
        entry.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/versions/v={number}")
        self._forget(now)
        ws.close()

    def _released(self, pool: DataFrame, lag: float | None, frontier: float | None):
        """Transfers to apply now, those held back, and the time up to which they are applied.

        A transfer earlier than that time comes late and is applied with the next; so is one without a time.
        """
        if lag is None:
            return pool, pool.where("false"), frontier
        newest = pool.agg(F.max("tnum")).first()[0]
        reached = [t for t in (frontier, None if newest is None else newest - lag) if t is not None]
        frontier = max(reached, default=None)
        late = F.col("tnum").isNull() | (F.col("tnum") <= F.lit(frontier))
        return pool.where(late), pool.where(~F.coalesce(late, F.lit(False))), frontier

    def _marked(self, ws: Workspace, edges: DataFrame, flow: DataFrame, forest: MergeForest) -> DataFrame:
        """Edges with the sender's outflow so far and whether they join two components."""
        hot = hot_keys(ws, edges, "sender", self.group_rows)
        here = running_outflow(edges, hot)
        total = lookup(here, "sender", flow, "account", "seq", hot).withColumn(
            "out_hh", F.col("out_hh") + F.coalesce("outflow", F.lit(0))
        )
        return ws.write(merges.flag(total.drop("outflow"), forest), "marked")

    def _folded(self, ws: Workspace, now: Version, scored: DataFrame) -> Version:
        """The version itself, or one with full tables if it is time, or if components were split."""
        flagged = None
        if self.refine_on_high:
            high = scored.where(F.col("s") >= HIGH_THRESHOLD).select(F.col("root").alias("account"))
            flagged = ws.write(now.members(high).select("component").distinct(), "flagged")
        split = flagged is not None and ws.rows(flagged) > 0
        if not split and (now.number + 1) % self.compact_every:
            return now
        book = now.book()
        if split:
            book = merges.Book(ws.write(book.members, "members"), ws.write(book.stats, "stats"), ws.write(book.history, "history"))
            parts = refine(ws, self._window(now), book.members, flagged, self.window_edges, self.component_edges, self.group_rows)
            book = self._replaced(ws, book, flagged, parts)
        full = f"{now.parts[now.number]}-full"
        v = F.lit(now.number).cast("long").alias("v")
        empty = now.table("names").where("false")
        whole = {
            "members": book.members.select("account", "component", v), "names": empty, "held": now.table("held"),
            "stats": book.stats.select("component", "accounts", "edges", v), "history": book.history.select("component", "history", v),
            "flow": now.flow(),
        }
        for kind, table in whole.items():
            table.write.parquet(f"{full}/{kind}")
        for kind in ("edges", "alerts"):
            self.spark.read.parquet(f"{now.parts[now.number]}/{kind}").write.parquet(f"{full}/{kind}")
        return Version(now.spark, now.folder, now.number, now.last, now.number, now.frontier, now.id, {now.number: full})

    def _replaced(self, ws: Workspace, book: merges.Book, flagged: DataFrame, split: Refined) -> merges.Book:
        """Components taken apart into their blocks; an account outside all blocks stays as a component of its own."""
        gone = ws.write(split.members.select("component").distinct(), "gone")
        hot = hot_keys(ws, book.members, "component", self.group_rows)
        marks = gone.select(F.col("component").alias("_c"), F.lit(True).alias("_gone"))
        placed = lookup(book.members, "component", marks, "_c", "account", hot)
        moved = placed.join(split.members.select("account", "block"), "account", "left")
        component = F.when(F.col("_gone"), F.coalesce("block", "account")).otherwise(F.col("component"))
        members = ws.write(moved.select("account", component.alias("component"), (F.col("_gone") & F.col("block").isNull()).alias("alone")), "members")
        blocks = split.blocks.where("refined").select(F.col("block").alias("component"), "accounts", "edges")
        single = members.where("alone").select("component", F.lit(1).cast("long").alias("accounts"), F.lit(0).cast("long").alias("edges"))
        return merges.Book(
            members.select("account", "component"),
            ws.write(book.stats.join(gone, "component", "left_anti").unionByName(blocks).unionByName(single), "stats"),
            ws.write(book.history.join(gone, "component", "left_anti"), "history"),
        )

    def members(self, version: int) -> DataFrame:
        """``(account, component)`` after a micro-batch."""
        return self.version(version).members()

    def stats(self, version: int) -> DataFrame:
        """``(component, accounts, edges)`` after a micro-batch."""
        return self.version(version).newest("stats")

    def edges(self, version: int) -> DataFrame:
        """The edges up to a version: all of them, or the latest ``window_edges``."""
        return self._window(self.version(version))

    def alerts(self, version: int | None = None) -> DataFrame:
        """Alerts of all versions, or of those up to one; each from the part its entry names."""
        return self._kept("alerts", self._entries(version))

    def version(self, number: int, id: str | None = None) -> Version:
        if number < 0:
            return Version(self.spark, self.folder, -1, 0, -1, None, id or "bigint", {})
        entries = self._entries(number)
        entry = entries[number]
        parts = {v: e["part"] for v, e in entries.items() if entry["base"] <= v <= number}
        return Version(self.spark, self.folder, number, entry["last"], entry["base"], entry["frontier"], entry["id"], parts)

    def _entries(self, upto: int | None = None) -> dict[int, dict]:
        """One small row per version."""
        rows = self.spark.read.schema(ENTRY + ", v int").parquet(f"{self.folder}/versions").collect()
        return {r["v"]: r.asDict() for r in rows if upto is None or r["v"] <= upto}

    def _kept(self, kind: str, entries: dict[int, dict]) -> DataFrame:
        return self.spark.read.parquet(*[f"{e['part']}/{kind}" for e in entries.values()])

    def _window(self, now: Version) -> DataFrame:
        entries = self._entries() if is_there(self.spark, f"{self.folder}/versions") else {}
        parts = {v: e["part"] for v, e in entries.items() if v < now.number and not self._outside(e["last"], now)}
        stored = self.spark.read.parquet(*[f"{p}/edges" for p in [*parts.values(), now.parts[now.number]]])
        return stored if self.window_edges is None else stored.where(F.col("seq") > now.last - self.window_edges)

    def _outside(self, seq: int, now: Version) -> bool:
        """Whether an edge is older than those kept."""
        return self.window_edges is not None and seq <= now.last - self.window_edges

    def _forget(self, now: Version) -> None:
        """Remove state tables no repeated batch can ask for, and edges beyond the window.

        A repeated batch reads the version before its own, and that goes back to its base.
        """
        entries = self._entries(now.number - 1)
        if now.number - 1 not in entries:
            return
        needed = entries[now.number - 1]["base"]
        for v, entry in entries.items():
            if v < needed and is_there(self.spark, f"{entry['part']}/members"):
                for kind in STATE:
                    delete(self.spark, f"{entry['part']}/{kind}")
            if v < now.number - 1 and self._outside(entry["last"], now):
                delete(self.spark, f"{entry['part']}/edges")
