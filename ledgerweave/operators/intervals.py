"""Component figures per arrival interval, scored against the component's own past."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.functions import scoring
from ledgerweave.operators.ordering import running_sum, trailing
from ledgerweave.operators.skew import GROUP_ROWS, hot_keys, lookup
from ledgerweave.operators.stats import running_outflow
from ledgerweave.workspace import Workspace


def snapshots(
    ws: Workspace, txn: DataFrame, members: DataFrame, every: int, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Running figures per component at the end of each interval it is active in.

    ``interval`` counts blocks of ``every`` arrivals.  ``out_hh`` is the running
    outflow of the sender of the component's last edge in the interval.
    """
    interval = F.floor((F.col("seq") - 1) / every).alias("interval")
    hot = hot_keys(ws, txn, "sender", group_rows)
    outflow = running_outflow(txn, hot).select("seq", "sender", "out_hh", interval)
    # The latest edge of each sender per interval is enough, and is one row per sender.
    per_sender = outflow.groupBy("sender", "interval").agg(
        F.count(F.lit(1)).alias("edges"), F.max(F.struct("seq", "out_hh")).alias("newest")
    )
    located = lookup(per_sender, "sender", members, "account", "interval", None, "inner")
    per_component = located.groupBy("component", "interval").agg(
        F.sum("edges").alias("new_edges"), F.max("newest").alias("newest")
    )
    first_seen = (
        txn.select(F.explode(F.array("sender", "receiver")).alias("account"), interval)
        .groupBy("account")
        .agg(F.min("interval").alias("interval"))
        .join(members, "account")
        .groupBy("component", "interval")
        .agg(F.count(F.lit(1)).alias("new_accounts"))
    )
    active = per_component.join(first_seen, ["component", "interval"], "left").select(
        "component", "interval", "new_edges", F.coalesce("new_accounts", F.lit(0)).alias("new_accounts"),
        F.col("newest.seq").alias("last_seq"), F.col("newest.out_hh").cast("double").alias("out_hh"),
    )
    active = ws.write(active, "active")
    hot = hot_keys(ws, active, "component", group_rows)
    for new, total in (("new_edges", "edges"), ("new_accounts", "accounts")):
        active = running_sum(active, "component", "interval", new, total, hot)
    return active.select(
        "component", "interval", "last_seq", "accounts", "edges", "out_hh",
        F.col("accounts").cast("double").alias("distinct"),
        scoring.density(F.col("edges"), F.col("accounts")).alias("density"),
    )


def interval_scores(
    ws: Workspace,
    txn: DataFrame,
    members: DataFrame,
    every: int = 200_000,
    depth: int = scoring.HISTORY_DEPTH,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Snapshots with z values over the component's earlier intervals, score and level."""
    taken = ws.write(snapshots(ws, txn, members, every, group_rows), "snapshots")
    hot = hot_keys(ws, taken, "component", group_rows)
    fields = ["distinct", "out_hh", "density"]
    past = trailing(taken, "component", "interval", fields, depth, "past", hot)
    for field in fields:
        past = past.withColumn(f"z_{field}", scoring.robust_z(F.col(field), F.col(f"past.{field}")))
    s = scoring.score(F.col("z_distinct"), F.col("z_out_hh"), F.col("z_density"))
    return past.drop("past").withColumn("s", s).withColumn("level", scoring.level(F.col("s")))


def latest_per_component(scored: DataFrame, order: str = "interval") -> DataFrame:
    """The newest row of each component."""
    rest = [c for c in scored.columns if c not in ("component", order)]
    newest = scored.groupBy("component").agg(F.max(F.struct(order, *rest)).alias("newest"))
    return newest.select("component", "newest.*")
