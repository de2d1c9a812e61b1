"""Flow per sender and event-time window, with a lag for late transfers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.functions.scoring import whole_weight


def windowed_flow(edges: DataFrame, width: str = "1 hour", lag: str = "10 minutes") -> DataFrame:
    """Edges and outflow per sender and tumbling window of ``ts``.

    A window is emitted once no transfer within ``lag`` can still fall in it.
    State is one row per sender and open window.
    """
    return (
        edges.withWatermark("ts", lag)
        .groupBy(F.window("ts", width).alias("w"), "sender")
        .agg(F.count(F.lit(1)).alias("edges"), F.sum(whole_weight(F.col("amount"))).alias("outflow"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "sender", "edges", "outflow")
    )


def open_windows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The windows of :func:`windowed_flow` that had not closed when its query stopped, with what they held.

    They are read from the query's own state, as it was after the last micro-batch; with those emitted they
    make up every window.  A query that is started again goes on from the same state.
    """
    state = spark.read.format("statestore").load(checkpoint)
    (edges, outflow) = [f.name for f in state.schema["value"].dataType]
    (window, sender) = [f.name for f in state.schema["key"].dataType]
    key, value = F.col("key"), F.col("value")
    return state.select(
        key[window]["start"].alias("start"), key[window]["end"].alias("end"), key[sender].alias("sender"),
        value[edges].alias("edges"), value[outflow].alias("outflow"),
    )
