"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.workspace import Workspace

# Rows of one key that one task may hold.
GROUP_ROWS = 1_000_000
# A key is hot above max(GROUP_ROWS, rows / MAX_HOT_KEYS), so there can be at
# most MAX_HOT_KEYS of them: the list is always small enough to broadcast.
MAX_HOT_KEYS = 200_000


def hot_keys(
    ws: Workspace, table: DataFrame, key: str, group_rows: int = GROUP_ROWS, counts: DataFrame | None = None
) -> DataFrame | None:
    """Keys of ``table`` with too many rows for one task, or None if there are none.

    Returns ``(key, slices)``, where ``slices`` is the number of parts the key is
    to be split in.  A table that is small as a whole is not scanned for keys.
    ``counts`` has ``(key, n)``, the rows of each key, where they are known.
    """
    total = ws.rows(table)
    limit = max(group_rows, total // MAX_HOT_KEYS)
    if total <= limit:
        return None
    if counts is None:
        counts = table.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    found = (
        counts.where(F.col("n") > limit)
        .select(key, F.ceil(F.col("n") / limit).cast("int").alias("slices"))
        .toArrow()  # at most MAX_HOT_KEYS rows, by the choice of limit
    )
    return table.sparkSession.createDataFrame(found) if found.num_rows else None


def lookup(
    rows: DataFrame,
    key: str,
    table: DataFrame,
    table_key: str,
    spread: str,
    hot: DataFrame | None = None,
    how: str = "left",
) -> DataFrame:
    """Join ``rows.key = table.table_key``, splitting the rows of hot keys.

    Rows of a hot key are spread over several tasks by a hash of ``spread``, a
    column that differs among them, and the matching table rows are repeated
    once per part.  ``table_key`` is dropped from the result.
    """
    table = table.withColumnRenamed(table_key, "_key")
    if hot is None:
        return rows.join(table, rows[key] == table["_key"], how).drop("_key")
    marks = F.broadcast(hot.select(F.col(hot.columns[0]).alias("_hot"), "slices"))
    rows = (
        rows.join(marks, rows[key] == marks["_hot"], "left")
        .withColumn("_part", F.pmod(F.xxhash64(spread), F.coalesce("slices", F.lit(1))).cast("int"))
        .drop("_hot", "slices")
    )
    table = (
        table.join(marks, table["_key"] == marks["_hot"], "left")
        .withColumn(
            "_table_part",
            F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)),
        )
        .drop("_hot", "slices")
    )
    match = (rows[key] == table["_key"]) & (rows["_part"] == table["_table_part"])
    return rows.join(table, match, how).drop("_key", "_part", "_table_part")
