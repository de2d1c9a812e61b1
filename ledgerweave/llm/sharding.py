"""Shards of near-equal size by minimax contiguous partition.

Rows that belong together (equal texts) form an atomic group; groups are put in a fixed
order, by digest, and cut into contiguous runs, one per shard.  The cuts make the largest
shard as small as it can be: whether a capacity suffices is checked greedily (fill each
shard as far as it goes), and the smallest that does is found by a search that tries many
capacities at a time and so narrows the interval by a factor of ``TRIED`` per round.

The greedy check runs on running sums of the group sizes: a shard that begins at sum s ends
at the largest sum not above s + capacity.  It reads only the sums between the least and the
largest such end, from a table sorted by them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.workspace import Workspace

#: Capacities checked at a time.
TRIED = 48

_ROW_BITS = 33  # of monotonically_increasing_id, for the place in a partition


def _ranged(ws: Workspace, df: DataFrame, *order: str) -> DataFrame:
    """``df`` as a table in ranges of the order: ``_range``, and ``_place`` from 0 within it."""
    placed = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order, "_tie")
    at = F.monotonically_increasing_id()
    sorted_ = placed.sortWithinPartitions(*order, "_tie").drop("_tie").withColumn("_at", at)
    low = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return ws.write(
        sorted_.withColumn("_range", F.shiftright("_at", _ROW_BITS)).withColumn("_place", low).drop("_at"), "ranged"
    )


def _before(ranged: DataFrame, total: Column) -> DataFrame:
    """What the ranges before each hold; a row per range, of which there are as many as shuffle partitions."""
    sums = ranged.groupBy("_range").agg(total.alias("_sum"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))


def running_sizes(ws: Workspace, groups: DataFrame, order: str, size: str) -> DataFrame:
    """``groups`` with ``upto``, the sizes summed to each in the order; a table sorted by it."""
    ranged = _ranged(ws, groups, order)
    within = Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumn("upto", F.sum(size).over(within)).join(F.broadcast(_before(ranged, F.sum(size))), "_range")
    return ws.write(summed.withColumn("upto", F.col("upto") + F.col("_before")).drop("_range", "_place", "_before"), "sums")


def _ends(sums: DataFrame, starts: list[int], capacities: list[int], largest: int) -> list[int]:
    """For each capacity, where the shard that begins at its start ends."""
    reach = [s + c for s, c in zip(starts, capacities)]
    near = sums.where((F.col("upto") >= min(reach) - largest) & (F.col("upto") <= max(reach)))
    row = near.agg(*[F.max(F.when(F.col("upto") <= x, F.col("upto"))).alias(f"e{i}") for i, x in enumerate(reach)]).first()
    return [s if e is None else max(s, e) for s, e in zip(starts, row)]


def minimax_cuts(sums: DataFrame, shards: int, largest: int, total: int) -> list[int]:
    """Sums at which the shards end, in order; the last is ``total``.

    ``largest`` is the size of the largest group.  The largest shard is the smallest possible.
    """
    low, high = max(largest, -(-total // shards)), -(-total // shards) + largest
    while True:
        step = max(1, -(-(high - low + 1) // TRIED))
        capacities = sorted({*range(low, high, step), high})
        ends = [[0] * len(capacities)]
        for _ in range(shards):
            if min(ends[-1]) == total:
                break
            ends.append(_ends(sums, ends[-1], capacities, largest))
        # the largest capacity always suffices: a shard is left more than total / shards full
        fits = next(i for i, e in enumerate(ends[-1]) if e == total)
        if step == 1 or fits == 0:
            cuts = [e[fits] for e in ends[1:]]
            return sorted(set(cuts))
        low, high = capacities[fits - 1] + 1, capacities[fits]


def shard(
    ws: Workspace,
    docs: DataFrame,
    shards: int,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``(key, size, text_crc32, shard, slot)``, one row per row of ``docs``.

    A row's size is the UTF-8 length of its text and 1.  Equal texts, and all null and empty ones, are an
    atomic group and share a shard; slots count a shard's rows from 0, by group and key.  With fewer groups
    than shards, or with groups larger than a fair share, some shards stay small or empty.  An empty table
    gives no rows; other columns are left behind.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(body.cast("binary"), 256)).alias("_group"),
    )
    placed = _ranged(ws, rows, "_group", key)
    sums = running_sizes(ws, placed.groupBy("_group").agg(F.sum("size").alias("bytes")), "_group", "bytes")
    largest, total = sums.agg(F.max("bytes"), F.max("upto")).first()
    cuts = minimax_cuts(sums, shards, largest, total) if total else []
    last = [r._group for r in sums.where(F.col("upto").isin(cuts[:-1])).orderBy("upto").select("_group").collect()]
    number = _beyond(F.col("_group"), last)
    numbered = placed.join(F.broadcast(_before(placed, F.count(F.lit(1)))), "_range").withColumn(
        "_row", F.col("_before") + F.col("_place")
    )
    counts = placed.agg(*[F.count_if(F.col("_group") <= F.lit(g)).alias(f"n{i}") for i, g in enumerate(last)]).first() if last else ()
    begins = F.element_at(F.array(*map(F.lit, [0, *counts])), F.col("shard") + 1)
    return numbered.withColumn("shard", number).select(
        key, "size", "text_crc32", "shard", (F.col("_row") - begins).cast("long").alias("slot")
    )


def _beyond(column: Column, bounds: Sequence[bytes]) -> Column:
    """How many of the bounds the column is beyond."""
    return sum([(column > F.lit(bytes(b))).cast("int") for b in bounds], F.lit(0))
