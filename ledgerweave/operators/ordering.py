"""Row numbers, running sums and trailing windows without a single-task funnel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.operators.skew import GROUP_ROWS
from ledgerweave.workspace import Workspace

#: Rows of a group up to which Spark limits it before the shuffle, by default.
GROUP_LIMIT = 1000

_ROW_BITS = 33  # monotonically_increasing_id keeps the row's place in the low bits


def _placed(ws: Workspace, df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """``df`` range-partitioned and sorted by ``order``, with each row's place in ``_at``.

    A tie breaker keeps equal rows from piling up in one range.  The result is a
    written table, so the ranges are the same for every later reader.
    """
    ranged = (
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(*order, "_tie")
        .sortWithinPartitions(*order, "_tie")
        .drop("_tie")
    )
    return ws.write(ranged.withColumn("_at", F.monotonically_increasing_id()), "placed")


def _offsets(placed: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """What lies before each range, one row per range.

    There are as many rows as the range shuffle has partitions, so the list is
    taken to the driver once and broadcast from there.
    """
    totals = placed.groupBy(F.shiftright("_at", _ROW_BITS).alias("_range")).agg(
        *[F.sum(value).alias(name) for name, value in sums.items()]
    )
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_range",
        *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"_before_{name}") for name in sums],
    )
    return F.broadcast(placed.sparkSession.createDataFrame(offsets.toArrow(), offsets.schema))


def number_rows(
    ws: Workspace, df: DataFrame, order: Sequence[Column | str], name: str = "seq"
) -> DataFrame:
    """Consecutive numbers from 1 in the given total order.

    One range shuffle, a count per range, and an addition; no task sees more
    than one range.
    """
    placed = _placed(ws, df, order)
    offsets = _offsets(placed, {"rows": F.lit(1)})
    in_range = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    numbered = (
        placed.withColumn("_range", F.shiftright("_at", _ROW_BITS))
        .join(offsets, "_range")
        .withColumn(name, (in_range + F.col("_before_rows") + 1).cast("long"))
        .drop("_range", "_at", "_before_rows")
    )
    return ws.know(numbered, placed)


def prefix_sums(
    ws: Workspace, df: DataFrame, order: Sequence[Column | str], sums: dict[str, str]
) -> DataFrame:
    """Inclusive running sums over the whole table in the given order."""
    placed = _placed(ws, df, order)
    offsets = _offsets(placed, {out: F.col(value) for out, value in sums.items()})
    local = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    result = placed.withColumn("_range", F.shiftright("_at", _ROW_BITS))
    for out, value in sums.items():
        result = result.withColumn(out, F.sum(value).over(local))
    result = result.join(offsets, "_range")
    for out in sums:
        result = result.withColumn(out, F.col(out) + F.col(f"_before_{out}"))
    return result.drop("_range", "_at", *[f"_before_{out}" for out in sums])


def running_sum(
    df: DataFrame,
    key: str,
    order: str,
    value: str,
    out: str,
    hot: DataFrame | None = None,
    slice_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Inclusive running sum of ``value`` per ``key`` by ``order``.

    ``order`` is an integer without repeats, such as the arrival number.  Keys
    listed in ``hot`` are cut in slices of ``slice_rows`` arrival numbers; each
    slice is summed alone and the totals of the slices before it are added.
    """
    whole = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    if hot is None:
        return df.withColumn(out, F.sum(value).over(whole))
    sliced = _sliced(df, key, F.floor(F.col(order) / slice_rows), hot)
    local = Window.partitionBy(key, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.where("_is_hot")
        .groupBy(key, "_slice")
        .agg(F.sum(value).alias("_total"))
        .select(key, "_slice", F.sum("_total").over(before).alias("_before"))
    )
    return (
        sliced.withColumn(out, F.sum(value).over(local))
        .join(offsets, [key, "_slice"], "left")
        .withColumn(out, F.col(out) + F.coalesce("_before", F.lit(0)))
        .drop("_slice", "_is_hot", "_before")
    )


def running(
    df: DataFrame,
    key: str,
    order: str,
    sums: dict[str, Column],
    least: dict[str, Column],
    hot: DataFrame | None = None,
    slice_rows: int = GROUP_ROWS,
) -> DataFrame:
    """``df`` with several inclusive running sums and running minima per ``key`` by ``order``.

    As :func:`running_sum`, for more than one figure in one shuffle.  Nulls count as nothing.
    """

    def over(window) -> list[Column]:
        added = [F.coalesce(F.sum(v).over(window), F.lit(0)).alias(n) for n, v in sums.items()]
        return added + [F.min(v).over(window).alias(n) for n, v in least.items()]

    def upto(*keys: str, by: str, end: int):
        return Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, end)

    if hot is None:
        return df.select("*", *over(upto(key, by=order, end=0)))
    sliced = _sliced(df, key, F.floor(F.col(order) / slice_rows), hot)
    totals = sliced.where("_is_hot").groupBy(key, "_slice").agg(
        *[F.sum(v).alias(f"_{n}") for n, v in sums.items()], *[F.min(v).alias(f"_{n}") for n, v in least.items()]
    )
    before = upto(key, by="_slice", end=-1)
    earlier = [F.sum(f"_{n}").over(before).alias(f"_{n}") for n in sums] + [F.min(f"_{n}").over(before).alias(f"_{n}") for n in least]
    joined = sliced.select("*", *over(upto(key, "_slice", by=order, end=0))).join(
        totals.select(key, "_slice", *earlier), [key, "_slice"], "left"
    )
    whole = [(F.col(n) + F.coalesce(f"_{n}", F.lit(0))).alias(n) for n in sums]
    return joined.select(*[f"`{c}`" for c in df.columns], *whole, *[F.least(n, f"_{n}").alias(n) for n in least])


def trailing(
    df: DataFrame,
    key: str,
    order: str,
    fields: Sequence[str],
    depth: int,
    out: str,
    hot: DataFrame | None = None,
    slice_rows: int = GROUP_ROWS,
    block: int = 65_536,
) -> DataFrame:
    """The ``depth`` rows of the same key before each row, as an array of structs.

    A hot key is cut in blocks of consecutive rows; the last ``depth`` rows of a
    block are repeated at the head of the next, so each window is whole.
    """
    entry = F.struct(*fields)
    if hot is None:
        frame = Window.partitionBy(key).orderBy(order).rowsBetween(-depth, -1)
        return df.withColumn(out, F.collect_list(entry).over(frame))
    block = max(block, depth)
    ranked = running_sum(
        df.withColumn("_one", F.lit(1)), key, order, "_one", "_rank", hot, slice_rows
    ).drop("_one")
    home = F.floor((F.col("_rank") - 1) / block)
    near_end = F.pmod(F.col("_rank") - 1, F.lit(block)) >= block - depth
    copies = F.when(near_end, F.array(home, home + 1)).otherwise(F.array(home))
    frame = Window.partitionBy(key, "_block").orderBy(order).rowsBetween(-depth, -1)
    return (
        ranked.withColumn("_home", home)
        .withColumn("_block", F.explode(copies))
        .withColumn(out, F.collect_list(entry).over(frame))
        .where("_block = _home")
        .drop("_rank", "_home", "_block")
    )


def latest(
    df: DataFrame,
    key: str,
    order: str,
    n: int,
    hot: DataFrame | None = None,
    slice_rows: int = GROUP_ROWS,
) -> DataFrame:
    """The ``n`` rows of each key with the greatest ``order``.

    Up to ``GROUP_LIMIT`` rows a key Spark drops the rest within each task, before it shuffles, so that a key
    holds ``n`` rows a task at most.
    """
    if n <= GROUP_LIMIT:
        rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
        return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
    counted = df.withColumn("_one", F.lit(1)).withColumn("_newest", -F.col(order))
    ranked = running_sum(counted, key, "_newest", "_one", "_rank", hot, slice_rows)
    return ranked.where(F.col("_rank") <= n).drop("_one", "_newest", "_rank")


def _sliced(df: DataFrame, key: str, part: Column, hot: DataFrame) -> DataFrame:
    marks = F.broadcast(hot.select(F.col(key).alias("_hot")))
    return (
        df.join(marks, df[key] == marks["_hot"], "left")
        .withColumn("_is_hot", F.col("_hot").isNotNull())
        .withColumn("_slice", F.when(F.col("_is_hot"), part).otherwise(F.lit(-1)))
        .drop("_hot")
    )
