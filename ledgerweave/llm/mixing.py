"""Mixing sources to target weights: how often each document is taken.

Sizes are summed per source.  A source's target is its weight's share of the mix, at most
``max_rate`` times its size; what it can't take is shared among the others by weight.  A
target over a size is the source's repetition rate: each of its documents is taken floor(rate)
times, and once more if a hash of its key, taken as a number in [0, 1), lies below the rest of
the rate.  DataFrame functions only.

The targets are a water level: sources are sorted by the level at which they are full, and the
first that the level doesn't reach, given all that are full before it, ends the full ones.  So
one running sum over the sorted sources stands for all rounds of sharing.  Sources are counted,
sorted and summed as tables; there may be as many as there are documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.llm.text import with_columns
from ledgerweave.workspace import Workspace

#: Times a source's size that a mix takes at most.
MAX_RATE = 3
#: Sources up to which their figures are sent to every task; about 100 bytes each.
BROADCAST_SOURCES = 200_000
#: Parts a source's documents are spread over beyond that.
SPREAD = 64

_ROW_BITS = 33  # of monotonically_increasing_id, for the place in a partition
_HASH_DIGITS = 13  # hex digits of the key's digest: 52 bits, which a double holds exactly


def n_words(text: str) -> Column:
    """Words between ASCII white space; each is written as one mark and the marks are counted, so no list is built."""
    marks = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.translate(marks, " \t\n\x0b\x0c\r", "")).cast("long")


def _totals_before(ws: Workspace, table: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """``table`` with what the rows before each, in the order, sum to.

    One range shuffle; the totals of ranges, a row per shuffle partition, are added within the ranges.
    """
    at = F.monotonically_increasing_id()
    ranged = table.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at)
    ranged = ws.write(ranged.withColumn("_range", F.shiftright("_at", _ROW_BITS)), "ranged")
    earlier = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    per_range = ranged.groupBy("_range").agg(*[F.sum(v).alias(f"_{n}") for n, v in sums.items()])
    offsets = per_range.select(
        "_range", *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in sums]
    )
    within = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    summed = [F.coalesce(F.sum(v).over(within), F.lit(0)).alias(n) for n, v in sums.items()]
    local = ranged.select("*", *summed).join(F.broadcast(offsets), "_range")
    return local.select(*table.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums])


def cycled(weights: tuple[int, ...] = (1, 2, 3)) -> Column:
    """Weights that repeat, by the place (from 0) of a source in code point order."""
    return F.get(F.array(*map(F.lit, weights)), (F.col("place") % len(weights)).cast("int"))


def targets(ws: Workspace, sizes: DataFrame, weight: Column, max_rate: int = MAX_RATE) -> DataFrame:
    """``(source, source_size, weight, target, rate)`` for a table of ``(source, source_size)``.

    ``weight`` is a positive number made from ``place``, the number (from 0) of a source in code point order,
    null last, or from ``source``.  The targets add up to the sizes; a source without words has rate 0.
    """
    placed = _totals_before(ws, sizes, [F.col("source").asc_nulls_last()], place=F.lit(1))
    weighed = placed.select("source", "source_size", weight.alias("weight")).withColumn(
        "room", F.col("source_size") * max_rate
    )
    full_at = F.col("room") / F.col("weight")
    sums = {"room_before": F.col("room"), "weight_before": F.col("weight")}
    order = [full_at.asc(), F.col("source").asc_nulls_last()]
    levelled = ws.write(_totals_before(ws, weighed, order, **sums), "levelled")
    whole = levelled.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level = (F.lit(whole["size"]) - F.col("room_before")) / (F.lit(whole["weight"]) - F.col("weight_before"))
    judged = levelled.withColumn("full", full_at <= level)
    full = judged.where("full").agg(F.sum("room").alias("room"), F.sum("weight").alias("weight")).first()
    rest, open_ = (whole["size"] or 0) - (full["room"] or 0), (whole["weight"] or 0) - (full["weight"] or 0)
    shared = F.lit(float(rest)) * F.col("weight") / F.lit(open_ or 1)
    target = F.when(F.col("full"), F.col("room").cast("double")).otherwise(shared)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    found = judged.withColumn("target", target).withColumn("rate", rate)
    return ws.write(found.select("source", "source_size", "weight", "target", "rate"), "targets")


def _chance(key: str, seed: str) -> Column:
    """A number in [0, 1) from a digest of the seed and the key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, _HASH_DIGITS), 16, 10).cast("long") / F.lit(float(1 << 4 * _HASH_DIGITS))


def fit(
    ws: Workspace,
    docs: DataFrame,
    weight: Column | None = None,
    text: str = "text",
    source: str = "source",
    max_rate: int = MAX_RATE,
) -> DataFrame:
    """The targets of the sources of ``docs``; see :func:`targets`.

    A document's size is its number of words; a null text has none.  A null source is a source of its own, after
    all others; the empty string is one too.
    """
    sized = docs.select(F.col(source).cast("string").alias("source"), n_words(text).alias("size"))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    return targets(ws, sizes, cycled() if weight is None else weight, max_rate)


def with_copies(
    ws: Workspace,
    docs: DataFrame,
    found: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    seed: str = "mix",
    broadcast_sources: int = BROADCAST_SOURCES,
) -> DataFrame:
    """``docs`` with ``source_size``, ``target``, ``rate`` and ``copies``, how often each is taken.

    ``copies`` depends on the seed, the key and the source's rate alone, so reruns agree, rows of one key and
    source fare alike (null keys among themselves too), and none is taken more than ``max_rate`` times.  Columns
    named like the results give way; an empty table stays empty.
    """
    figures = found.select(F.col("source").alias("_source"), *[F.col(c).alias(f"_{c}") for c in ("source_size", "target", "rate")])
    same = F.col(f"`{source}`").cast("string").eqNullSafe(F.col("_source"))
    if ws.rows(found) <= broadcast_sources:
        joined = docs.join(F.broadcast(figures), same)
    else:
        # Documents of one source are spread, as one may hold a third of them.
        parts = figures.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
        part = F.pmod(F.xxhash64(f"`{key}`"), F.lit(SPREAD)).cast("int")
        joined = docs.withColumn("_part", part).join(parts, same & (F.col("_part") == F.col("_copy"))).drop("_part", "_copy")
    whole = F.floor("_rate").cast("int")
    copies = whole + (_chance(f"`{key}`", seed) < F.col("_rate") - whole).cast("int")
    made = {c: F.col(f"_{c}") for c in ("source_size", "target", "rate")}
    return with_columns(joined, **made, copies=copies).drop("_source", "_source_size", "_target", "_rate")


def emit(ws: Workspace, docs: DataFrame, found: DataFrame, **options) -> DataFrame:
    """``docs`` with every document as often as it is taken; ``copy`` counts from 1.  Options as for :func:`with_copies`.

    No text is shuffled while the sources' figures fit every task.  Columns of ``docs`` named like the figures or
    ``copy`` give way.
    """
    counted = with_copies(ws, docs, found, **options).where("copies > 0")
    return with_columns(counted, copy=F.explode(F.sequence(F.lit(1), F.col("copies"))))


def plan(
    ws: Workspace,
    docs: DataFrame,
    weight: Column | None = None,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    max_rate: int = MAX_RATE,
    **options,
) -> DataFrame:
    """``(key, source, size, source_size, target, rate, copies)`` of every document; texts are read once."""
    sized = ws.write(docs.select(key, source, n_words(text).alias("size")), "sized")
    sizes = sized.groupBy(F.col(source).cast("string").alias("source")).agg(F.sum("size").alias("source_size"))
    found = targets(ws, sizes, cycled() if weight is None else weight, max_rate)
    return with_copies(ws, sized, found, key, source, **options)
