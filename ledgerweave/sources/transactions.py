"""Transaction tables: column roles, normalised values and arrival numbers."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.functions import timeparse
from ledgerweave.operators.ordering import number_rows
from ledgerweave.workspace import Workspace

# Accepted column names per role, in any case, first hit wins.
ROLE_NAMES = {
    "time": ["time", "timestamp", "datetime", "date"],
    "sender": ["sender", "sender_account", "src", "from", "payer"],
    "receiver": ["receiver", "receiver_account", "dst", "to", "payee"],
    "amount": ["amount", "value", "payment_amount", "amt"],
}


class MissingRole(ValueError):
    """The table lacks a column for one or more roles."""


def find_column(names: Sequence[str], candidates: Iterable[str]) -> str | None:
    """First candidate present among ``names``, whatever its case."""
    place = _find(names, candidates)
    return None if place is None else names[place]


def _find(names: Sequence[str], candidates: Iterable[str]) -> int | None:
    places = {name.lower(): i for i, name in enumerate(names)}
    return next((places[c.lower()] for c in candidates if c.lower() in places), None)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Scan a Parquet set; any path scheme the cluster knows will do."""
    return spark.read.parquet(path)


def normalise(
    raw: DataFrame, legacy_time: bool = False, keep: Sequence[str] = ()
) -> DataFrame:
    """``(tnum, sender, receiver, amount)`` plus the columns named in ``keep``.

    ``Date`` and ``Time`` are joined where both exist, unless ``legacy_time``.
    Unreadable times stay null until :func:`with_arrival` fills them; unreadable
    amounts become 0.
    """
    names = raw.columns
    places = {role: _find(names, aliases) for role, aliases in ROLE_NAMES.items()}
    missing = [role for role, place in places.items() if place is None]
    if missing:
        raise MissingRole(f"no column for {', '.join(missing)} among {names}")
    # Rename by place, so that names that differ only in case stay apart.
    table = raw.toDF(*[f"_{i}" for i in range(len(names))])

    def column(place: int):
        return F.col(f"_{place}")

    def seconds(place: int):
        return timeparse.epoch_seconds(column(place), raw.schema[place].dataType, legacy_time)

    tnum = seconds(places["time"])
    date, time = _find(names, ["date"]), _find(names, ["time"])
    if not legacy_time and date is not None and time is not None:
        joined = timeparse.date_time_seconds(column(date), column(time))
        tnum = F.coalesce(joined.cast("double"), tnum)
    return table.select(
        tnum.alias("tnum"),
        column(places["sender"]).alias("sender"),
        column(places["receiver"]).alias("receiver"),
        F.coalesce(column(places["amount"]).try_cast("double"), F.lit(0.0)).alias("amount"),
        *[column(names.index(name)).alias(name) for name in keep],
    )


def with_arrival(
    ws: Workspace, rows: DataFrame, tiebreak: Sequence[str] = ("sender", "receiver", "amount")
) -> DataFrame:
    """Add ``seq``, the arrival number by time, and ``ts``; fill missing times.

    Rows without a time come last, and take their place in the table as time.
    """
    return _finish(ws, number_rows(ws, rows, [F.col("tnum").asc_nulls_last(), *tiebreak]))


def in_stored_order(ws: Workspace, spark: SparkSession, path: str, legacy_time: bool = False) -> DataFrame:
    """Arrival numbers in the order in which the files hold the rows."""
    raw = read(spark, path)
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    placed = raw.select(*raw.columns, *place)
    rows = normalise(placed, legacy_time, keep=["_file", "_row"])
    return _finish(ws, number_rows(ws, rows, ["_file", "_row"]))


def _finish(ws: Workspace, numbered: DataFrame) -> DataFrame:
    tnum = F.coalesce("tnum", (F.col("seq") - 1).cast("double"))
    finished = numbered.select(
        "seq",
        F.timestamp_micros((tnum * 1e6).cast("long")).alias("ts"),
        tnum.alias("tnum"),
        "sender",
        "receiver",
        "amount",
    )
    return ws.know(finished, numbered)
