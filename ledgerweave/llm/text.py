"""What the text operators share: row keys, memoised per-word work, batch sizes."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts handed to Python at a time; with texts of a few kB a batch is a few MB.
BATCH_ROWS = "512"


def configure(spark: SparkSession) -> SparkSession:
    """Session settings the text operators rely on; all can change at run time."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, folds: int) -> Column:
    """The fold of a row: crc32 of its key as text, modulo ``folds``."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


def with_columns(df: DataFrame, **made: Column) -> DataFrame:
    """``df`` with new columns at its end; columns of the same name, in any case, give way."""
    taken = {name.lower() for name in made}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]
    return df.select(*kept, *[value.alias(name) for name, value in made.items()])


class Memo(dict):
    """Results by key, worked out at first use.

    At most ``limit`` are held, in a younger half and an older one; what is asked for again moves
    to the younger, and the older is forgotten when the younger is full.
    """

    def __init__(self, compute: Callable[[Hashable], Any], limit: int = 200_000):
        self.compute, self.half, self.older = compute, limit // 2, {}

    def __missing__(self, key: Hashable) -> Any:
        value = self.older[key] if key in self.older else self.compute(key)
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class Known:
    """Results by key for keys that come in batches; the least recently asked for are forgotten beyond ``limit``.

    A batch of more keys than that is held whole for as long as it lasts.
    """

    def __init__(self, limit: int):
        self.half, self.younger, self.older = limit // 2, {}, {}

    def lacking(self, wanted: set) -> set:
        """The keys that still have to be worked out and put in ``younger``, which then holds all wanted."""
        if len(self.younger) + len(wanted) > self.half:
            self.older, self.younger = self.younger, {}
        unknown = wanted.difference(self.younger)
        again = {key: self.older[key] for key in unknown if key in self.older}
        self.younger.update(again)
        return unknown.difference(again)


_loaded: dict[Hashable, Any] = {}


def once(key: Hashable, make: Callable[[], Any]) -> Any:
    """One instance per worker process, kept while the worker serves further tasks."""
    if key not in _loaded:
        if len(_loaded) >= 8:
            _loaded.clear()
        _loaded[key] = make()
    return _loaded[key]
