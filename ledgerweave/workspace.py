"""Written tables that cut lineage between the rounds of an iterative job.

Iterative operators write each round as a Parquet table in the shared folder
named by ``spark.checkpoint.dir``.  A lost executor then costs only the tasks of
the current round, Catalyst plans stay short, and the size of each table is
known to the optimizer when it chooses between a broadcast and a shuffle join.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach.

    A machine-local folder is chosen only where the setting is absent and the
    session runs in local mode, as in tests.
    """
    folder = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="ledgerweave-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(f"file://{folder}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


class Workspace:
    """One run's tables, in a folder of its own."""

    def __init__(self, spark: SparkSession, label: str = "run"):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self._written: list[tuple[DataFrame, str, dict[str, int]]] = []
        self._known: list[tuple[DataFrame, int]] = []

    def write(self, df: DataFrame, name: str = "t", file_rows: int = 0, **counts: Column | str) -> DataFrame:
        """Run ``df`` once, keep it as a table, and return a scan of that table.

        The rows, and the rows that meet each condition in ``counts``, are
        counted on the way; see :meth:`count`.  A file has up to ``file_rows`` rows, if that is not 0.
        """
        path = f"{self.root}/{name}-{uuid.uuid4().hex}"
        seen = Observation(name)
        conditions = [
            F.count_if(F.expr(c) if isinstance(c, str) else c).alias(n) for n, c in counts.items()
        ]
        observed = df.observe(seen, F.count(F.lit(1)).alias("rows"), *conditions)
        observed.write.option("maxRecordsPerFile", file_rows).parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self._written.append((table, path, seen.get))
        return table

    def count(self, table: DataFrame, name: str = "rows") -> int:
        """A figure counted while the table was written."""
        return next(c[name] for t, _, c in self._written if t is table)

    def rows(self, table: DataFrame) -> int:
        """Rows of the table; read from the write where it was written here."""
        known = [c["rows"] for t, _, c in self._written if t is table]
        known += [n for t, n in self._known if t is table]
        return known[0] if known else table.select(F.count(F.lit(1))).first()[0]

    def know(self, df: DataFrame, like: DataFrame | int) -> DataFrame:
        """Note that ``df`` has as many rows as ``like``, or that many, so that they need not be counted."""
        self._known.append((df, like if isinstance(like, int) else self.rows(like)))
        return df

    def is_known(self, df: DataFrame) -> bool:
        return any(t is df for t, *_ in [*self._written, *self._known])

    def path(self, table: DataFrame) -> str:
        return next(p for t, p, _ in self._written if t is table)

    def written(self) -> list[DataFrame]:
        return [t for t, *_ in self._written]

    def keep_only(self, *tables: DataFrame) -> None:
        self.drop(*(t for t, _, _ in self._written if not any(t is k for k in tables)))

    def settle(self, *tables: DataFrame) -> None:
        """Keep these tables only, and let go of the shuffle files of earlier queries, which stay while their plans do."""
        self.keep_only(*tables)
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables of earlier rounds that no later plan reads."""
        for table, path, _ in self._written:
            if any(table is t for t in tables):
                delete(self.spark, path)

    def close(self) -> None:
        """Remove every table of this run, once its results have been used."""
        delete(self.spark, self.root)


def _on_store(spark: SparkSession, path: str):
    """The file system that holds a path, and the path as it knows it."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def delete(spark: SparkSession, path: str) -> None:
    store, at = _on_store(spark, path)
    store.delete(at, True)


def is_file(spark: SparkSession, path: str) -> bool:
    store, at = _on_store(spark, path)
    return store.exists(at) and store.getFileStatus(at).isFile()


def is_there(spark: SparkSession, path: str) -> bool:
    store, at = _on_store(spark, path)
    return store.exists(at)
