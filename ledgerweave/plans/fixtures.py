"""Transaction graphs derived from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.operators.ordering import number_rows
from ledgerweave.workspace import Workspace

ORDER_KEY = ["o_orderdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def configure(spark: SparkSession) -> SparkSession:
    """Session settings the engine relies on; all can change at run time."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def transfers(spark: SparkSession, sf_dir: str, block: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """All line items as transfers from their customer to an account of the same block."""
    joined = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    return joined.select(
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.col("o_custkey").alias("sender"),
        (F.col("o_custkey") - F.col("o_custkey") % block + F.col("l_partkey") % block).alias("receiver"),
        F.col("l_extendedprice").alias("amount"),
        *[F.col(c) for c in dict.fromkeys([*ORDER_KEY, *keep])],
    )


def _arrived(ws: Workspace, rows: DataFrame, keep: tuple[str, ...], order: list[str] = ORDER_KEY) -> DataFrame:
    numbered = number_rows(ws, rows, order)
    tnum = F.unix_timestamp("ts").cast("double").alias("tnum")
    return ws.write(numbered.select("seq", "ts", tnum, "sender", "receiver", "amount", *keep), "txn")


#: Accounts per block of the two graphs; both take every line item.
SPARSE = 10
DENSE = 8


def txn(ws: Workspace, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return _arrived(ws, transfers(ws.spark, sf_dir, SPARSE, keep), keep)


def txn_dense(ws: Workspace, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return _arrived(ws, transfers(ws.spark, sf_dir, DENSE, keep), keep)


#: Accounts per block of the graph of orders.
LARGE = 400


def order_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as transfers from their customer to an account of the same block of 400."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.col("o_custkey").alias("sender"),
        (F.col("o_custkey") - F.col("o_custkey") % LARGE + (F.col("o_orderkey") * 31 + 7) % LARGE).alias("receiver"),
        F.col("o_totalprice").alias("amount"),
        "o_orderdate",
        "o_orderkey",
    )


def txn_large(ws: Workspace, sf_dir: str) -> DataFrame:
    """The transfers of orders in the order they arrived; a few large components."""
    return _arrived(ws, order_transfers(ws.spark, sf_dir), (), ["o_orderdate", "o_orderkey"])


#: Added to the accounts of the small blocks of the mixed graph.
APART = 10_000_000


def txn_mixed(ws: Workspace, sf_dir: str) -> DataFrame:
    """The transfers of the graph of orders and those of blocks of 10, side by side."""
    small = transfers(ws.spark, sf_dir, SPARSE).select((F.col("sender") + APART).alias("sender"), (F.col("receiver") + APART).alias("receiver"))
    return order_transfers(ws.spark, sf_dir).select("sender", "receiver").unionByName(small)


def entity_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring customers of one nation, taken as one entity."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    following = customer.select((F.col("c_custkey") - 1).alias("c_custkey"), "c_nationkey")
    return customer.join(following, ["c_custkey", "c_nationkey"]).select(
        F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("b")
    )
