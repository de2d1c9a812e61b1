"""Writers for alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The alert table's columns, in order.
ALERT_SCHEMA = (
    "time double, root string, src string, dst string, amount double, S double, level string, "
    "distinct double, out_hh double, density double, z_distinct double, z_out_hh double, z_density double"
)


def write_alerts(alerts: DataFrame, folder: str) -> None:
    """Replace the CSV set in ``folder``; every task writes its own part, with a header."""
    alerts.write.mode("overwrite").option("header", True).csv(folder)


def read_alerts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(ALERT_SCHEMA).option("header", True).csv(folder)
