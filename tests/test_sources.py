from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerweave.functions import timeparse
from ledgerweave.sources import sinks, transactions
from ledgerweave.workspace import Workspace


def test_first_alias_wins_in_any_case():
    assert transactions.find_column(["Date", "TIME", "x"], ["time", "date"]) == "TIME"
    assert transactions.find_column(["a"], ["b"]) is None


def test_later_of_two_names_that_differ_in_case_wins(spark):
    raw = spark.createDataFrame([(1, 2, 10, 20, 5.0)], "Sender long, sender long, time long, to long, amt double")
    assert transactions.normalise(raw).first().sender == 2


def test_missing_roles_are_named(spark):
    with pytest.raises(transactions.MissingRole, match="receiver, amount"):
        transactions.normalise(spark.createDataFrame([(1, 2)], "time long, payer long"))


def test_bad_rows(spark):
    raw = spark.createDataFrame(
        [("5", 1, 2, "7.5"), (None, 3, 4, "x"), ("x", 2, 4, None), ("4", 1, 1, "-3")],
        "timestamp string, src long, dst long, value string",
    )
    rows = transactions.with_arrival(Workspace(spark), transactions.normalise(raw)).orderBy("seq").collect()
    assert [(r.seq, r.tnum, r.sender, r.amount) for r in rows] == [
        (1, 4.0, 1, -3.0), (2, 5.0, 1, 7.5), (3, 2.0, 2, 0.0), (4, 3.0, 3, 0.0),
    ]


def test_date_and_time_are_joined(spark):
    raw = spark.createDataFrame(
        [("2022-10-07", "10:35:19", 1, 2, 3.0)], "Date string, Time string, Sender_account long, Receiver_account long, Amount double"
    )
    assert transactions.normalise(raw).first().tnum == 1665138919.0
    assert transactions.normalise(raw, legacy_time=True).first().tnum == 103519.0


def test_layouts(spark):
    texts = {
        "2022-10-07 10:35:19": 1665138919.0, "2022/10/07 10:35:19": 1665138919.0, "2022-10-07 10:35": 1665138900.0,
        "2022/10/07 10:35": 1665138900.0, "2022-10-07": 1665100800.0, "2022/10/07": 1665100800.0,
        "10/07/2022 10:35:19": 1665138919.0, "10/07/2022 10:35": 1665138900.0, "10/07/2022": 1665100800.0,
        "1665138919": 1665138919.0, "1665138919000": 1665138919.0, "12.5": 12.5, "bad": None, "2022-13-45": None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = df.select("t", timeparse.epoch_seconds(F.col("t"), T.StringType()).alias("s")).collect()
    assert {r.t: r.s for r in found} == texts


def test_stored_order(spark, tmp_path):
    rows = [(9 - i, i, i + 1, 1.0) for i in range(9)]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "time long, sender long, receiver long, amount double").coalesce(1).write.parquet(path)
    found = transactions.in_stored_order(Workspace(spark), spark, path).orderBy("seq")
    assert [r.sender for r in found.collect()] == list(range(9))


def test_csv_sink_replaces(spark, tmp_path):
    row = (1.0, "1", "1", "2", 5.0, 3.5, "HIGH", 2.0, 5.0, 1.0, 0.0, 0.0, 0.0)
    alerts = spark.createDataFrame([row], sinks.ALERT_SCHEMA)
    for _ in range(2):
        sinks.write_alerts(alerts, str(tmp_path / "a"))
    assert [tuple(r) for r in sinks.read_alerts(spark, str(tmp_path / "a")).collect()] == [row]
