from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ledgerweave.operators import ordering
from ledgerweave.operators.skew import hot_keys, lookup
from ledgerweave.workspace import Workspace


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds a third of the rows."""
    rng = random.Random(3)
    rows = [(i + 1, 0 if i % 3 == 0 else rng.randint(1, 60), rng.randint(1, 9)) for i in range(900)]
    return spark.createDataFrame(rows, "seq long, key long, value long").repartition(5, "value").persist()


@pytest.fixture(scope="module")
def hot(spark, skewed):
    found = hot_keys(Workspace(spark), skewed, "key", group_rows=100)
    assert [(r.key, r.slices) for r in found.collect()] == [(0, 3)]
    return found


def same(a, b):
    one, two = (sorted(df.select(*sorted(df.columns)).collect(), key=repr) for df in (a, b))
    return one == two


def test_no_hot_keys_in_a_small_table(spark, skewed):
    assert hot_keys(Workspace(spark), skewed, "key") is None


def test_numbers_are_consecutive_in_order(spark, skewed):
    ws = Workspace(spark)
    numbered = ordering.number_rows(ws, skewed.drop("seq"), [F.desc("value"), "key"], "n").orderBy("n").collect()
    assert [r.n for r in numbered] == list(range(1, 901))
    assert [(-r.value, r.key) for r in numbered] == sorted((-r.value, r.key) for r in numbered)


def test_equal_rows_are_spread_over_ranges(spark):
    ws = Workspace(spark)
    numbered = ordering.number_rows(ws, spark.range(1000).select(F.lit(1).alias("x")), ["x"], "n")
    assert sorted(r.n for r in numbered.collect()) == list(range(1, 1001))


def test_prefix_sums(spark, skewed):
    found = ordering.prefix_sums(Workspace(spark), skewed, ["seq"], {"upto": "value"}).orderBy("seq").collect()
    total = 0
    for row in found:
        total += row.value
        assert row.upto == total


def test_hot_running_sum_equals_plain(skewed, hot):
    plain = ordering.running_sum(skewed, "key", "seq", "value", "total")
    assert same(ordering.running_sum(skewed, "key", "seq", "value", "total", hot, slice_rows=70), plain)


def test_hot_latest_equals_plain(skewed, hot):
    plain = ordering.latest(skewed, "key", "seq", 120)
    assert plain.where("key = 0").count() == 120
    assert same(ordering.latest(skewed, "key", "seq", 120, hot, slice_rows=70), plain)


def test_hot_trailing_equals_plain(skewed, hot):
    def text(df):
        return df.withColumn("past", F.to_json("past"))

    plain = ordering.trailing(skewed, "key", "seq", ["value"], 7, "past")
    cut = ordering.trailing(skewed, "key", "seq", ["value"], 7, "past", hot, slice_rows=70, block=20)
    assert same(text(cut), text(plain))


def test_hot_lookup_equals_plain(spark, skewed, hot):
    names = spark.range(0, 50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("double"))
    for how in ("left", "inner"):
        assert same(lookup(skewed, "key", names, "k", "seq", hot, how), lookup(skewed, "key", names, "k", "seq", None, how))
