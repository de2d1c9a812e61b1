from __future__ import annotations

import random

import pytest
import reference_models as model
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerweave.operators import components as C
from ledgerweave.workspace import Workspace

EDGES = "sender long, receiver long"


def found(df) -> dict:
    return {r.account: r.component for r in df.collect()}


def check(spark, edges, group_rows=1_000_000):
    df = spark.createDataFrame(edges, EDGES)
    assert found(C.components(Workspace(spark), df, group_rows=group_rows)) == model.components(edges)


@pytest.mark.parametrize(
    "edges",
    [
        [(5, 5)],
        [(7, 3)],
        [(100, i) for i in range(50)],  # the centre is the largest
        [(0, i) for i in range(1, 50)],
        [(i, i + 1) for i in range(30)] + [(30, 0)],
    ],
    ids=["loop", "edge", "high star", "star", "cycle"],
)
def test_shapes(spark, edges):
    check(spark, edges)


def test_no_edges(spark):
    assert found(C.components(Workspace(spark), spark.createDataFrame([], EDGES))) == {}


def test_long_path_takes_few_rounds(spark):
    ws = Workspace(spark)
    path = spark.range(10_000).select(F.col("id").alias("sender"), (F.col("id") + 1).alias("receiver"))
    members = C.components(ws, path)
    assert members.agg(F.count("*"), F.max("component")).first()[:] == (10_001, 0)
    assert len(ws._written) < 20


def test_shuffled_path(spark):
    names = list(range(300))
    random.Random(1).shuffle(names)
    check(spark, list(zip(names, names[1:])))


def test_hot_keys_are_split(spark):
    rng = random.Random(2)
    edges = [(0, rng.randint(1, 120)) for _ in range(120)] + [(rng.randint(121, 300), rng.randint(121, 300)) for _ in range(90)]
    check(spark, edges, group_rows=20)


def test_string_accounts(spark):
    edges = [("b", "a"), ("c", "b"), ("x", "y")]
    df = spark.createDataFrame(edges, "sender string, receiver string")
    assert found(C.components(Workspace(spark), df)) == model.components(edges)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), min_size=1, max_size=40), st.randoms())
def test_forest_equals_sequential_union(spark, edges, rng):
    rows = [(i + 1, u, v) for i, (u, v) in enumerate(edges)]
    expected = model.merge_events(rows)
    rng.shuffle(rows)
    forest = C.merge_forest(Workspace(spark), spark.createDataFrame(rows, f"seq long, {EDGES}"))
    members = model.components(edges)
    assert sorted(r.seq for r in forest.seqs.collect()) == expected
    assert found(forest.members) == members
    assert len(expected) == len(members) - len(set(members.values()))


def test_forest_with_hot_keys(spark):
    rng = random.Random(5)
    rows = [(i + 1, rng.choice([0, rng.randint(1, 80)]), rng.randint(1, 80)) for i in range(200)]
    forest = C.merge_forest(Workspace(spark), spark.createDataFrame(rows, f"seq long, {EDGES}"), group_rows=25)
    assert sorted(r.seq for r in forest.seqs.collect()) == model.merge_events(rows)


def test_forest_of_loops(spark):
    forest = C.merge_forest(Workspace(spark), spark.createDataFrame([(1, 4, 4)], f"seq long, {EDGES}"))
    assert forest.seqs.count() == 0 and found(forest.members) == {4: 4}
