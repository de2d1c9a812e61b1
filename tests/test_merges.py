from __future__ import annotations

import random

import pytest
import reference_models as model
from pyspark.sql import functions as F

from ledgerweave.functions import scoring
from ledgerweave.operators import intervals, mergetree, merges
from ledgerweave.operators import components as C
from ledgerweave.workspace import Workspace


def transfers(n=150, accounts=60, seed=7):
    rng = random.Random(seed)
    return [
        (i + 1, rng.choice([0, rng.randint(0, accounts)]), rng.randint(0, accounts), rng.choice([-5.0, 0.5, rng.uniform(1, 900)]))
        for i in range(n)
    ]


def as_txn(spark, rows):
    df = spark.createDataFrame(rows, "seq long, sender long, receiver long, amount double")
    return df.select("seq", F.timestamp_seconds("seq").alias("ts"), F.col("seq").cast("double").alias("tnum"), "sender", "receiver", "amount")


def scores(df) -> dict:
    return {
        r.seq: (r.root, r.edges, r.distinct, r.out_hh, r.density, r.z_distinct, r.z_out_hh, r.z_density)
        for r in df.collect()
    }


def test_scores_equal_a_sequential_replay(spark):
    rows = transfers(400, 300)
    found = merges.merge_scores(Workspace(spark), as_txn(spark, rows))
    assert model.same_scores(scores(found), model.merge_scores(rows))


@pytest.mark.parametrize("seed", range(2))
def test_chains_in_slices_and_blocks_equal_a_replay(spark, seed):
    rows = transfers(260, 90, seed)
    found = merges.merge_scores(Workspace(spark), as_txn(spark, rows), group_rows=30, block=5)
    assert model.same_scores(scores(found), model.merge_scores(rows))


def test_components_beyond_the_history(spark):
    """One component that outgrows the history by single accounts, by pairs and by large parts."""
    rng, pairs = random.Random(3), [(i, i + 1) for i in range(1_000, 1_700, 2)]
    pairs += [(2_000, 2_000 + i) for i in range(1, 700)] + [(0, i) for i in range(1, 400)]
    rng.shuffle(pairs)
    pairs += [(0, i) for i in range(1_000, 1_700, 2)] + [(2_000, 5)] + [(i, 0) for i in range(3_000, 3_300)]
    rows = [(i + 1, u, v, rng.uniform(1, 900)) for i, (u, v) in enumerate(pairs)]
    expected = model.merge_scores(rows)
    for block in (65_536, 300):
        found = merges.merge_scores(Workspace(spark), as_txn(spark, rows), block=block)
        assert model.same_scores(scores(found), expected)


def test_chains_are_few(spark):
    """Whatever the shape, an account passes through at most one chain a round."""
    path = [(i, i + 1) for i in range(512)]
    halves = sorted(path, key=lambda e: ((e[0] + 1) & -(e[0] + 1), e[0]))
    for edges in (path, path[::-1], halves):
        ws = Workspace(spark)
        txn = as_txn(spark, [(i + 1, u, v, 1.0) for i, (u, v) in enumerate(edges)])
        tree = mergetree.merge_tree(ws, C.merge_forest(ws, txn))
        longest, accounts = tree.places.agg(F.max(F.size("steps")), F.count("*")).first()
        assert accounts == 513 and longest <= 11


def test_alert_columns_and_filter(spark):
    scored = merges.merge_scores(Workspace(spark), as_txn(spark, transfers(60, 20)))
    alerts = merges.alerts(scored)
    assert alerts.columns == "time root src dst amount S level distinct out_hh density z_distinct z_out_hh z_density".split()
    assert alerts.count() == scored.count()
    assert {r.level for r in merges.alerts(scored, "MED").collect()} <= {"MED", "HIGH"}


def test_levels_and_reasons(spark):
    df = spark.createDataFrame([(3.0, 0.0, 0.0), (1.9, 2.0, 2.5), (2.0, 2.0, 2.0), (0.0, 0.0, 0.0)], "a double, b double, c double")
    z = [F.col(c) for c in "abc"]
    found = df.select(scoring.level(F.col("a")), scoring.reason(*z), scoring.level_marker(scoring.level(F.col("a")))).collect()
    assert [tuple(r) for r in found] == [
        ("HIGH", "group growth", "red"),
        ("LOW", "outflow concentration + dense group", "green"),
        ("MED", "growth + concentration + density (highly suspicious)", "orange"),
        ("LOW", "steady", "green"),
    ]


def test_robust_z_uses_the_upper_median(spark):
    df = spark.createDataFrame([(9.0, [1.0, 4.0, 2.0, 3.0]), (5.0, [])], "x double, h array<double>")
    found = [r[0] for r in df.select(scoring.robust_z(F.col("x"), F.col("h"))).collect()]
    assert found == pytest.approx([(9 - 3) / 1.4826, 0.0])


def test_hot_interval_scores_equal_plain(spark):
    ws = Workspace(spark)
    txn = ws.write(as_txn(spark, transfers(200, 40)))
    members = ws.write(C.components(ws, txn))
    found = [
        sorted(map(tuple, intervals.interval_scores(ws, txn, members, 5, 6, rows).collect())) for rows in (1_000_000, 20)
    ]
    assert len(found[0]) == len(found[1])
    for a, b in zip(*found):
        assert a[:-2] == pytest.approx(b[:-2]) and a[-1] == b[-1]


def test_edges_after_the_last_merge_are_not_summed(spark):
    """Once a component is whole, its edges are dropped before the windows; scores stay those of all edges."""
    rows = transfers(400, 12, seed=5)
    ws = Workspace(spark)
    txn = ws.write(as_txn(spark, rows))
    forest = C.merge_forest(ws, txn)
    tree = mergetree.merge_tree(ws, forest)
    last = max(r.last_seq for r in tree.places.collect())
    marked = merges.mark_merges(ws, txn, forest, tree)
    assert 0 < ws.rows(marked) <= last < len(rows)
    assert ws.rows(merges.mark_merges(ws, txn, forest, tree, to_the_end=True)) == len(rows)
    assert model.same_scores(scores(merges.merge_scores(ws, txn, forest)), model.merge_scores(rows))
