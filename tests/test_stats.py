from __future__ import annotations

import random
from collections import defaultdict

import pytest
import reference_models as model

from pyspark.sql import functions as F

from ledgerweave.operators import centrality, features, hyperball, pairs, refine, sketches, stats
from ledgerweave.operators import components as C
from ledgerweave.plans.queries import QUERIES
from ledgerweave.workspace import Workspace
from test_merges import as_txn, transfers


@pytest.fixture(scope="module")
def graph(spark):
    ws = Workspace(spark)
    rows = transfers(160, 60, seed=11)
    txn = ws.write(as_txn(spark, rows))
    return ws, rows, txn, ws.write(C.components(ws, txn))


def test_component_stats(graph):
    ws, rows, txn, members = graph
    name = model.components([(u, v) for _, u, v, _ in rows])
    edges, flow = defaultdict(int), defaultdict(float)
    for _, u, _, w in rows:
        edges[name[u]] += 1
        flow[name[u]] += max(1.0, w)
    for r in stats.component_stats(txn, members).collect():
        assert r.accounts == sum(1 for c in name.values() if c == r.component)
        assert (r.edges, r.out_flow, r.in_flow) == pytest.approx((edges[r.component], flow[r.component], flow[r.component]))


def test_count_min_never_understates_and_merges(graph):
    ws, rows, txn, members = graph
    exact = defaultdict(int)
    for _, u, _, w in rows:
        exact[u] += int(max(1.0, w))
    cells = sketches.cms_cells(txn, members, width=8, depth=3)
    for r in sketches.cms_query(cells, members, width=8, depth=3).collect():
        assert r.estimate >= exact[r.account]
    parts = [sketches.cms_cells(txn.where(f"seq % 2 = {i}"), members, width=8, depth=3) for i in (0, 1)]
    assert sketches.merge_cms(*parts).exceptAll(cells).count() == 0


def test_kmv_merges_and_is_near(spark):
    members = spark.range(20_000).selectExpr("id AS account", "id % 2 AS component")
    whole = sketches.kmv_samples(members, 128)
    parts = [sketches.kmv_samples(members.where(f"account % 3 = {i}"), 128) for i in range(3)]
    merged = sketches.merge_kmv(sketches.merge_kmv(parts[0], parts[1]), parts[2])
    assert merged.exceptAll(whole).count() == 0
    for r in sketches.kmv_estimate(whole, 128).collect():
        assert abs(r.estimate - 10_000) < 4 * r.rel_error_theory * 10_000


def test_sketches_take_string_accounts(spark):
    members = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c")], "account string, component string")
    found = sketches.kmv_estimate(sketches.kmv_samples(members, 4), 4).collect()
    assert {r.component: r.estimate for r in found} == {"a": 2.0, "c": 1.0}


def test_sketches_keep_wide_ids_apart(spark):
    ids = [1, 1 + 2**31 - 1, 1 + 2 * (2**31 - 1), 10**13, 10**13 + 2**44 - 17, -5, 2**63 - 1, -(2**63)]
    members = spark.createDataFrame([(i, 0) for i in ids], "account long, component long")
    assert sketches.kmv_samples(members, 100).count() == len(ids)
    txn = spark.createDataFrame([(i, 0, float(n + 1)) for n, i in enumerate(ids)], "sender long, receiver long, amount double")
    cells = sketches.cms_cells(txn, members, width=4096, depth=4)
    found = {r.account: r.estimate for r in sketches.cms_query(cells, members, width=4096, depth=4).collect()}
    assert found == {i: n + 1 for n, i in enumerate(ids)}


def test_repeated_members_count_once(spark):
    members = spark.range(50).selectExpr("id AS account", "0L AS component")
    samples = sketches.kmv_samples(members.union(members).union(members), 16)
    assert samples.count() == 16 and samples.exceptAll(sketches.kmv_samples(members, 16)).count() == 0


def test_count_min_bound_holds_in_all_but_delta(spark):
    """Ids in steps, as dependent rows would fail on: overestimates beyond e / width of the total stay rare."""
    members = spark.range(6_000).selectExpr("id * 4096 + 10000000000 AS account", "0L AS component")
    txn = members.selectExpr("account AS sender", "account AS receiver", "cast(1 + account / 4096 % 7 AS double) AS amount")
    total = txn.selectExpr("sum(floor(amount))").first()[0]
    cells = sketches.cms_cells(txn, members, width=64, depth=3)
    asked = sketches.cms_query(cells, members, width=64, depth=3).collect()
    over = [r.estimate - int(1 + r.account // 4096 % 7) for r in asked]
    assert min(over) >= 0 and sum(o > 2.7183 / 64 * total for o in over) / len(over) <= 0.0498


def test_amounts_that_are_no_numbers(spark):
    rows = [(1, 2, a) for a in (float("nan"), float("inf"), float("-inf"), None, 1e300, -3.0, 2.9)]
    txn = spark.createDataFrame(rows, "sender long, receiver long, amount double")
    found = {r.account: r for r in stats.account_flow(txn).collect()}
    assert found[1].out_whole == found[2].in_whole == 2**53 + 5 + 2


def test_reciprocal_pairs(graph):
    _, rows, txn, _ = graph
    directed = {(u, v) for _, u, v, _ in rows if u != v}
    found = {tuple(r) for r in pairs.reciprocal_pairs(txn).collect()}
    assert found == {(u, v) for u, v in directed if (v, u) in directed}


@pytest.mark.parametrize("search_rows", [10**9, 2000])
def test_closeness_and_betweenness(graph, search_rows):
    ws, rows, txn, members = graph
    expected = model.centrality([(u, v) for _, u, v, _ in rows])
    found = centrality.closeness_betweenness(ws, txn, members, search_rows, 40 if search_rows == 2000 else 10**6)
    got = {r.account: (r.closeness, r.betweenness) for r in found.collect()}
    assert got.keys() == expected.keys()
    for account in expected:
        assert got[account] == pytest.approx(expected[account])


def test_bridge_ends_carry_all_paths(spark):
    left = [(i, j) for i in range(6) for j in range(i)]
    edges = left + [(i + 6, j + 6) for i, j in left] + [(0, 6)]
    rows = [(n + 1, u, v, 1.0) for n, (u, v) in enumerate(edges)]
    ws = Workspace(spark)
    txn = as_txn(spark, rows)
    found = centrality.closeness_betweenness(ws, txn, C.components(ws, txn)).collect()
    assert {r.account: r.betweenness for r in found} == pytest.approx({i: 30.0 if i in (0, 6) else 0.0 for i in range(12)})


@pytest.mark.parametrize("search_rows, folds", [(10**9, 16), (2000, 0)])
def test_betweenness_from_all_accounts_is_exact(graph, search_rows, folds):
    ws, rows, txn, members = graph
    group_rows = 40 if search_rows == 2000 else 10**6
    expected = {a: b for a, (_, b) in model.centrality([(u, v) for _, u, v, _ in rows]).items()}
    whole = centrality.pivot_betweenness(ws, txn, members, 10**3, folds, search_rows, group_rows).collect()
    assert {r.account: r.betweenness for r in whole} == pytest.approx(expected)
    assert {r.error for r in whole} == {0.0}


def test_betweenness_from_pivots(spark):
    """Shares are heavy-tailed, so three standard errors hold 90 % of the figures on average over draws, 80 % at the least."""
    rng = random.Random(8)
    edges = [(i, rng.randrange(90)) for i in range(90) for _ in range(3)]
    ws = Workspace(spark)
    txn = ws.write(as_txn(spark, [(n + 1, u, v, 1.0) for n, (u, v) in enumerate(edges)]))
    members = ws.write(C.components(ws, txn))
    expected = {a: b for a, (_, b) in model.centrality(edges).items()}
    some = centrality.pivot_betweenness(ws, txn, members, 30).collect()
    assert {r.pivots for r in some} == {30} and {r.account for r in some} == set(expected)
    near = [abs(r.betweenness - expected[r.account]) <= 3 * r.error + 1e-9 for r in some]
    assert sum(near) >= 0.8 * len(near)
    assert sum(r.betweenness for r in some) == pytest.approx(sum(expected.values()), rel=0.1)


def test_trees_need_no_pivots(spark):
    """A tree folds into one account, so its figures are exact whatever the pivots; so are those of a long tail in part."""
    rng = random.Random(2)
    edges = [(i, rng.randrange(i)) for i in range(1, 60)] + [(100, 101)] + [(200 + i, 201 + i) for i in range(9)]
    ws = Workspace(spark)
    txn = ws.write(as_txn(spark, [(n + 1, u, v, 1.0) for n, (u, v) in enumerate(edges)]))
    members = ws.write(C.components(ws, txn))
    expected = {a: b for a, (_, b) in model.centrality(edges).items()}
    found = centrality.pivot_betweenness(ws, txn, members, 2, folds=40).collect()
    assert {r.account: r.betweenness for r in found} == pytest.approx(expected)


def test_pivots_of_accounts_alone(spark):
    ws = Workspace(spark)
    txn = ws.write(as_txn(spark, [(1, 5, 5, 1.0), (2, 6, 6, 1.0)]))
    members = ws.write(C.components(ws, txn))
    found = centrality.pivot_betweenness(ws, txn, members, 1).collect()
    assert sorted(map(tuple, found)) == [(5, 1, 0.0, 0.0), (6, 1, 0.0, 0.0)]
    assert sorted(map(tuple, hyperball.closeness_sketch(ws, txn, members).collect())) == [(5, 0.0, 0.0), (6, 0.0, 0.0)]


@pytest.mark.parametrize("group_rows", [10**6, 40])
def test_closeness_from_sketches(graph, group_rows):
    """Small components are counted without error."""
    ws, rows, txn, members = graph
    expected = {a: c for a, (c, _) in model.centrality([(u, v) for _, u, v, _ in rows]).items()}
    found = hyperball.closeness_sketch(ws, txn, members, group_rows=group_rows).collect()
    assert {r.account: r.closeness for r in found} == pytest.approx(expected, rel=1e-9)


@pytest.mark.parametrize("exact_accounts, group_rows", [(10, 40), (0, 10**6)])
def test_features_of_small_and_large_components(graph, exact_accounts, group_rows):
    """With all accounts as pivots and sparse sketches the estimated forms are exact, so both sides equal the plain search."""
    ws, rows, txn, members = graph
    edges = [(u, v) for _, u, v, _ in rows]
    expected, name = model.centrality(edges), model.components(edges)
    sizes = defaultdict(int)
    for component in name.values():
        sizes[component] += 1
    found = features.account_features(ws, txn, members, exact_accounts, 10**3, group_rows=group_rows).collect()
    assert len(found) == len(expected) and {r.account for r in found} == set(expected)
    directed = {(u, v) for u, v in edges if u != v}
    for r in found:
        assert (r.closeness, r.betweenness) == pytest.approx(expected[r.account], rel=1e-9)
        assert r.component == name[r.account]
        assert r.degree == sum(r.account in e for e in directed)
        assert r.betweenness_error == 0
        # An account alone is known without a sketch.
        assert (r.closeness_error > 0) == (sizes[r.component] > max(exact_accounts, 1))


def test_closeness_of_a_large_component(spark):
    """1,500 accounts with sketches of 256 registers: nearly all within three standard errors, all within five."""
    rng = random.Random(4)
    edges = [(i, rng.randrange(i // 2, i)) for i in range(1, 1500)] + [(rng.randrange(1500), rng.randrange(1500)) for _ in range(500)]
    ws = Workspace(spark)
    txn = ws.write(as_txn(spark, [(n + 1, u, v, 1.0) for n, (u, v) in enumerate(edges)]))
    members = ws.write(C.components(ws, txn))
    expected = {a: c for a, (c, _) in model.centrality(edges).items()}
    found = hyperball.closeness_sketch(ws, txn, members, lg_k=8).collect()
    assert len(found) == 1500
    off = [abs(r.closeness - expected[r.account]) / r.error for r in found]
    assert max(off) < 5 and sum(x <= 3 for x in off) >= 0.95 * len(off)
    assert max(r.error / r.closeness for r in found) < 0.5


def test_refine_blocks_and_fallback(spark):
    rows = [(1, 1, 2, 5.0), (2, 2, 1, 5.0), (3, 2, 3, 5.0), (4, 1, 1, 2.0), (5, 8, 9, 5.0), (6, 8, 8, 1.0)]
    ws = Workspace(spark)
    txn = ws.write(as_txn(spark, rows))
    members = ws.write(C.components(ws, txn))
    found = refine.refine(ws, txn, members, members.select("component").distinct())
    got = {(r.component, r.block, r.refined): (r.accounts, r.edges, r.out_flow) for r in found.blocks.collect()}
    assert got == {(1, 1, True): (2, 3, 12.0), (8, 8, False): (2, 2, 6.0)}
    # The window cut hides the first transfer of the pair.
    cut = refine.refine(ws, txn, members, members.select("component").distinct(), component_edges=3)
    assert {(r.component, r.refined) for r in cut.blocks.collect()} == {(1, False), (8, False)}


def test_refine_with_hot_components(spark):
    rng = random.Random(9)
    rows = [(i + 1, rng.randint(0, 12), rng.randint(0, 12), 2.0) for i in range(120)]
    ws = Workspace(spark)
    txn = ws.write(as_txn(spark, rows))
    members = ws.write(C.components(ws, txn))
    flagged = members.select("component").distinct()
    found = [
        sorted(map(tuple, refine.refine(ws, txn, members, flagged, component_edges=50, group_rows=g).blocks.collect()))
        for g in (10**6, 30)
    ]
    assert found[0] == found[1]


def test_refine_looks_back_on_all_edges(spark):
    """The only two-way pair lies before two million later edges of its component."""
    rows = spark.range(1, 2_000_100).select(
        F.col("id").alias("seq"), F.when(F.col("id") == 2, 2).otherwise(1).alias("sender"),
        F.when(F.col("id") == 1, 2).when(F.col("id") == 2, 1).otherwise(3).alias("receiver"), F.lit(2.0).alias("amount"),
    )
    ws = Workspace(spark)
    txn = ws.write(rows)
    members = ws.write(C.components(ws, txn))
    found = refine.refine(ws, txn, members, members.select("component").distinct()).blocks
    assert [tuple(r) for r in found.collect()] == [(1, 1, True, 2, 2, 4.0, 2.0)]


def test_refine_blocks_sees_each_component_whole(spark, tmp_path):
    """Customer 1 and 2 pay each other first; fifty later transfers go one way."""
    orders = spark.range(52).select(
        F.col("id").alias("o_orderkey"), F.when(F.col("id") == 1, 2).otherwise(1).cast("long").alias("o_custkey"),
        F.timestamp_seconds(F.col("id") * 86_400).alias("o_orderdate"),
    )
    lines = spark.range(52).select(
        F.col("id").alias("l_orderkey"), F.when(F.col("id") == 0, 2).when(F.col("id") == 1, 1).otherwise(3).cast("long").alias("l_partkey"),
        F.lit(0).cast("long").alias("l_suppkey"), F.lit(1).alias("l_linenumber"), F.lit(5.0).alias("l_extendedprice"),
    )
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    found = QUERIES["refine_blocks"](spark, str(tmp_path))
    assert [tuple(r) for r in found.collect()] == [(1, 1, True, 2, 2, 10.0, 2.0)]
