from __future__ import annotations

import heapq
import random

import pytest

from ledgerweave.operators import components as C
from ledgerweave.operators import distance as D
from ledgerweave.workspace import Workspace

GOLDEN_EDGES = [(0, 2, 3.0), (1, 2, 2.0), (2, 3, 1.5), (3, 4, 2.5), (4, 5, 1.0), (5, 6, 4.0), (6, 7, 1.2)]
GOLDEN_LINKS = [(0, 1), (5, 6)]


def golden(spark):
    accounts = spark.range(8).withColumnRenamed("id", "account")
    links = spark.createDataFrame(GOLDEN_LINKS, "a long, b long")
    return accounts, links, spark.createDataFrame(GOLDEN_EDGES, "src long, dst long, w double")


def test_golden_contraction_and_projection(spark):
    ws = Workspace(spark)
    accounts, links, edges = golden(spark)
    members = C.contract_entities(ws, accounts, links)
    assert {r.account: r.component for r in members.collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7}
    between = C.project(edges, members).collect()
    assert sorted(map(tuple, between)) == [(0, 2, 2.0), (0, 2, 3.0), (2, 3, 1.5), (3, 4, 2.5), (4, 5, 1.0), (5, 7, 1.2)]


def test_golden_distances(spark):
    accounts, links, edges = golden(spark)
    source = accounts.where("account = 0")
    found = D.risk_distances(Workspace(spark), accounts, links, edges, source).collect()
    assert {r.component: round(r.distance, 9) for r in found} == {0: 0.0, 2: 2.0, 3: 3.5, 4: 6.0, 5: 7.0, 7: 8.2}


def dijkstra(edges, source):
    best, queue = {source: 0.0}, [(0.0, source)]
    while queue:
        d, u = heapq.heappop(queue)
        for a, b, w in edges:
            if a == u and d + w < best.get(b, 1e18):
                best[b] = d + w
                heapq.heappush(queue, (best[b], b))
    return best


@pytest.mark.parametrize("group_rows", [1_000_000, 15])
def test_many_sources_on_a_cyclic_graph(spark, group_rows):
    rng = random.Random(4)
    edges = [(rng.choice([0, rng.randint(0, 20)]), rng.randint(0, 20), float(rng.randint(0, 9))) for _ in range(60)]
    df = spark.createDataFrame(edges, "src long, dst long, w double")
    sources = spark.createDataFrame([(0, 0), (3, 3)], "source long, node long")
    found = D.cheapest_distances(Workspace(spark), df, sources, group_rows).collect()
    for s in (0, 3):
        assert {r.node: r.dist for r in found if r.source == s} == dijkstra(edges, s)


def test_negative_weight(spark):
    df = spark.createDataFrame([(1, 2, -1.0)], "src long, dst long, w double")
    with pytest.raises(D.NegativeWeight):
        D.cheapest_distances(Workspace(spark), df, spark.createDataFrame([(1, 1)], "source long, node long"))


def test_a_long_path_takes_few_rounds(spark):
    ws = Workspace(spark)
    edges = spark.range(2_000).selectExpr("id AS src", "id + 1 AS dst", "cast(1 + id % 3 AS double) AS w")
    found = D.cheapest_distances(ws, edges, spark.createDataFrame([(0, 0)], "source long, node long"))
    expected, at = {0: 0.0}, 0.0
    for i in range(2_000):
        at += 1 + i % 3
        expected[i + 1] = at
    assert {r.node: r.dist for r in found.collect()} == expected
    assert len(ws._written) < 25


@pytest.mark.parametrize("nearest", [False, True])
def test_chains_rings_and_cutoff_equal_a_plain_search(spark, nearest):
    rng = random.Random(6)
    edges = [(i, i + 1, rng.uniform(0.1, 3)) for i in range(40)] + [(100 + i, 100 + (i + 1) % 6, 1.0) for i in range(6)]
    edges += [(rng.randrange(41), rng.randrange(41), rng.uniform(1, 30)) for _ in range(8)] + [(5, 6, 9.0), (40, 41, 0.5), (41, 40, 0.5)]
    starts = [0, 13, 200]
    frames = spark.createDataFrame(edges, "src long, dst long, w double"), spark.createDataFrame([(s, s) for s in starts], "source long, node long")
    far = {}
    for s in starts:
        known = {s: 0.0}
        for _ in range(60):
            for u, v, w in edges:
                if u in known and known[u] + w < known.get(v, 1e9):
                    known[v] = known[u] + w
        far |= {(s, n): d for n, d in known.items() if d <= 25}
    if nearest:
        best = {}
        for (s, n), d in far.items():
            best[n] = min(best.get(n, (1e9, 0)), (d, s))
        far = {(s, n): d for n, (d, s) in best.items()}
    found = D.cheapest_distances(Workspace(spark), *frames, cutoff=25.0, nearest=nearest)
    got = {(r.source, r.node): r.dist for r in found.collect()}
    assert got.keys() == far.keys() and all(got[k] == pytest.approx(far[k]) for k in far)
