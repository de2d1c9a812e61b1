"""Registered queries against their SQL on the smallest tables.

``tests/check_oracle.py`` runs all of them at any scale; here the quick ones run
unless LEDGERWEAVE_ALL is set.
"""

from __future__ import annotations

import os

import pytest
from check_oracle import database, difference

import __spark_entry__ as entry
from ledgerweave.plans import oracle
from ledgerweave.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
QUICK = [
    "txn_normalised", "time_normalise", "account_flow", "running_outflow", "entity_contract", "component_graph",
    "kmv_by_region", "reciprocal_pairs", "temporal_split", "split_except", "category_index", "confusion",
    "class_metrics", "class_support", "auc", "component_stats", "cms_flow", "stream_windowed_flow",
    "large_merge_scores", "large_summary_every", "robust_z", "sketch_merge", "nearest_risk", "encoded_features", "feature_slots",
    "pivot_betweenness",
]
NAMES = [n for n in entry.oracle_sql() if os.environ.get("LEDGERWEAVE_ALL") or n in QUICK]


@pytest.fixture(scope="module")
def con():
    return database(SF_DIR)


def test_every_query_but_the_ablation_has_sql():
    assert set(QUERIES) - set(oracle.oracle_sql()) == {"ablation"}
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    assert difference(entry.queries()[name](spark, SF_DIR), con, entry.oracle_sql()[name]) is None


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 10 and rows[0].accounts >= rows[-1].accounts
