"""Driver contract and reference SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, duck_connection


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert {r["scope"] for r in rows} == {"citywide", "euluc_scoped"}


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150


@pytest.mark.parametrize("name", ["a5_coverage", "j3_best_overlap", "j6_nearest_building", "j11_same_model_clusters", "b4_parcel_features",
                                  "a27_scope_diagnostics", "p6_incremental_ingest", "s9_poi_union"])
def test_query_equals_reference_sql(spark, small, name):
    text, ok = compare(spark, duck_connection(small), name, entry.queries()[name], entry.oracle_sql()[name], small)
    assert ok, text


def test_no_cartesian_in_spatial_joins(spark, small):
    for name in ("j1_parcel_join", "j3_best_overlap", "j8_neighbour_pairs", "j10_same_model_pairs"):
        plan = entry.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin BuildRight, Inner, (" not in plan, name
