"""Every registered query against its comparison SQL."""

import pytest

import __spark_entry__ as contract
from flightseal.workload import registry
from tests.compare import connect, difference
from tests.conftest import SF

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()
# Queries whose windows, running sums or samples take another plan on long flights.
CUT = ["features_all", "phase_fill", "audit_time_order", "thin", "metrics_table", "per_type_row", "pooled_baseline", "stratified_sample", "features_unclear_order"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_comparison_sql():
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLE) <= set(contract.oracle_sql())
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, con, name):
    assert difference(spark, con, QUERIES[name], ORACLE[name], SF) is None


@pytest.mark.parametrize("name", CUT)
def test_query_with_cut_flights(spark, con, name):
    spark.conf.set("spark.flightseal.windowRows", "16")
    try:
        assert difference(spark, con, QUERIES[name], ORACLE[name], SF) is None
    finally:
        spark.conf.unset("spark.flightseal.windowRows")


def test_entry(spark):
    got = contract.entry(spark)
    assert got.count() == 1000 and len(got.columns) == 27


def test_features_read_only_needed_columns(spark):
    plan = QUERIES["feat_time"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("ReadSchema") :]
    assert "value" not in scan.split("\n")[0]
