"""Plan-shape guarantees the scale design relies on (checked on physical plans)."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

Q = E.queries()
# queries whose result is computed eagerly on the driver side (one-row model / metric
# outputs built with createDataFrame) have trivial plans; every other plan is checked.


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(Q))
def test_no_cartesian_products(spark, name):
    plan = _plan(Q[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_timing_is_a_hash_aggregate(spark):
    plan = _plan(Q["order_timing"](spark, SF_SMALL))
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_sequences_limit_before_shuffle(spark):
    plan = _plan(Q["order_sequences_poe"](spark, SF_SMALL))
    assert "WindowGroupLimit" in plan


def test_scan_prunes_columns_and_pushes_filters(spark):
    df = Q["scan_parquet"](spark, SF_SMALL)
    plan = _plan(df)
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_shipdate:timestamp_ntz>" in plan


def test_dictionary_joins_are_broadcast(spark):
    plan = _plan(Q["join_diagnosis_dict"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in plan
