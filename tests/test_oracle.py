"""Every query with an SQL oracle must equal DuckDB on the driver tables (sf0.001).

The driver runs the same comparison at sf0.01; this keeps the suite fast.
"""

import pytest

import __spark_entry__ as E
from tools.oracle_check import compare, duck

from conftest import SF_SMALL

ORACLE = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, QUERIES[name], ORACLE[name], SF_SMALL)
    assert r["status"] == "OK", r


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "patient" in df.columns and "total_orders" in df.columns


@pytest.fixture()
def other_plans(spark):
    """Different physical plans: 3 shuffle partitions and no size-based broadcast joins."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_result_does_not_depend_on_the_plan(other_plans, con, name):
    r = compare(other_plans, con, name, QUERIES[name], ORACLE[name], SF_SMALL)
    assert r["status"] == "OK", r
