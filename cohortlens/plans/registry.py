"""Registered queries: one Spark plan per operator over the driver tables, each
paired with an independent DuckDB SQL oracle where the result is exact.

``QUERIES[name](spark, sf_dir) -> DataFrame``; ``ORACLE[name]`` is SQL over
the clinical role views of :mod:`cohortlens.plans.roles` (prefixed as CTEs
by :func:`oracle_sql`).  Doubles that come out of floating-point sums are
rounded to 6 places on both sides (order of summation differs).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlens.plans.roles import with_roles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a Spark plan under ``name`` with an optional exact SQL oracle."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c):
    return F.round(c, 6)


def load_all() -> None:
    """Import every query module (each registers itself)."""
    from cohortlens.plans import (  # noqa: F401
        feature_queries, cohort_queries, join_queries, analysis_queries, model_queries, io_queries,
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load_all()
    return {k: with_roles(v, "duckdb") for k, v in ORACLE.items()}
