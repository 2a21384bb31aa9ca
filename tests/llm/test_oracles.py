"""Every query with SQL matches it, value by value, on a small table."""

import os

import duckdb
import pytest

from cohortlens.llm import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "documents benchmark labels embeddings".split()


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_matches_sql(spark, name):
    df = Q.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = db.execute("select " + ", ".join(cols) + f" from ({Q.oracle_sql()[name]})").fetchall()
    assert got == sorted((tuple(r) for r in want), key=repr)


def test_every_operator_is_registered():
    names = {n.split("_")[0] for n in Q.queries()}
    assert names == {f"op{i}" for i in range(1, 14)}
    assert os.path.exists(SF)
