"""Distributed exact quantiles / modes equal Spark's buffered aggregates."""

import random

import pytest
from pyspark.sql import functions as F

from cohortlens.functions.quantiles import exact_mode, exact_quantiles


@pytest.mark.parametrize("buckets", [2, 7, 512])
def test_exact_quantiles_match_percentile(spark, buckets):
    rnd = random.Random(7)
    rows = [(g, float(rnd.choice([rnd.randint(0, 20), rnd.random() * 50]))) for g in range(4) for _ in range(
        [1, 2, 57, 400][g])]
    rows += [(4, 3.0)] * 100 + [(4, None)] * 3            # one value only, plus nulls
    df = spark.createDataFrame(rows, "g int, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {(r["g"], r["p"]): r["quantile"] for r in exact_quantiles(df, ["g"], "v", probs, buckets).collect()}
    ref = df.groupBy("g").agg(F.percentile("v", probs).alias("q")).collect()
    want = {(r["g"], p): q for r in ref for p, q in zip(probs, r["q"])}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    glob = exact_quantiles(df, [], "v", [0.5], buckets).first()["quantile"]
    assert abs(glob - df.agg(F.percentile("v", 0.5)).first()[0]) < 1e-9


def test_exact_mode(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (1, 1.0), (1, 1.0), (1, 5.0), (2, 9.0), (2, None)],
                               "g int, v double")
    assert {r["g"]: r["mode"] for r in exact_mode(df, ["g"], "v").collect()} == {1: 1.0, 2: 9.0}
    assert exact_mode(df, [], "v").first()["mode"] == 1.0


def test_null_groups_form_their_own_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, v double")
    got = {r["g"]: r["quantile"] for r in exact_quantiles(df, ["g"], "v", [0.5]).collect()}
    assert got == {None: 2.0, "a": 5.0}
