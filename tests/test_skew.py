"""Hot keys: one patient / value holding a third of all rows must give the same
answers as a plain single-machine computation."""

import datetime as dt
import random

import pandas as pd
import pytest

from cohortlens.functions.quantiles import exact_quantiles
from cohortlens.operators import features, joins


@pytest.fixture(scope="module")
def orders(spark):
    rnd = random.Random(3)
    t0 = dt.datetime(2020, 1, 1)
    rows = []
    for i in range(3000):
        p = 1 if i < 1000 else rnd.randint(2, 200)             # patient 1 holds a third of the rows
        rows.append((p, i, rnd.choice("abcdefg"), t0 + dt.timedelta(minutes=rnd.randint(0, 10_000))))
    pdf = pd.DataFrame(rows, columns=["p", "id", "o", "t"])
    return spark.createDataFrame(pdf).repartition(8), pdf


def test_hot_patient_sequences_and_counts(spark, orders):
    df, pdf = orders
    seq = {r["p"]: r["sequence"] for r in features.order_sequences(df, "p", "o", "t", 20, "id").collect()}
    want = (pdf.sort_values(["p", "t", "id"]).groupby("p")["o"].apply(lambda s: list(s)[:20]).to_dict())
    assert seq == want
    freq = {(r["p"], r["o"]): r["n"] for r in features.order_frequency(df, "p", "o", top_n=5).collect()}
    top = pdf["o"].value_counts().sort_index().sort_values(ascending=False, kind="stable").index[:5]
    ct = pd.crosstab(pdf[pdf.o.isin(top)].p, pdf[pdf.o.isin(top)].o)
    assert freq == {(p, o): int(ct.loc[p, o]) for p in ct.index for o in ct.columns}


def test_hot_value_quantiles(spark):
    vals = [(0, 5.0)] * 3000 + [(0, float(i)) for i in range(6000)] + [(1, float(i)) for i in range(10)]
    df = spark.createDataFrame(vals, "g int, v double").repartition(8)
    got = {(r["g"], r["p"]): r["quantile"] for r in exact_quantiles(df, ["g"], "v", [0.25, 0.5, 0.9]).collect()}
    pdf = pd.DataFrame(vals, columns=["g", "v"])
    for (g, p), q in got.items():
        assert q == pytest.approx(pdf[pdf.g == g].v.quantile(p))


def test_hot_subject_nearest_interval(spark):
    rnd = random.Random(5)
    t0 = dt.datetime(2020, 1, 1)
    stays = [(1, h, t0 + dt.timedelta(hours=6 * h), t0 + dt.timedelta(hours=6 * h + rnd.randint(1, 40)))
             for h in range(200)]
    labs = [(i, 1, t0 + dt.timedelta(minutes=rnd.randint(0, 200 * 6 * 60))) for i in range(3000)]
    adm = spark.createDataFrame(stays, "subject_id long, hadm_id long, admittime timestamp_ntz, "
                                       "dischtime timestamp_ntz")
    lab = spark.createDataFrame(labs, "labevent_id long, subject_id long, charttime timestamp_ntz")
    got = {r["labevent_id"]: r["hadm_id"] for r in joins.nearest_admission(lab, adm).collect()}
    day = dt.timedelta(hours=24)
    want = {}
    for lid, _, c in labs:
        cand = [(abs((a - c).total_seconds()), a, h) for _, h, a, d in stays if a - day <= c <= d + day]
        if cand:
            want[lid] = min(cand)[2]
    assert got == want
