"""Nearest-interval join with stays of any length, and the largest gap: against brute force."""

import datetime as dt
import random

import pytest

from cohortlens.operators import joins
from cohortlens.operators.neighbors import largest_gap_value

T0 = dt.datetime(2001, 1, 1)
HOUR = dt.timedelta(hours=1)
LAB = "labevent_id long, subject_id long, charttime timestamp_ntz, note string, value decimal(30,2)"
ADM = "subject_id long, hadm_id long, admittime timestamp_ntz, dischtime timestamp_ntz, ward string"


def brute(labs, stays, buffer=24 * HOUR):
    out = {}
    for key, subject, at, *_ in labs:
        ok = [(abs(a - at), a, h) for s, h, a, d, _ in stays
              if None not in (subject, at, a, d) and s == subject and a - buffer <= at <= d + buffer]
        if ok:
            out[key] = min(ok)[2]
    return out


def test_stays_from_an_hour_to_thirty_years(spark):
    rng = random.Random(4)
    stays, labs = [], []
    for h in range(120):
        start = T0 + rng.randrange(30 * 365 * 24) * HOUR
        length = rng.choice([1, 12, 100, 24 * 40, 24 * 365, 24 * 365 * 30])
        stays.append((rng.randrange(4), h, start, start + length * HOUR, f"w{h}"))
    stays += [(1, 500, T0, T0 + 30 * 365 * 24 * HOUR, "a"), (1, 499, T0, T0 + 9 * HOUR, "b"), (2, 600, T0, None, "c"),
              (2, 601, T0 + 400 * HOUR, T0, "ends before it begins"), (3, 602, dt.datetime(1930, 5, 1), dt.datetime(1960, 5, 1), "before the epoch")]
    for k in range(400):
        labs.append((k, rng.randrange(4), T0 + rng.randrange(-100, 40 * 365 * 24) * HOUR, f"n{k}", None))
    labs += [(1000, 1, T0 - 24 * HOUR, "at the edge", None), (1001, 1, T0 - 24 * HOUR - dt.timedelta(microseconds=1), "outside", None),
             (1002, None, T0, "", None), (1003, 1, None, "", None), (1004, 3, dt.datetime(1945, 1, 1), "old", None)]
    want = brute(labs, stays)
    ldf, adf = spark.createDataFrame(labs, LAB), spark.createDataFrame(stays, ADM)
    for hours in (24, 5):
        got = joins.nearest_admission(ldf, adf, bucket_hours=hours).collect()
        assert {r.labevent_id: r.hadm_id for r in got} == want and len(want) > 300
        assert all(r.ward is not None and (r.note == f"n{r.labevent_id}" or r.labevent_id >= 1000) for r in got)


def test_a_long_stay_is_a_few_rows(spark):
    stay = spark.createDataFrame([(1, 1, T0, T0 + 30 * 365 * 24 * HOUR, "a")], ADM)
    labs = spark.createDataFrame([(k, 1, T0 + k * 500 * HOUR, "", None) for k in range(500)], LAB)
    out = joins.nearest_admission(labs, stay)
    assert out.count() == 500
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 2
    width = spark.range(1).select(joins._cell_width(joins.F.lit(30 * 365 * 24 * 3_600_000_000), 24 * 3_600_000_000)).first()[0]
    assert 30 * 365 * 24 * 3_600_000_000 <= joins.COVER * width


def test_no_stays_and_no_labs(spark):
    labs, stays = spark.createDataFrame([(1, 1, T0, "", None)], LAB), spark.createDataFrame([(1, 1, T0, T0, "a")], ADM)
    assert joins.nearest_admission(labs, stays.limit(0)).count() == 0
    assert joins.nearest_admission(labs.limit(0), stays).count() == 0


def sorted_gap(values):
    v = sorted(values)
    return None if len(v) < 2 else v[max(range(1, len(v)), key=lambda i: (v[i] - v[i - 1], -i))]


@pytest.mark.parametrize("group", [4, 4096])
def test_largest_gap_equals_a_sort(spark, group):
    rng = random.Random(1)
    cases = [[rng.random() ** 4 for _ in range(500)], [float(i) for i in range(50)], [2.5] * 7, [1.0, 2.0], [3.0], [],
             [0.1] * 300 + [rng.gauss(0, 1) for _ in range(300)], [1e300, -1e300, 0.0], [0.0, 1e-300, 1.0, 1.0]]
    for v in cases:
        got = largest_gap_value(spark.createDataFrame([(x,) for x in [*v, None, float("nan")]], "v double"), "v", group)
        assert got == sorted_gap(v), v
    inf = float("inf")
    for v, want in (([1.0, inf, inf], inf), ([-inf, 2.0, 5.0], 2.0), ([inf, inf], inf)):
        assert largest_gap_value(spark.createDataFrame([(x,) for x in v], "v double"), "v", group) == want
