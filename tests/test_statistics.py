"""Tests that never fail or mislead: constant features, one-row groups, many categories, large degrees of freedom."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import distributions as D
from cohortlens.operators import cohort, features, prepare, stats

LONG = "feature string, cluster int, value double"


@pytest.mark.parametrize("got, want", [
    (D.chi2_sf(3.841458820694124, 1), 0.05), (D.chi2_sf(18.307038053275146, 10), 0.05), (D.chi2_sf(0.0, 3), 1.0),
    (D.chi2_sf(1e6, 1e6), 0.4998119368), (D.chi2_sf(1e10, 1e10), 0.4999981194),
    (D.f_sf(4.964602743730711, 1, 10), 0.05), (D.f_sf(1, 4, 1e12), 0.4060058497), (D.f_sf(1, 1e6, 1e6), 0.5),
    (D.t_two_sided(12.706204736432095, 1), 0.05), (D.t_two_sided(1.959963984540054, 1e14), 0.05),
    (D.t_two_sided(1.959963984540054, 1e10), 0.05), (D.norm_sf(0.0), 0.5)])
def test_known_tail_probabilities(got, want):
    assert got == pytest.approx(want, rel=2e-8)


def test_chi2_tail_against_its_own_sum():
    # even degrees of freedom: a Poisson sum
    for k, x in ((2, 3.0), (8, 5.5), (40, 61.0)):
        want = sum(math.exp(-x / 2) * (x / 2) ** i / math.factorial(i) for i in range(k // 2))
        assert D.chi2_sf(x, k) == pytest.approx(want, rel=1e-12)


def test_constant_features_and_one_row_groups(spark):
    rows = [("flat", c, 1.0) for c in (0, 1) for _ in range(4)] + [("one", 0, 1.0), ("one", 1, 2.0)]
    rows += [("real", c, float(c * 10 + i)) for c in (0, 1) for i in range(4)]
    long = spark.createDataFrame(rows, LONG)
    mw = {r.feature: r for r in stats.with_mw_pvalue(stats.mann_whitney(long, 0, 1)).collect()}
    assert mw["flat"].p_value == 1.0 and mw["real"].statistic == 0.0 and 0 < mw["real"].p_value < 0.05
    for equal in (False, True):
        t = {r.feature: r for r in stats.with_t_pvalue(stats.t_test(long, 0, 1, equal_var=equal)).collect()}
        assert t["flat"].statistic is None and t["one"].statistic is None and t["real"].statistic < 0
    f = {r.feature: r for r in stats.with_f_pvalue(stats.anova(long)).collect()}
    assert f["one"].statistic is None and f["flat"].statistic is None
    want = 4 * 2 * 25.0 / (2 * 5.0 / 6)
    assert f["real"].statistic == pytest.approx(want)
    kw = {r.feature: r for r in stats.kruskal(long).collect()}
    assert kw["flat"].statistic is None


def test_chi2_with_thousands_of_categories(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(3), rng.randrange(5000)) for _ in range(12_000)]
    got = stats.chi2_contingency(spark.createDataFrame(pairs, "a int, b int"), "a", "b").first()
    n, ra, cb = Counter(pairs), Counter(a for a, _ in pairs), Counter(b for _, b in pairs)
    want = sum((n[a, b] - ra[a] * cb[b] / 12_000) ** 2 / (ra[a] * cb[b] / 12_000) for a in ra for b in cb)
    assert got.statistic == pytest.approx(want) and got.dof == 2 * (len(cb) - 1)
    empty_cell = spark.createDataFrame([(0, 0)] * 5 + [(1, 0)] * 3 + [(1, 1)] * 4, "a int, b int")
    e = [[8 * 5 / 12, 4 * 5 / 12], [8 * 7 / 12, 4 * 7 / 12]]
    d = abs(5 - e[0][0]) - 0.5
    assert stats.chi2_contingency(empty_cell, "a", "b").first().statistic == pytest.approx(sum(d * d / x for r in e for x in r))


def test_transitions_over_whole_histories(spark):
    rng = random.Random(8)
    rows = []
    for i in range(4000):
        p = "hot" if i % 3 == 0 else f"p{rng.randrange(40)}"
        t = None if i % 97 == 0 else f"2024-01-{1 + rng.randrange(28):02d} {rng.randrange(24):02d}:00:00"
        rows.append((None if i % 101 == 0 else p, i, rng.choice("abcdef") if i % 53 else None, t))
    df = spark.createDataFrame(rows, "p string, id int, o string, t string").withColumn("t", F.to_timestamp_ntz("t"))
    top = [x for x, _ in sorted(Counter(o for p, _, o, _ in rows if o and p).items(), key=lambda x: (-x[1], x[0]))[:4]]
    seqs = defaultdict(list)
    for p, i, o, t in sorted(rows, key=lambda r: (r[3] is None, r[3] or "", r[1])):
        if p and o in top:
            seqs[p].append(o)
    want = Counter(x for s in seqs.values() for x in zip(s, s[1:]))
    got = {(r.from_order, r.to_order): r.n for r in features.history_transitions(df, "p", "o", "t", 4, tiebreak="id").collect()}
    assert got == {(a, b): want[a, b] for a in top for b in top}
    st = features.history_stats(df, "p").first()
    lengths = Counter(p for p, *_ in rows if p)
    assert (st.n_patients, st.mean_length) == (len(lengths), sum(lengths.values()) / len(lengths))


def test_rows_with_nulls_have_no_norm(spark):
    df = spark.createDataFrame([(1, None, 5.0), (2, 3.0, 4.0), (3, 0.0, 0.0)], "key long, a double, b double")
    got = {r.key: (r.a, r.b) for r in prepare.scale(df, "normalize", ["a", "b"], "key").collect()}
    assert got == {1: (None, None), 2: (0.6, 0.8), 3: (0.0, 0.0)}
    scores, _ = prepare.truncated_svd(df, 1, ["a", "b"], "key")
    assert {r.key for r in scores.collect()} == {2, 3}


def test_a_criterion_without_its_table_is_refused(spark):
    adm = spark.createDataFrame([(1, 1)], "subject_id long, hadm_id long")
    for c in (cohort.CohortCriteria(age_min=90), cohort.CohortCriteria(diagnosis_prefixes=["E"]),
              cohort.CohortCriteria(required_units=["x"]), cohort.CohortCriteria(order_types=["x"])):
        with pytest.raises(ValueError):
            cohort.cohort_criteria(adm, c)


def test_null_patients_form_no_group(spark):
    df = spark.createDataFrame([(None, "a"), ("p", "a"), ("p", "b")], "p string, o string").withColumn("t", F.current_timestamp())
    assert [r.p for r in features.order_timing(df, "p", "o", "t").collect()] == ["p"]
    assert {r.p for r in features.order_distribution_patient(df, "p", "o").collect()} == {"p"}
