"""Edge rows the driver tables hardly exercise (nulls, ties, boundaries)."""

import datetime as dt
import math

import pytest

from cohortlens.functions.nulls import normalize_na
from cohortlens.operators import cohort, evaluate, features, joins, prepare, profile, stats
from conftest import rows

T = dt.datetime


def test_f1_patients(spark):
    df = spark.createDataFrame(
        [(1, 17, "2017 - 2019", None), (2, 18, "2017 - 2019", None), (3, 75, "2017 - 2019", None),
         (4, 76, "2017 - 2019", None), (5, None, "2017 - 2019", None), (6, 30, "2017 - 2019", T(2020, 1, 1)),
         (7, 30, "2008 - 2010", None), (8, 30, None, None)],
        "subject_id long, anchor_age long, anchor_year_group string, dod timestamp_ntz")
    assert [r[0] for r in rows(cohort.filter_patients(df))] == [2, 3]


def test_f2_diagnoses(spark):
    df = spark.createDataFrame(
        [(1, "E11", 1, 10), (2, "E119", 3, 10), (3, "E10", 1, 10), (4, None, 1, 10), (5, "E11", 4, 10),
         (6, "E11", 2, 9)], "id long, icd_code string, seq_num long, icd_version long")
    assert [r[0] for r in rows(cohort.filter_diagnoses(df))] == [1, 2]


def _adm(spark, data):
    cols = ("subject_id long, hadm_id long, admittime timestamp_ntz, dischtime timestamp_ntz, "
            "deathtime timestamp_ntz, admission_type string, admit_provider_id string, insurance string, "
            "language string, marital_status string, race string, edregtime timestamp_ntz, "
            "edouttime timestamp_ntz, hospital_expire_flag short")
    full = [(s, h, a, d, de, ty, None, None, None, None, None, None, None, fl) for s, h, a, d, de, ty, fl in data]
    return spark.createDataFrame(full, cols)


def test_f5_admissions(spark):
    a, b = T(2020, 1, 1), T(2020, 1, 5)
    df = _adm(spark, [
        (1, 1, a, b, None, None, 0),            # null type kept
        (1, 2, a, b, None, "URGENT", 0),        # excluded type
        (1, 3, a, a, None, "X", 0),             # equal times dropped
        (1, 4, a, b, b, "X", 0),                # death with flag 0 kept
        (1, 5, a, b, b, "X", 1),                # death with flag 1 dropped
        (1, 6, a, b, b, "X", None),             # death with null flag dropped
        (1, 7, a, None, None, "X", 0),          # null dischtime dropped
    ])
    out = cohort.filter_admissions(df)
    assert [r["hadm_id"] for r in out.orderBy("hadm_id").collect()] == [1, 4]
    assert "insurance" not in out.columns
    with pytest.raises(KeyError):
        cohort.filter_admissions(df.drop("race"))


def test_s5_na_tokens(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["", "NULL", "null", "None", "12", "x", " 7 "])],
                               "i int, v string")
    out = [r[1] for r in df.select("i", normalize_na("v")).orderBy("i").collect()]
    assert out == [None, None, None, None, 12, None, 7]


def test_j5_inner_vs_left(spark):
    poe = spark.createDataFrame([("a", 1, 1), ("b", 1, 2), ("c", 1, 3)], "poe_id string, poe_seq long, subject_id long")
    det = spark.createDataFrame([("a", 1, 1, "f", "v"), ("b", 1, 2, "f", "w")],
                                "poe_id string, poe_seq long, subject_id long, field_name string, field_value string")
    keys = ["poe_id", "poe_seq", "subject_id"]
    assert joins.merge_two(poe, det, keys, "inner").count() == 2
    left = joins.merge_two(poe, det, keys, "left")
    assert left.count() == 3 and left.where("poe_id = 'c'").first()["field_value"] is None


def test_j7_null_keys(spark):
    l = spark.createDataFrame([(1, None), (2, "p")], "id long, prov string")
    r = spark.createDataFrame([(1, None, "x"), (2, "p", "y")], "id long, prov string, v string")
    sql_sem = joins.merge_two(l, r, ["id", "prov"], "left")
    assert {(x["id"], x["v"]) for x in sql_sem.collect()} == {(1, None), (2, "y")}
    pandas_sem = joins.merge_two(l, r, ["id", "prov"], "left", null_keys_match=["prov"])
    assert {(x["id"], x["v"]) for x in pandas_sem.collect()} == {(1, "x"), (2, "y")}


def test_j10_suffixes(spark):
    l = spark.createDataFrame([(1, "a")], "k long, v string")
    r = spark.createDataFrame([(1, "b"), (2, "c")], "k long, v string")
    out = joins.merge_two(l, r, "k", "outer")
    assert set(out.columns) == {"k", "v_x", "v_y"} and out.count() == 2


def test_j11_nearest_interval(spark):
    adm = spark.createDataFrame([
        (1, 10, T(2020, 1, 10), T(2020, 1, 12)),
        (1, 11, T(2020, 1, 11), T(2020, 1, 20)),   # overlaps 10
        (1, 12, T(2020, 2, 1), T(2020, 2, 3)),
    ], "subject_id long, hadm_id long, admittime timestamp_ntz, dischtime timestamp_ntz")
    us = dt.timedelta(microseconds=1)
    labs = spark.createDataFrame([
        (1, 1, T(2020, 1, 9)),                   # exactly admit-24h of 10 -> kept
        (2, 1, T(2020, 1, 9) - us),              # 1 us outside -> dropped
        (3, 1, T(2020, 2, 4)),                   # exactly disch+24h of 12 -> kept
        (4, 1, T(2020, 2, 4) + us),              # outside -> dropped
        (5, 1, T(2020, 1, 10, 12)),              # equal distance to 10 and 11 -> earlier admit (10)
        (6, 1, T(2020, 1, 11, 1)),               # nearer 11
        (7, 1, None),                            # null time dropped
        (8, 2, T(2020, 1, 10)),                  # subject without stay dropped
        (9, 1, T(2020, 1, 11, 1)),               # identical lab, different id -> own row
    ], "labevent_id long, subject_id long, charttime timestamp_ntz")
    got = {r["labevent_id"]: r["hadm_id"] for r in joins.nearest_admission(labs, adm, bucket_hours=6).collect()}
    assert got == {1: 10, 3: 12, 5: 10, 6: 11, 9: 11}
    # the bucket size only changes the plan, never the answer
    got24 = {r["labevent_id"]: r["hadm_id"] for r in joins.nearest_admission(labs, adm, bucket_hours=24).collect()}
    assert got24 == got


def test_a2_top_n_ties_and_nulls(spark):
    df = spark.createDataFrame([
        (1, "a"), (1, "a"), (2, "b"), (2, "b"), (3, "c"), (3, "c"), (4, "z"), (1, None), (None, "a")],
        "p long, o string")
    long = features.order_frequency(df, "p", "o", top_n=2)
    # top-2 by count: a(3 incl. null patient), then b/c tie on 2 -> b (key ascending)
    assert sorted({r["o"] for r in long.collect()}) == ["a", "b"]
    assert sorted({r["p"] for r in long.collect()}) == [1, 2]   # patient 3/4 have only other orders
    assert {(r["p"], r["o"]): r["n"] for r in long.collect()} == {(1, "a"): 2, (1, "b"): 0, (2, "a"): 0, (2, "b"): 2}


def test_a5_timing_boundaries(spark):
    adm, dis = T(2020, 1, 1), T(2020, 1, 10)
    df = spark.createDataFrame([
        (1, 1, "a", T(2019, 12, 31), adm, dis),     # before admission: counted in first 24h
        (1, 2, "b", T(2020, 1, 2), adm, dis),       # exactly +24h: counted
        (1, 3, None, T(2020, 1, 3), adm, dis),      # null order: not in total_orders
        (1, 4, "a", None, adm, dis),                # null time
        (1, 5, "c", T(2020, 1, 9, 12), adm, dis),   # last 24h
    ], "p long, id long, o string, t timestamp_ntz, a timestamp_ntz, d timestamp_ntz")
    r = features.order_timing(df, "p", "o", "t", "a", "d", tiebreak="id").first()
    assert r["total_orders"] == 4 and r["unique_order_types"] == 3
    assert r["orders_in_first_24h"] == 2 and r["orders_in_first_48h"] == 3
    assert r["orders_in_last_24h"] == 1
    assert r["order_span_hours"] == pytest.approx((T(2020, 1, 9, 12) - T(2019, 12, 31)).total_seconds() / 3600)
    assert r["time_to_first_order_hours"] == pytest.approx(-24.0)
    assert r["time_from_last_order_to_discharge_hours"] == pytest.approx(12.0)
    # discharge column optional
    r2 = features.order_timing(df, "p", "o", "t", "a").first()
    assert "orders_in_last_24h" not in r2.asDict()


def test_w1_sequences(spark):
    data = [(1, i, f"o{i}", T(2020, 1, 1) + dt.timedelta(hours=i)) for i in range(25)]
    data += [(2, 1, "b", T(2020, 1, 1)), (2, 0, "a", T(2020, 1, 1)), (2, 2, None, T(2020, 1, 2)),
             (2, 3, "x", None)]
    df = spark.createDataFrame(data, "p long, id long, o string, t timestamp_ntz")
    seq = {r["p"]: r["sequence"] for r in features.order_sequences(df, "p", "o", "t", 20, "id").collect()}
    assert seq[1] == [f"o{i}" for i in range(20)]
    assert seq[2] == ["a", "b", None, "x"]       # tie by id, null order kept, null time last


def test_a7_transitions(spark):
    seq = spark.createDataFrame([(1, ["a", "r", "b", "a"]), (2, ["b", "a", "b"]), (3, ["a", "b", "a", "b"])],
                                "p long, sequence array<string>")
    out = {(r["from_order"], r["to_order"]): (r["n"], r["probability"])
           for r in features.order_transitions(seq, top_n=2).collect()}
    # r is rare and removed before pairing: a->b bridges it
    assert out[("a", "b")][0] == 4 and out[("b", "a")][0] == 3
    assert out[("a", "a")] == (0, 0.0)
    assert sum(p for (f, _), (_, p) in out.items() if f == "a") == pytest.approx(1.0)


def test_a7_type_without_successor(spark):
    seq = spark.createDataFrame([(1, ["a", "b"])], "p long, sequence array<string>")
    out = {(r["from_order"], r["to_order"]): r["probability"] for r in features.order_transitions(seq, top_n=5).collect()}
    assert out[("b", "a")] == 0.0 and out[("b", "b")] == 0.0 and out[("a", "b")] == 1.0


def test_p1_to_p4(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0, None), (2, 2.0, 5.0, None), (3, None, 5.0, None),
                                (4, 2.0, 5.0, None)], "key long, x double, c double, n double")
    mean = {r["key"]: r["x"] for r in prepare.impute(df, "mean", ["x", "c", "n"]).collect()}
    assert mean[3] == pytest.approx(5 / 3)
    assert prepare.impute(df, "median", ["x"]).where("key = 3").first()["x"] == 2.0
    assert prepare.impute(df, "mode", ["x"]).where("key = 3").first()["x"] == 2.0
    assert prepare.impute(df, "mean", ["n"]).where("key = 3").first()["n"] is None   # all-null stays null
    assert prepare.impute(df.select("key", "x"), "drop").count() == 3
    with pytest.raises(ValueError):
        prepare.impute(df, "zero")
    st = prepare.scale(df.select("key", "c"), "standard", ["c"]).collect()
    assert all(r["c"] == 0.0 for r in st)                    # constant column -> 0
    mm = prepare.scale(df.select("key", "c"), "minmax", ["c"]).collect()
    assert all(r["c"] == 0.0 for r in mm)
    z = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0)], "key long, a double, b double")
    nz = {r["key"]: (r["a"], r["b"]) for r in prepare.scale(z, "normalize", ["a", "b"]).collect()}
    assert nz[1] == (0.0, 0.0) and nz[2] == pytest.approx((0.6, 0.8))


def test_a12_characterization(spark):
    df = spark.createDataFrame([(1, 0, -1.0, "t"), (2, 0, 1.0, "u"), (3, 1, 0.0, "v"), (4, -1, 0.0, "w")],
                               "key long, cluster int, x double, s string")
    out = profile.cluster_characterization(df, features=["x"]).collect()
    assert {r["cluster"] for r in out} == {0, 1}                # noise skipped
    assert all(r["diff_from_mean"] == 0.0 for r in out)        # overall mean 0 -> 0
    c0 = [r for r in out if r["cluster"] == 0][0]
    assert c0["percentage"] == pytest.approx(50.0) and c0["size"] == 2


def test_metrics_edge_cases(spark):
    one = spark.createDataFrame([(1, 0, 0.0), (2, 0, 1.0)], "key long, cluster int, x double")
    assert math.isnan(evaluate.silhouette_sq(one, ["x"]).first()[0])
    assert evaluate.calinski_harabasz(one, ["x"]).first()[0] is None
    two = spark.createDataFrame([(1, 0, 0.0), (2, 0, 1.0), (3, 1, 10.0)], "key long, cluster int, x double")
    # singleton silhouette 0; points of cluster 0: a = 1, b = 100 / 81 -> mean = (0.99 + 0.9877) / 3 ...
    s = evaluate.silhouette_sq(two, ["x"]).first()[0]
    a0 = 1.0; b0 = 100.0; a1 = 1.0; b1 = 81.0
    assert s == pytest.approx(((1 - a0 / b0) + (1 - a1 / b1) + 0.0) / 3)


def test_m5_m7(spark):
    long = spark.createDataFrame(
        [("f", 0, 1.0), ("f", 0, 2.0), ("f", 0, 2.0), ("f", 1, 2.0), ("f", 1, 3.0), ("f", 1, 4.0),
         ("g", 0, 1.0), ("h", 0, None), ("h", 1, None), ("f", -1, 100.0)],
        "feature string, cluster int, value double")
    an = {r["feature"]: r for r in stats.anova(long).collect()}
    assert set(an) == {"f"}                                  # one group / all-null -> no row
    # groups [1,2,2] and [2,3,4]: means 5/3, 3; grand 7/3; SSB = 3*(4/9)+3*(4/9)=8/3; SSW = 2/3+2 = 8/3
    assert an["f"]["statistic"] == pytest.approx((8 / 3) / ((8 / 3) / 4))
    kw = {r["feature"]: r["statistic"] for r in stats.kruskal(long).collect()}
    # pooled ranks: 1 -> 1; 2,2,2 -> 3; 3 -> 5; 4 -> 6.  R0 = 7, R1 = 14
    h = 12 / (6 * 7) * (49 / 3 + 196 / 3) - 3 * 7
    assert kw["f"] == pytest.approx(h / (1 - (27 - 3) / (216 - 6)))
    mw = {r["feature"]: r["statistic"] for r in stats.mann_whitney(long, 0, 1).collect()}
    assert mw["f"] == pytest.approx(7 - 6)


def test_m9_yates_only_2x2(spark):
    t22 = spark.createDataFrame([(0, 0)] * 10 + [(0, 1)] * 5 + [(1, 0)] * 3 + [(1, 1)] * 12, "r int, c int")
    r = stats.chi2_contingency(t22, "r", "c").first()
    # expected: row totals 15/15, col totals 13/17 -> E = 6.5, 8.5; |O-E| = 3.5 -> 3.0 with Yates
    e = [6.5, 8.5, 6.5, 8.5]
    assert r["dof"] == 1 and r["statistic"] == pytest.approx(sum(9.0 / x for x in e))
    t23 = spark.createDataFrame([(0, 0)] * 4 + [(0, 1)] * 2 + [(1, 2)] * 3, "r int, c int")
    r2 = stats.chi2_contingency(t23, "r", "c").first()
    assert r2["dof"] == 2
    # no correction: O = [[4,2,0],[0,0,3]], E = rows 6/3 x cols 4/2/3 / 9
    obs = [[4, 2, 0], [0, 0, 3]]
    E = [[6 * 4 / 9, 6 * 2 / 9, 6 * 3 / 9], [3 * 4 / 9, 3 * 2 / 9, 3 * 3 / 9]]
    chi = sum((obs[i][j] - E[i][j]) ** 2 / E[i][j] for i in range(2) for j in range(3))
    assert r2["statistic"] == pytest.approx(chi)


def test_m11_adjusted_rand(spark):
    a = spark.createDataFrame([(i, i % 3) for i in range(12)], "key long, cluster int")
    perm = spark.createDataFrame([(i, (i % 3 + 1) % 3) for i in range(12)], "key long, cluster int")
    noisy = spark.createDataFrame([(i, -1 if i == 0 else i % 3) for i in range(12)], "key long, cluster int")
    assert evaluate.adjusted_rand(a, a).first()[0] == pytest.approx(1.0)
    assert evaluate.adjusted_rand(a, perm).first()[0] == pytest.approx(1.0)
    assert evaluate.adjusted_rand(a, noisy).first()[0] == pytest.approx(1.0)   # noise row removed
    tiny = spark.createDataFrame([(1, 0)], "key long, cluster int")
    assert math.isnan(evaluate.adjusted_rand(tiny, tiny).first()[0])


def test_u1_empty_intersection(spark):
    a = spark.createDataFrame([(1,), (2,)], "subject_id long")
    b = spark.createDataFrame([(3,)], "subject_id long")
    ids = cohort.subject_intersection([a, b, spark.createDataFrame([("x",)], "icd_code string")])
    with pytest.raises(ValueError):
        cohort.require_nonempty(ids)
    with pytest.raises(ValueError):
        cohort.subject_intersection([spark.createDataFrame([("x",)], "icd_code string")])


def test_histogram_max_in_last_bin(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 1, 2, 3, 10]], "v double")
    h = {r["bin"]: r["n"] for r in profile.histogram(df, "v", bins=5).collect()}
    assert h == {0: 2, 1: 2, 4: 1}


def test_j11_same_admittime_tie(spark):
    adm = spark.createDataFrame([
        (1, 21, T(2020, 1, 10), T(2020, 1, 12)),
        (1, 20, T(2020, 1, 10), T(2020, 1, 11)),   # same admittime, smaller id
        (1, 22, T(2020, 1, 10), T(2020, 1, 30)),
    ], "subject_id long, hadm_id long, admittime timestamp_ntz, dischtime timestamp_ntz")
    labs = spark.createDataFrame([(1, 1, T(2020, 1, 11)), (2, 1, T(2020, 1, 12, 12)), (3, 1, T(2020, 1, 25))],
                                 "labevent_id long, subject_id long, charttime timestamp_ntz")
    got = {r["labevent_id"]: r["hadm_id"] for r in joins.nearest_admission(labs, adm).collect()}
    assert got == {1: 20, 2: 21, 3: 22}
    plan = joins.nearest_admission(labs, adm)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_m5_m6_group_without_values_skips_feature(spark):
    long = spark.createDataFrame(
        [("f", 0, 1.0), ("f", 1, 2.0), ("f", 2, None), ("f", 0, 3.0), ("f", 1, 5.0),
         ("g", 0, 1.0), ("g", 1, 2.0), ("g", 2, 3.0), ("g", 0, 2.0)],
        "feature string, cluster int, value double")
    assert {r["feature"] for r in stats.anova(long).collect()} == {"g"}
    assert {r["feature"] for r in stats.kruskal(long).collect()} == {"g"}


def test_group_difference_test_picks_the_test(spark):
    two = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("b", 2.0), ("b", 3.0), ("b", 4.0),
                                 ("Noise", 9.0)], "g string, v double")
    r = stats.group_difference_test(two, "g", "v", noise="Noise").first()
    assert r["test"] == "mann_whitney" and r["statistic"] == pytest.approx(1.0) and 0 <= r["p_value"] <= 1
    three = two.unionByName(spark.createDataFrame([("c", 7.0)], "g string, v double"))
    assert stats.group_difference_test(three, "g", "v", noise="Noise").first()["test"] == "kruskal"
    one = spark.createDataFrame([("a", 1.0)], "g string, v double")
    assert stats.group_difference_test(one, "g", "v").count() == 0
