"""Invariants for operators without an exact SQL oracle (seeded / iterative),
a brute-force check of DBSCAN, and metamorphic checks (repartitioning the
input must not change any result)."""

import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from cohortlens.operators import cluster, features, joins
from cohortlens.plans.roles import role, roles
from conftest import SF_SMALL, rows

Q = E.queries()


def _n_keys(spark):
    return role(spark, SF_SMALL, "features").count()


@pytest.mark.parametrize("name,k", [("kmeans", 5), ("hierarchical", 5), ("model_roundtrip", 5)])
def test_labels_cover_every_key_once(spark, name, k):
    lab = Q[name](spark, SF_SMALL)
    r = lab.agg(F.count("*"), F.countDistinct("key"), F.min("cluster"), F.max("cluster")).first()
    assert r[0] == r[1] == _n_keys(spark)
    assert 0 <= r[2] and r[3] < k


def _brute_dbscan(points, eps, min_samples):
    keys = sorted(points)
    nb = {a: [b for b in keys if math.dist(points[a], points[b]) <= eps] for a in keys}
    core = {a for a in keys if len(nb[a]) >= min_samples}
    label = {}
    for a in sorted(core):
        if a in label:
            continue
        stack, comp = [a], []
        label[a] = None
        while stack:
            x = stack.pop()
            comp.append(x)
            for y in nb[x]:
                if y in core and y not in label:
                    label[y] = None
                    stack.append(y)
        for x in comp:
            label[x] = min(comp)
    out = {}
    for a in keys:
        if a in core:
            out[a] = label[a]
        else:
            cl = [label[b] for b in nb[a] if b in core]
            out[a] = min(cl) if cl else -1
    return out


def test_dbscan_matches_brute_force(spark):
    from cohortlens.plans.model_queries import DB_EPS, DB_MIN
    f = role(spark, SF_SMALL, "features")
    pts = {r["key"]: (r["f00"], r["f01"]) for r in f.select("key", "f00", "f01").collect()}
    for eps, ms in ((DB_EPS, DB_MIN), (0.08, 4), (0.03, 2)):
        got = {r["key"]: r["cluster"] for r in cluster.dbscan(f, ["f00", "f01"], eps, ms).collect()}
        assert got == _brute_dbscan(pts, eps, ms)


def test_dbscan_manhattan_and_boundary(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 2.0, 0.0), (4, 10.0, 10.0)],
                                "key long, x double, y double")
    got = {r["key"]: r["cluster"] for r in cluster.dbscan(pts, ["x", "y"], 1.0, 2).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: -1}                  # distance exactly eps is a neighbour
    m = {r["key"]: r["cluster"] for r in cluster.dbscan(pts, ["x", "y"], 1.0, 3, metric="manhattan").collect()}
    assert m == {1: 2, 2: 2, 3: 2, 4: -1}                    # 1 and 3 are border points of core 2


def test_lda(spark):
    td = Q["lda_topics"](spark, SF_SMALL)
    r = td.select(F.aggregate("topic_distribution", F.lit(0.0), lambda a, b: a + b).alias("s"),
                  "dominant_topic").collect()
    assert all(abs(x["s"] - 1) < 1e-6 and 0 <= x["dominant_topic"] < 5 for x in r)
    tt = Q["lda_top_terms"](spark, SF_SMALL)
    assert tt.count() == 50 and tt.select("topic").distinct().count() == 5


def test_pca_svd(spark):
    from cohortlens.operators import prepare
    f = role(spark, SF_SMALL, "features")
    cols = [c for c in f.columns if c != "key"]
    scores, ev = prepare.pca(f, 3, cols)
    assert len(ev) == 3 and all(0 <= x <= 1 for x in ev) and ev == sorted(ev, reverse=True)
    m = scores.agg(*[F.avg(c) for c in ("pc1", "pc2", "pc3")]).first()
    assert all(abs(x) < 1e-9 for x in m)                      # centred scores
    s2, ev2 = prepare.truncated_svd(f, 2, cols)
    assert s2.count() == f.count() and len(ev2) == 2


def test_feature_importance_and_k_scan(spark):
    imp = Q["feature_importance"](spark, SF_SMALL)
    assert imp.count() == 64
    assert abs(imp.agg(F.sum("importance")).first()[0] - 1) < 1e-6
    scan = Q["kmeans_k_scan"](spark, SF_SMALL).collect()
    assert [r["k"] for r in scan] == list(range(2, 11))
    assert sum(r["elbow"] for r in scan) == 1
    assert all(r["inertia"] > 0 for r in scan)


@pytest.mark.parametrize("name", ["anova_test", "kruskal_test", "mannwhitney_test", "ttest_test"])
def test_p_values(spark, name):
    r = Q[name](spark, SF_SMALL).collect()
    assert r and all(0 <= x["p_value"] <= 1 for x in r)
    assert all(x["adjusted_p_value"] >= x["p_value"] - 1e-15 for x in r)
    assert all(x["adjusted_p_value"] <= 1 for x in r)


def test_sampling_is_repeatable(spark):
    a = rows(Q["seeded_sample"](spark, SF_SMALL))
    b = rows(Q["seeded_sample"](spark, SF_SMALL))
    assert a == b and len(a) == min(1000, spark.read.parquet(f"{SF_SMALL}/events.parquet").count())
    pat = Q["order_patterns_by_cluster"](spark, SF_SMALL)
    per = pat.groupBy("cluster").agg(F.countDistinct("subject_id").alias("n")).collect()
    assert per and all(x["n"] <= 50 for x in per)


def test_catalog_and_conversion(spark):
    cat = Q["catalog_scan"](spark, SF_SMALL).collect()
    assert len(cat) == 14 and all(r["suffix"] == ".parquet" and r["size_bytes"] > 0 for r in cat)
    st = {r["table_name"]: r for r in Q["convert_tables"](spark, SF_SMALL).collect()}
    assert st["missing_table"]["status"] == "failed"
    assert st["nation"]["status"] == "ok" and st["nation"]["rows"] == 25
    roles_ = {(r["column"], r["role"]) for r in Q["column_roles"](spark, SF_SMALL).collect()}
    assert ("subject_id", "patient_id") in roles_ and ("ordertime", "temporal") in roles_


def test_repartitioning_does_not_change_results(spark):
    ev = role(spark, SF_SMALL, "order_events")
    base = rows(features.order_timing(ev, "patient", "order_type", "ordertime", "admittime", "dischtime",
                                      tiebreak="event_id"))
    shuffled = rows(features.order_timing(ev.repartition(7, "event_id"), "patient", "order_type", "ordertime",
                                          "admittime", "dischtime", tiebreak="event_id"))
    assert base == shuffled
    labs, stays = roles(spark, SF_SMALL, "labevents", "stays")
    a = rows(joins.nearest_admission(labs, stays))
    b = rows(joins.nearest_admission(labs.repartition(5), stays.repartition(3), bucket_hours=3))
    assert a == b


def test_rank_buckets_do_not_change_statistics(spark):
    from cohortlens.functions.frames import melt
    from cohortlens.operators import stats
    f, l = roles(spark, SF_SMALL, "features", "cluster_labels")
    long = melt(joins.align_labels(f, l, "key").select("key", "cluster", "f00", "f01"), ["key", "cluster"],
                ["f00", "f01"])
    # coarse values force many ties, some across bucket boundaries
    long = long.withColumn("value", F.round("value", 1))
    a = {r["feature"]: r["statistic"] for r in stats.kruskal(long, buckets=2).collect()}
    b = {r["feature"]: r["statistic"] for r in stats.kruskal(long, buckets=256).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_dbscan_cosine(spark):
    pts = spark.createDataFrame([(1, 1.0, 0.0), (2, 2.0, 0.1), (3, 0.0, 1.0), (4, 0.0, 0.0)],
                                "key long, x double, y double")
    got = {r["key"]: r["cluster"] for r in cluster.dbscan(pts, ["x", "y"], 0.01, 2, metric="cosine").collect()}
    assert got == {1: 1, 2: 1, 3: -1, 4: -1}


def test_connected_components_long_path(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1)] + [(i + 1, i) for i in range(n - 1)]
                                  + [(1000, 1001), (1001, 1000)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in list(range(n)) + [1000, 1001, 2000]], "node long")
    # a path of 300 nodes must converge well within 20 rounds thanks to pointer jumping
    lab = {r["node"]: r["label"] for r in cluster.connected_components(edges, nodes).collect()}
    assert all(lab[i] == 0 for i in range(n)) and lab[1000] == lab[1001] == 1000 and lab[2000] == 2000


def test_knn_duplicates_and_small_sets(spark):
    from cohortlens.operators.neighbors import knn_distances, largest_gap_value
    pts = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 3.0, 4.0), (4, 100.0, 0.0)],
                                "key long, x double, y double")
    k2 = {r["key"]: r["knn_distance"] for r in knn_distances(pts, ["x", "y"], k=2).collect()}
    assert k2 == {1: 0.0, 2: 0.0, 3: 5.0, 4: pytest.approx(math.dist((100, 0), (3, 4)))}
    k5 = {r["key"]: r["knn_distance"] for r in knn_distances(pts, ["x", "y"], k=5).collect()}
    assert all(v is None for v in k5.values())                # fewer than k points
    vals = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 10, 11, 30]], "v double")
    assert largest_gap_value(vals, "v", group=3) == 30.0


def test_dbscan_hot_coordinate(spark):
    # a third of the rows share one coordinate: collapsed to one location, same labels as brute force
    data = [(i, 0.5, 0.5) for i in range(60)] + [(100 + i, 0.5 + 0.01 * i, 0.2) for i in range(60)] \
        + [(200 + i, 3.0 + 0.3 * i, 3.0) for i in range(60)]
    df = spark.createDataFrame(data, "key long, x double, y double")
    pts = {k: (x, y) for k, x, y in data}
    for eps, ms in ((0.05, 3), (0.35, 2), (0.31, 70)):
        got = {r["key"]: r["cluster"] for r in cluster.dbscan(df, ["x", "y"], eps, ms).collect()}
        assert got == _brute_dbscan(pts, eps, ms)
    core = {r["key"]: r["n_neighbours"] for r in cluster.dbscan_core_points(df, ["x", "y"], 0.05, 3).collect()}
    assert core[0] == 60 and len(core) == 180


def test_knn_dense_spot_matches_brute_force(spark):
    import random
    from cohortlens.operators.neighbors import knn_distances
    rnd = random.Random(11)
    pts = [(i, 0.5 + rnd.random() * 1e-4, 0.5 + rnd.random() * 1e-4) for i in range(150)]      # a dense spot
    pts += [(1000 + i, rnd.random(), rnd.random()) for i in range(300)]
    df = spark.createDataFrame(pts, "key long, x double, y double")
    got = {r["key"]: r["knn_distance"] for r in knn_distances(df, ["x", "y"], k=4).collect()}
    for key, x, y in pts[::37]:
        d = sorted(math.dist((x, y), (a, b)) for _, a, b in pts)
        assert got[key] == pytest.approx(d[3])


def test_dbscan_dense_distinct_spot(spark):
    # a third of the rows at distinct coordinates inside one small cell: no pair block, same labels
    import random
    rnd = random.Random(2)
    data = [(i, 0.3 + rnd.random() * 1e-3, 0.3 + rnd.random() * 1e-3) for i in range(120)]
    data += [(500 + i, rnd.random(), rnd.random()) for i in range(240)]
    df = spark.createDataFrame(data, "key long, x double, y double")
    pts = {k: (x, y) for k, x, y in data}
    for eps, ms in ((0.05, 4), (0.1, 10), (0.02, 2)):
        got = {r["key"]: r["cluster"] for r in cluster.dbscan(df, ["x", "y"], eps, ms).collect()}
        assert got == _brute_dbscan(pts, eps, ms)
    # the pairs the plan forms exclude the spot's intra-cell block
    _, cells, cross = cluster.eps_neighbours(df, ["x", "y"], 0.05)
    assert cross.count() < 120 * 119


def test_k_scan_selection_rules(spark):
    scan = Q["kmeans_k_scan"](spark, SF_SMALL).collect()
    for col in ("elbow", "best_silhouette", "best_davies_bouldin", "best_calinski_harabasz"):
        assert sum(r[col] for r in scan) == 1
    inert = [r["inertia"] for r in scan]
    rate = [(inert[i + 1] - inert[i]) / inert[i] for i in range(len(inert) - 1)]
    i = min(rate.index(max(rate)) + 1, len(scan) - 1)
    assert scan[i]["elbow"]
    assert max(scan, key=lambda r: r["silhouette_sq"])["best_silhouette"]


def test_order_patterns_counts_match_sequences(spark):
    seq = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b", "c"]), (3, ["a"]), (4, ["z"])],
                                "p long, sequence array<string>")
    lab = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "p long, cluster int")
    out = {(r["p"], r["order"]): r["n"] for r in
           cluster.order_patterns_by_cluster(seq, lab, "p", max_orders=2, per_cluster=50).collect()}
    # top-2 over matched sequences (patient 4 has no label): a (3), b (2)
    assert out == {(1, "a"): 2, (1, "b"): 1, (2, "a"): 0, (2, "b"): 1, (3, "a"): 1, (3, "b"): 0}
    few = cluster.order_patterns_by_cluster(seq, lab, "p", max_orders=2, per_cluster=1)
    assert few.select("p").distinct().count() == 2          # one patient per cluster


def test_lda_tfidf(spark):
    td = Q["lda_topics_tfidf"](spark, SF_SMALL)
    r = td.select(F.aggregate("topic_distribution", F.lit(0.0), lambda a, b: a + b).alias("s")).collect()
    assert r and all(abs(x["s"] - 1) < 1e-6 for x in r)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_dbscan_and_knn_on_all_features(spark, metric):
    from cohortlens.operators.neighbors import knn_distances
    from cohortlens.plans.roles import FEATURE_COLS
    f = role(spark, SF_SMALL, "features").where("key < 150").persist()
    pts = {r["key"]: tuple(r[c] for c in FEATURE_COLS) for r in f.collect()}

    def dist(a, b):
        return math.dist(a, b) if metric == "euclidean" else sum(abs(x - y) for x, y in zip(a, b))

    ds = {a: sorted(dist(pts[a], pts[b]) for b in pts) for a in pts}
    eps = sorted(d[4] for d in ds.values())[len(ds) // 2] + 1e-9
    core = {r["key"]: r["n_neighbours"] for r in cluster.dbscan_core_points(f, FEATURE_COLS, eps, 5, metric=metric).collect()}
    assert core == {a: sum(x <= eps for x in d) for a, d in ds.items()}
    if metric == "euclidean":
        got = {r["key"]: r["cluster"] for r in cluster.dbscan(f, FEATURE_COLS, eps, 5).collect()}
        assert got == _brute_dbscan(pts, eps, 5) and len(set(got.values())) > 1
    knn = {r["key"]: r["knn_distance"] for r in knn_distances(f, FEATURE_COLS, k=5, metric=metric).collect()}
    assert all(abs(knn[a] - d[4]) < 1e-9 for a, d in ds.items())
    f.unpersist()


def test_k_scan_keeps_the_best_of_ten_starts(spark):
    import numpy as np
    from pyspark.ml.clustering import KMeans
    rng = np.random.default_rng(4)
    pts = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((300, 2)))],
                                "key long, x double, y double").coalesce(1).persist()
    vec = cluster._vectors(pts, ["x", "y"], "key").persist()
    cost = [KMeans(k=8, maxIter=300, seed=42 + i, featuresCol="features").fit(vec).summary.trainingCost for i in range(10)]
    got = cluster.kmeans_k_scan(pts, [8], ["x", "y"]).first()["inertia"]
    assert got < cost[0] - 1e-9 and abs(got - min(cost)) < 1e-9
    vec.unpersist()
    pts.unpersist()


def test_documents_of_whole_histories(spark):
    from cohortlens.operators import prepare
    rows = [(1, "a")] * 25 + [(1, "late")] * 3 + [(1, None), (None, "a"), (2, "b")]
    got = prepare.documents_from_histories(spark.createDataFrame(rows, "p long, o string"), "p", "o").collect()
    assert sorted(map(tuple, got)) == [(1, "a", 25), (1, "late", 3), (2, "b", 1)]
