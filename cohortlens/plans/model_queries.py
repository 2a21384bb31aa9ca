"""Preparation, clustering and topic-model queries.

Seeded / iterative models (K-means, bisecting K-means, LDA, random forest,
PCA signs, DBSCAN components) have no SQL oracle: they are registered
without one and checked by invariants in ``tests/``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import cluster, features as feats, joins, prepare
from cohortlens.plans.registry import query, r6
from cohortlens.plans.roles import FEATURE_COLS, role, roles

MISSING_COLS = [f"f{i:02d}" for i in range(8)]
DB_EPS, DB_MIN = 0.05, 5


def _round_all(df, keep=("key",)):
    return df.select(*[F.col(c) if c in keep else r6(F.col(c)).alias(c) for c in df.columns])


# ------------------------------------------------------------------------ P1
def _impute_sql(stat: str) -> str:
    if stat == "drop":
        return ("SELECT key, " + ", ".join(f"round({c}, 6) AS {c}" for c in MISSING_COLS)
                + " FROM features_missing WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in MISSING_COLS))
    if stat == "mode":
        parts = []
        for c in MISSING_COLS:
            parts.append(f"""(SELECT {c} FROM features_missing WHERE {c} IS NOT NULL
                             GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)""")
        fills = parts
    else:
        fn = {"mean": "avg({c})", "median": "quantile_cont({c}, 0.5)"}[stat]
        fills = [f"(SELECT {fn.format(c=c)} FROM features_missing)" for c in MISSING_COLS]
    cols = ", ".join(f"round(coalesce({c}, {f}), 6) AS {c}" for c, f in zip(MISSING_COLS, fills))
    return f"SELECT key, {cols} FROM features_missing"


for _m in ("drop", "mean", "median", "mode"):
    def _mk(m):
        def fn(spark, sf):
            out = prepare.impute(role(spark, sf, "features_missing"), m, MISSING_COLS)
            return _round_all(out)
        return fn
    query(f"impute_{_m}", _impute_sql(_m))(_mk(_m))


# ------------------------------------------------------------------- P2 - P5
@query("scale_standard", "WITH s AS (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in FEATURE_COLS) + " FROM features)\nSELECT key, " + ", ".join(
    f"round(CASE WHEN s_{c} > 0 THEN ({c} - m_{c}) / s_{c} ELSE 0.0 END, 6) AS {c}" for c in FEATURE_COLS)
    + " FROM features, s")
def q_scale_standard(spark, sf):
    return _round_all(prepare.scale(role(spark, sf, "features"), "standard", FEATURE_COLS))


@query("scale_minmax", "WITH s AS (SELECT " + ", ".join(
    f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in FEATURE_COLS) + " FROM features)\nSELECT key, " + ", ".join(
    f"round(CASE WHEN hi_{c} > lo_{c} THEN ({c} - lo_{c}) / (hi_{c} - lo_{c}) ELSE 0.0 END, 6) AS {c}"
    for c in FEATURE_COLS) + " FROM features, s")
def q_scale_minmax(spark, sf):
    return _round_all(prepare.scale(role(spark, sf, "features"), "minmax", FEATURE_COLS))


_NORM = "sqrt(" + " + ".join(f"{c} * {c}" for c in FEATURE_COLS) + ")"


@query("normalize_l2", f"WITH n AS (SELECT *, {_NORM} AS nrm FROM features)\nSELECT key, " + ", ".join(
    f"round(CASE WHEN nrm > 0 THEN {c} / nrm ELSE 0.0 END, 6) AS {c}" for c in FEATURE_COLS) + " FROM n")
def q_normalize_l2(spark, sf):
    return _round_all(prepare.scale(role(spark, sf, "features"), "normalize", FEATURE_COLS))


@query("scale_none", "SELECT * FROM features")
def q_scale_none(spark, sf):
    return prepare.scale(role(spark, sf, "features"), None, FEATURE_COLS)


# ------------------------------------------------------------------- P6 / P7
@query("pca")
def q_pca(spark, sf):
    scores, _ = prepare.pca(role(spark, sf, "features"), 2, FEATURE_COLS)
    return scores


@query("svd")
def q_svd(spark, sf):
    scores, _ = prepare.truncated_svd(role(spark, sf, "features"), 2, FEATURE_COLS)
    return scores


# ------------------------------------------------------------------------ P8
@query("documents_from_sequences", """
WITH ranked AS (SELECT subject_id, order_type, ordertime, poe_id,
                       row_number() OVER (PARTITION BY subject_id ORDER BY ordertime NULLS LAST, poe_id, order_type) AS rn
                FROM poe WHERE subject_id IS NOT NULL)
SELECT subject_id, list(order_type ORDER BY rn) FILTER (WHERE order_type IS NOT NULL) AS tokens
FROM ranked WHERE rn <= 20 GROUP BY subject_id
""")
def q_documents_from_sequences(spark, sf):
    seq = feats.order_sequences(role(spark, sf, "poe"), "subject_id", "order_type", "ordertime", 20,
                                tiebreak=["poe_id", "order_type"])
    return prepare.documents_from_sequences(seq, "subject_id")


@query("documents_from_histories", """
SELECT subject_id, order_type AS term, count(*) AS n FROM poe
WHERE subject_id IS NOT NULL AND order_type IS NOT NULL GROUP BY subject_id, order_type
""")
def q_documents_from_histories(spark, sf):
    return prepare.documents_from_histories(role(spark, sf, "poe"), "subject_id", "order_type")


# ------------------------------------------------------------------- P9 / P10
_TOKENS = r"""tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}')) AS term
            FROM documents),
tc AS (SELECT doc_id, term, count(*) AS n FROM tok GROUP BY doc_id, term)"""


@query("term_counts", f"WITH {_TOKENS}\nSELECT * FROM tc")
def q_term_counts(spark, sf):
    docs = prepare.documents_from_text(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text")
    return prepare.term_counts(docs, "doc_id", "text")


@query("tfidf", f"""WITH {_TOKENS},
voc AS (SELECT term FROM tc GROUP BY term ORDER BY sum(n) DESC, term LIMIT 1000),
kept AS (SELECT tc.* FROM tc JOIN voc USING (term)),
idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(DISTINCT doc_id))) + 1 AS idf
        FROM kept GROUP BY term),
w AS (SELECT doc_id, term, n * idf AS w FROM kept JOIN idf USING (term))
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS tfidf FROM w
""")
def q_tfidf(spark, sf):
    raw = spark.read.parquet(f"{sf}/documents.parquet")
    docs = prepare.documents_from_text(raw, "doc_id", "text")
    out = prepare.tfidf(prepare.term_counts(docs, "doc_id", "text"), "doc_id", 1000, n_docs=raw.count())
    return out.select("doc_id", "term", r6(F.col("tfidf")).alias("tfidf"))


# ------------------------------------------------------------------- C1 - C3
@query("kmeans")
def q_kmeans(spark, sf):
    labels, _ = cluster.kmeans(role(spark, sf, "features"), 5, FEATURE_COLS)
    return labels


@query("assign_nearest_center", """
WITH cen AS (SELECT l.cluster, f.feature, avg(f.value) AS mu FROM feature_long f JOIN cluster_labels l USING (key)
             GROUP BY l.cluster, f.feature),
d AS (SELECT f.key, c.cluster, sum((f.value - c.mu) * (f.value - c.mu)) AS d2
      FROM feature_long f JOIN cen c ON c.feature = f.feature GROUP BY f.key, c.cluster),
r AS (SELECT key, cluster, row_number() OVER (PARTITION BY key ORDER BY d2, cluster) AS rn FROM d)
SELECT key, CAST(cluster AS INTEGER) AS cluster FROM r WHERE rn = 1
""")
def q_assign_nearest_center(spark, sf):
    f, l = roles(spark, sf, "features", "cluster_labels")
    centres = cluster.centres_from_labels(joins.align_labels(f, l, "key"), FEATURE_COLS)
    return cluster.assign_nearest(f, centres, FEATURE_COLS)


@query("kmeans_k_scan")
def q_kmeans_k_scan(spark, sf):
    return cluster.kmeans_k_scan(role(spark, sf, "features"), range(2, 11), FEATURE_COLS)


def _steps_sql(steps: int, k: int) -> str:
    """Lloyd rounds from the rows of the ``k`` smallest keys, one CTE per round."""
    d2 = " + ".join(f"(f.{c} - c.{c}) * (f.{c} - c.{c})" for c in FEATURE_COLS)
    cols = ", ".join(FEATURE_COLS)
    parts = [f"c0 AS (SELECT row_number() OVER (ORDER BY key) - 1 AS cluster, 0 AS n, {cols} FROM features ORDER BY key LIMIT {k})"]
    for i in range(steps):
        parts.append(f"""a{i} AS (SELECT f.key, arg_min(c.cluster, ({d2}, c.cluster)) AS cluster FROM features f, c{i} c GROUP BY f.key)""")
        parts.append(f"""c{i + 1} AS (SELECT c.cluster, count(f.key) AS n, """ + ", ".join(f"coalesce(avg(f.{c}), max(c.{c})) AS {c}" for c in FEATURE_COLS)
                     + f""" FROM c{i} c LEFT JOIN a{i} a USING (cluster) LEFT JOIN features f ON f.key = a.key GROUP BY c.cluster)""")
    return ("WITH " + ",\n".join(parts) + f"\nSELECT CAST(cluster AS INTEGER) AS cluster, n, "
            + ", ".join(f"round({c}, 6) AS {c}" for c in FEATURE_COLS) + f" FROM c{steps}")


@query("kmeans_fixed_steps", _steps_sql(5, 5))
def q_kmeans_fixed_steps(spark, sf):
    f = role(spark, sf, "features")
    first = [[r[c] for c in FEATURE_COLS] for r in f.orderBy("key").limit(5).collect()]
    return _round_all(cluster.kmeans_steps(f, first, 5, FEATURE_COLS), keep=("cluster", "n"))


# ------------------------------------------------------------------------ C4
@query("dbscan_core_points", f"""
WITH p AS (SELECT key, f00, f01 FROM features)
SELECT a.key, count(*) AS n_neighbours, count(*) >= {DB_MIN} AS is_core
FROM p a JOIN p b ON sqrt((a.f00 - b.f00) * (a.f00 - b.f00) + (a.f01 - b.f01) * (a.f01 - b.f01)) <= {DB_EPS}
GROUP BY a.key
""")
def q_dbscan_core_points(spark, sf):
    return cluster.dbscan_core_points(role(spark, sf, "features"), ["f00", "f01"], DB_EPS, DB_MIN)


@query("dbscan")
def q_dbscan(spark, sf):
    return cluster.dbscan(role(spark, sf, "features"), FEATURE_COLS, DB_EPS, DB_MIN)


_D_ALL = "sqrt(" + " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in FEATURE_COLS) + ")"


@query("dbscan_core_points_all", f"""
SELECT a.key, count(*) AS n_neighbours, count(*) >= {DB_MIN} AS is_core
FROM features a JOIN features b ON {_D_ALL} <= {DB_EPS} GROUP BY a.key
""")
def q_dbscan_core_points_all(spark, sf):
    return cluster.dbscan_core_points(role(spark, sf, "features"), FEATURE_COLS, DB_EPS, DB_MIN)


DB_WIDE_EPS, DB_WIDE_MIN = 1.13, 4       # a radius at which the embeddings form clusters


@query("dbscan_labels", f"""
WITH RECURSIVE
e AS (SELECT a.key AS u, b.key AS v FROM features a JOIN features b ON {_D_ALL} <= {DB_WIDE_EPS}),
core AS (SELECT u AS key FROM e GROUP BY u HAVING count(*) >= {DB_WIDE_MIN}),
r AS (SELECT key, key AS root FROM core
      UNION
      SELECT e.v, r.root FROM r JOIN e ON e.u = r.key JOIN core c ON c.key = e.v),
lab AS (SELECT key, min(root) AS cluster FROM r GROUP BY key),
border AS (SELECT e.u AS key, min(lab.cluster) AS cluster FROM e JOIN lab ON lab.key = e.v
           WHERE e.u NOT IN (SELECT key FROM core) GROUP BY e.u)
SELECT f.key, coalesce(lab.cluster, border.cluster, -1) AS cluster
FROM features f LEFT JOIN lab ON lab.key = f.key LEFT JOIN border ON border.key = f.key
""")
def q_dbscan_labels(spark, sf):
    return cluster.dbscan(role(spark, sf, "features"), FEATURE_COLS, DB_WIDE_EPS, DB_WIDE_MIN)


# single linkage: Prim's order, in which the clusters of a cut are runs between its longest edges
_PRIM = f"""
dist AS (SELECT a.key AS u, b.key AS v, {_D_ALL} AS d FROM features a JOIN features b ON a.key <> b.key),
prim AS (SELECT 1 AS step, v AS key, d, first_value(v) OVER (ORDER BY d, v) AS pick, min(d) OVER () AS height
         FROM dist WHERE u = (SELECT min(key) FROM features)
         UNION ALL
         SELECT step + 1, key, d, first_value(key) OVER (ORDER BY d, key), min(d) OVER ()
         FROM (SELECT p.step, p.key, least(p.d, n.d) AS d
               FROM prim p JOIN dist n ON n.u = p.pick AND n.v = p.key WHERE p.key <> p.pick) x),
steps AS (SELECT DISTINCT step, pick, height FROM prim)"""
LINKAGE_K = 12


@query("single_linkage", f"""
WITH RECURSIVE {_PRIM},
cuts AS (SELECT step, pick, row_number() OVER (ORDER BY height DESC, step) < {LINKAGE_K} AS cut FROM steps),
runs AS (SELECT pick AS key, sum(CAST(cut AS INTEGER)) OVER (ORDER BY step) AS run FROM cuts
         UNION ALL SELECT min(key), 0 FROM features)
SELECT key, min(key) OVER (PARTITION BY run) AS cluster FROM runs
""")
def q_single_linkage(spark, sf):
    return cluster.single_linkage(role(spark, sf, "features"), LINKAGE_K, FEATURE_COLS)


@query("linkage_heights", f"""
WITH RECURSIVE {_PRIM}
SELECT round(height, 6) AS height, count(*) AS n_merges FROM steps GROUP BY 1
""")
def q_linkage_heights(spark, sf):
    tree = cluster.linkage_tree(role(spark, sf, "features"), FEATURE_COLS)
    return tree.groupBy(r6(F.col("distance")).alias("height")).agg(F.count(F.lit(1)).alias("n_merges"))


# ------------------------------------------------------------------- C6 - C9
@query("hierarchical")
def q_hierarchical(spark, sf):
    labels, _ = cluster.bisecting_kmeans(role(spark, sf, "features"), 5, FEATURE_COLS)
    return labels


def _lda(spark, sf):
    raw = spark.read.parquet(f"{sf}/documents.parquet")
    docs = raw.select("doc_id", prepare.tokenize(F.col("text")).alias("tokens"))
    return cluster.lda_topics(docs, "doc_id", "tokens", n_topics=5, max_features=1000)


@query("lda_topics")
def q_lda_topics(spark, sf):
    td, _, _ = _lda(spark, sf)
    return td


@query("lda_topics_tfidf")
def q_lda_topics_tfidf(spark, sf):
    raw = spark.read.parquet(f"{sf}/documents.parquet")
    docs = raw.select("doc_id", prepare.tokenize(F.col("text")).alias("tokens"))
    td, _, _ = cluster.lda_topics(docs, "doc_id", "tokens", n_topics=5, max_features=1000, vectorizer="tfidf")
    return td


@query("lda_top_terms")
def q_lda_top_terms(spark, sf):
    _, pipe, _ = _lda(spark, sf)
    return cluster.top_terms_per_topic(pipe, 10)


@query("order_patterns_by_cluster", """
WITH m AS (SELECT p.subject_id, p.order_type, c.cluster FROM poe p JOIN patient_clusters c USING (subject_id) WHERE c.cluster IS NOT NULL),
top AS (SELECT order_type, count(*) AS n FROM m WHERE order_type IS NOT NULL GROUP BY order_type ORDER BY n DESC, order_type LIMIT 20),
cnt AS (SELECT subject_id, m.order_type, count(*) AS n FROM m JOIN top USING (order_type) GROUP BY subject_id, m.order_type),
pats AS (SELECT DISTINCT m.subject_id, m.cluster FROM m JOIN cnt USING (subject_id))
SELECT p.cluster, p.subject_id, t.order_type AS "order", CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM pats p CROSS JOIN top t LEFT JOIN cnt c ON c.subject_id = p.subject_id AND c.order_type = t.order_type
""")
def q_order_patterns_by_cluster(spark, sf):
    poe, pc = roles(spark, sf, "poe", "patient_clusters")
    return cluster.order_counts_by_cluster(poe, pc, "subject_id", "order_type", max_orders=20)


# ------------------------------------------------------------ M13 / O3 / O5
@query("feature_importance")
def q_feature_importance(spark, sf):
    f, l = roles(spark, sf, "features", "cluster_labels")
    return cluster.feature_importance(joins.align_labels(f, l, "key"), FEATURE_COLS)


@query("seeded_sample", "SELECT * FROM events ORDER BY md5('42:' || event_id), event_id LIMIT 1000")
def q_seeded_sample(spark, sf):
    return cluster.seeded_sample(spark.read.parquet(f"{sf}/events.parquet"), 1000, "event_id", seed=42)


@query("preview", "SELECT * FROM events ORDER BY event_id LIMIT 100")
def q_preview(spark, sf):
    from cohortlens.operators.profile import preview
    return preview(spark.read.parquet(f"{sf}/events.parquet"), "event_id", 100)


# ------------------------------------------------------------- J16 / C5 / W7
_KNN_SQL = """
p AS (SELECT key, f00, f01 FROM features),
pd AS (SELECT a.key, sqrt((a.f00 - b.f00) * (a.f00 - b.f00) + (a.f01 - b.f01) * (a.f01 - b.f01)) AS d,
              row_number() OVER (PARTITION BY a.key ORDER BY
                  sqrt((a.f00 - b.f00) * (a.f00 - b.f00) + (a.f01 - b.f01) * (a.f01 - b.f01))) AS rn
       FROM p a, p b),
kd AS (SELECT key, d AS knn_distance FROM pd WHERE rn = 5)"""


@query("knn_distance", f"WITH {_KNN_SQL}\nSELECT key, round(knn_distance, 6) AS knn_distance FROM kd")
def q_knn_distance(spark, sf):
    from cohortlens.operators.neighbors import knn_distances
    out = knn_distances(role(spark, sf, "features"), ["f00", "f01"], k=5)
    return out.select("key", r6(F.col("knn_distance")).alias("knn_distance"))


@query("dbscan_eps", f"""WITH {_KNN_SQL},
s AS (SELECT knn_distance, row_number() OVER (ORDER BY knn_distance) AS i FROM kd),
g AS (SELECT i, knn_distance, knn_distance - lag(knn_distance) OVER (ORDER BY i) AS gap FROM s)
SELECT round(knn_distance, 6) AS suggested_eps FROM g WHERE gap IS NOT NULL
ORDER BY gap DESC, i LIMIT 1
""")
def q_dbscan_eps(spark, sf):
    from cohortlens.operators.neighbors import suggest_eps
    out = suggest_eps(role(spark, sf, "features"), ["f00", "f01"], k=5)
    return out.select(r6(F.col("suggested_eps")).alias("suggested_eps"))


_KNN_ALL_SQL = f"""
pd AS (SELECT key, d, row_number() OVER (PARTITION BY key ORDER BY d) AS rn
       FROM (SELECT a.key, {_D_ALL} AS d FROM features a, features b)),
kd AS (SELECT key, d AS knn_distance FROM pd WHERE rn = 5)"""


@query("knn_distance_all", f"WITH {_KNN_ALL_SQL}\nSELECT key, round(knn_distance, 6) AS knn_distance FROM kd")
def q_knn_distance_all(spark, sf):
    from cohortlens.operators.neighbors import knn_distances
    out = knn_distances(role(spark, sf, "features"), FEATURE_COLS, k=5)
    return out.select("key", r6(F.col("knn_distance")).alias("knn_distance"))


@query("dbscan_eps_all", f"""WITH {_KNN_ALL_SQL},
s AS (SELECT knn_distance, row_number() OVER (ORDER BY knn_distance) AS i FROM kd),
g AS (SELECT i, knn_distance, knn_distance - lag(knn_distance) OVER (ORDER BY i) AS gap FROM s)
SELECT round(knn_distance, 6) AS suggested_eps FROM g WHERE gap IS NOT NULL
ORDER BY gap DESC, i LIMIT 1
""")
def q_dbscan_eps_all(spark, sf):
    from cohortlens.operators.neighbors import suggest_eps
    out = suggest_eps(role(spark, sf, "features"), FEATURE_COLS, k=5)
    return out.select(r6(F.col("suggested_eps")).alias("suggested_eps"))
