"""Clustering, topic models and feature importance.

Models are Spark ML estimators trained on the whole frame (no row caps);
only fixed-size model state (centres, topic-term weights, importances)
reaches the driver.  Labels come back as ``(key, cluster)`` frames.
DBSCAN is built from joins and aggregations: locations and small cells
(diameter < eps) whose members are neighbours without pairing, an exact
cross-cell eps join, core flags by neighbour count, and connected components
by alternating star steps; above 3 features tiles of points are compared instead.
"""

from __future__ import annotations

import itertools
import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import LDA, BisectingKMeans, KMeans
from pyspark.ml.feature import CountVectorizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.session import Scratch, materialize
from cohortlens.functions.frames import numeric_columns, q
from cohortlens.operators import evaluate, lloyd
from cohortlens.operators.components import star_components
from cohortlens.operators.epsgraph import EpsGraph, spanning_tree
from cohortlens.operators.tiles import vector_rows

MAX_GRID_DIMS = 3
SPREAD = 16_384         # rows of a partition, beyond which K-means spreads them


def _vectors(df: DataFrame, features: list[str], key: str) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features").transform(
        df.select(key, *features))


def _best_kmeans(vec: DataFrame, k: int, n_init: int, max_iter: int, seed: int):
    best = None
    for i in range(n_init):
        m = KMeans(k=k, maxIter=max_iter, seed=seed + i, featuresCol="features",
                   predictionCol="cluster").fit(vec)
        cost = m.summary.trainingCost
        if best is None or cost < best[0]:
            best = (cost, m)
    return best[1]


# ------------------------------------------------------------------------ C1
def kmeans(df: DataFrame, k: int = 5, features=None, key: str = "key", n_init: int = 10,
           max_iter: int = 300, seed: int = 42, persist: bool = True):
    """K-means with ``n_init`` restarts (seeds ``seed + i``); the fit with the
    lowest training cost wins.  Returns ``(labels(key, cluster), model)``.
    The assembled vectors are cached for the restarts and released after."""
    feats = list(features) if features else numeric_columns(df, exclude={key})
    vec = _vectors(df, feats, key).select(key, "features")
    n = vec.count()
    if n > vec.rdd.getNumPartitions() * SPREAD:      # a few large files would leave most cores idle in every round
        vec = vec.repartition(-(-n // SPREAD))
    if persist:
        vec = vec.persist()
    try:
        model = _best_kmeans(vec, k, n_init, max_iter, seed)
        labels = model.transform(vec).select(key, F.col("cluster").cast("int").alias("cluster"))
        if persist:
            # materialise to the shared checkpoint folder before the cache is released
            labels = materialize(labels)
        return labels, model
    finally:
        if persist:
            vec.unpersist()


# ------------------------------------------------------------------------ C2
def assign_nearest(df: DataFrame, centres: list[list[float]], features: list[str], key: str = "key") -> DataFrame:
    """Label each row with its nearest centre (squared Euclidean; ties -> lower id).

    ``centres`` is the model's fixed-size state (k x d) applied as one literal
    array; distances are array expressions (``zip_with`` / ``aggregate``), so
    the generated code stays small for any k and d.
    """
    x = F.array(*[q(f).cast("double") for f in features])
    cs = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centres])
    dist = F.transform(cs, lambda c: F.aggregate(F.zip_with(x, c, lambda a, b: (a - b) * (a - b)),
                                                 F.lit(0.0), lambda acc, v: acc + v))
    return (df.select(key, dist.alias("_d"))
              .select(key, (F.array_position("_d", F.array_min("_d")) - 1).cast("int").alias("cluster")))


def centres_from_labels(labelled: DataFrame, features: list[str], cluster: str = "cluster") -> list[list[float]]:
    """Cluster means in label order (k rows, bounded)."""
    rows = evaluate.centroids(labelled, features, cluster).orderBy(cluster).collect()
    evaluate._check_k(len(rows))
    return [[r[f] for f in features] for r in rows]


# ------------------------------------------------------------------------ C3
def kmeans_k_scan(df: DataFrame, ks=range(2, 11), features=None, key: str = "key", seed: int = 42,
                  n_init: int = 10, max_iter: int = 300) -> DataFrame:
    """Inertia, squared silhouette, Davies-Bouldin, Calinski-Harabasz for each k,
    and the pick of each selection rule: elbow (arg-max of the relative inertia
    change + 1, clamped), best silhouette (max), Davies-Bouldin (min) and
    Calinski-Harabasz (max); NaN values are skipped.  Each k is the best of ``n_init``
    starts; all models share each scan of the vectors (:mod:`cohortlens.operators.lloyd`).
    Rows with a null feature are left out; an empty table gives no rows."""
    feats = list(features) if features else numeric_columns(df, exclude={key})
    scratch, ks = Scratch(df.sparkSession, "k-scan"), [int(k) for k in ks]
    vec = scratch.keep(vector_rows(df, feats))
    first = lloyd.starts(vec, ks, n_init, seed)
    rows = []
    if first:
        vec = scratch.keep(lloyd.pack(vec, first[0].shape[1]))
        centres, cost = lloyd.lloyd(vec, first, max_iter)
        best = [min(range(i * n_init, (i + 1) * n_init), key=lambda j: cost[j]) for i in range(len(ks))]
        for k, i, ix in zip(ks, best, lloyd.indices(vec, [centres[i] for i in best])):
            rows.append((k, cost[i], *[None if v is None else float(v) for v in ix.values()]))
    scratch.close()
    inert = [r[1] for r in rows]
    # elbow rule: relative change (I[i+1] - I[i]) / I[i], arg-max (first) + 1, clamped to the last k
    rate = [(inert[i + 1] - inert[i]) / inert[i] if inert[i] else 0.0 for i in range(len(inert) - 1)]
    elbow_idx = min(rate.index(max(rate)) + 1, len(rows) - 1) if rate else 0

    def arg(values, best):
        ok = [(v, i) for i, v in enumerate(values) if v is not None and v == v]
        if not ok:
            return -1
        target = best(v for v, _ in ok)
        return next(i for v, i in ok if v == target)

    best_sil = arg([r[2] for r in rows], max)
    best_db = arg([r[3] for r in rows], min)
    best_ch = arg([r[4] for r in rows], max)
    spark = df.sparkSession
    return spark.createDataFrame(
        [r + (i == elbow_idx, i == best_sil, i == best_db, i == best_ch) for i, r in enumerate(rows)],
        "k int, inertia double, silhouette_sq double, davies_bouldin double, calinski_harabasz double, "
        "elbow boolean, best_silhouette boolean, best_davies_bouldin boolean, best_calinski_harabasz boolean")


def kmeans_steps(df: DataFrame, centres: list[list[float]], steps: int, features: list[str]) -> DataFrame:
    """``cluster, n, <features>``: the centres after ``steps`` rounds from given ones, and the rows each attracted in the last."""
    import numpy as np
    scratch = Scratch(df.sparkSession, "kmeans-steps")
    after, n = lloyd.fixed_steps(scratch.keep(vector_rows(df, features)), np.array(centres, dtype=float), steps)
    scratch.close()
    return df.sparkSession.createDataFrame([(i, int(m), *map(float, c)) for i, (m, c) in enumerate(zip(n, after))],
                                           "cluster int, n long, " + ", ".join(f"`{f}` double" for f in features))


# ------------------------------------------------------------------------ C4
def _metric_expr(metric: str, a: list[Column], b: list[Column]) -> Column:
    if metric == "euclidean":
        return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b)), F.lit(0.0)))
    if metric == "manhattan":
        return sum((F.abs(x - y) for x, y in zip(a, b)), F.lit(0.0))
    raise ValueError(f"metric {metric} has no exact grid join; use euclidean, manhattan or cosine")


def _points(df: DataFrame, features: list[str], key: str, eps: float, metric: str):
    """Points ``(key, _x0.._x{d-1})`` without nulls, plus the metric and eps to
    search with (cosine becomes Euclidean on unit vectors)."""
    xs = [q(f).cast("double") for f in features]
    base = df.where(" AND ".join(f"`{f}` IS NOT NULL" for f in features))
    if metric == "cosine":
        # cosine distance 1 - cos(u, v) <= eps  <=>  |u/|u| - v/|v|| <= sqrt(2 eps):
        # an exact Euclidean join on the unit-normalised points (zero rows have no angle: dropped)
        norm = F.sqrt(sum((x * x for x in xs), F.lit(0.0)))
        pts = base.where(norm > 0).select(F.col(key), *[(x / norm).alias(f"_x{i}") for i, x in enumerate(xs)])
        return pts, float((2.0 * eps) ** 0.5), "euclidean"
    _metric_expr(metric, [], [])  # validate the metric name
    return base.select(F.col(key), *[x.alias(f"_x{i}") for i, x in enumerate(xs)]), float(eps), metric


def _small_cells(metric: str, eps: float, d: int) -> tuple[float, int]:
    """Cell side so that any two points of one cell are closer than eps, and the
    number of cells (per dimension) an eps-neighbour can be away."""
    side = eps / (math.sqrt(d) if metric == "euclidean" else d) * (1 - 1e-9)
    return side, int(math.ceil(eps / side))


def eps_neighbours(df: DataFrame, features: list[str], eps: float, key: str = "key",
                   metric: str = "euclidean"):
    """Exact eps-neighbourhoods (distance <= eps, inclusive) without quadratic blocks.

    * Points with identical coordinates collapse into one *location* (id =
      smallest key there, weight = number of points).
    * Locations fall into small grid cells whose diameter is below eps, so all
      locations of one cell are neighbours of each other: they are counted
      by the cell's total weight, never paired.  A spot holding a third of all
      rows inside one cell costs one row per location.
    * Only locations in *different* cells within reach are paired, through an
      equi-join on the shifted cell coordinates and the exact distance test.

    For up to 3 features; above that see :mod:`cohortlens.operators.epsgraph`.

    Returns ``(points(key, _loc), locations(_loc, _w, _cell), cross pairs(_loc, _nloc, _nw))``.
    """
    pts, eps, metric = _points(df, features, key, eps, metric)
    d = len(features)
    if d > MAX_GRID_DIMS:
        raise ValueError(f"a grid has at most {MAX_GRID_DIMS} axes; above that the pairs are never written out")
    xs = [f"_x{i}" for i in range(d)]
    side, reach = _small_cells(metric, eps, d)
    locs = (pts.groupBy(*xs).agg(F.min(key).alias("_loc"), F.count(F.lit(1)).alias("_w"))
               .select("_loc", "_w", *xs, *[F.floor(F.col(x) / F.lit(side)).cast("long").alias(f"_c{i}")
                                           for i, x in enumerate(xs)]))
    offsets = [list(o) for o in itertools.product(range(-reach, reach + 1), repeat=d) if any(o)]
    probe = (locs.select("_loc", *xs, F.explode(F.array(*[F.array(*[F.lit(v) for v in o]) for o in offsets]))
                         .alias("_o"), *[f"_c{i}" for i in range(d)])
                 .select("_loc", *xs, *[(F.col(f"_c{i}") + F.col("_o")[i]).alias(f"_c{i}") for i in range(d)]))
    other = locs.select(F.col("_loc").alias("_nloc"), F.col("_w").alias("_nw"),
                        *[F.col(x).alias(f"_y{i}") for i, x in enumerate(xs)], *[f"_c{i}" for i in range(d)])
    dist = _metric_expr(metric, [F.col(x) for x in xs], [F.col(f"_y{i}") for i in range(d)])
    cross = (probe.join(other, [f"_c{i}" for i in range(d)]).where(dist <= F.lit(eps))
                  .select("_loc", "_nloc", "_nw"))
    point_loc = pts.join(locs.select(*xs, "_loc"), xs).select(key, "_loc")
    cells = locs.select("_loc", "_w", F.struct(*[f"_c{i}" for i in range(d)]).alias("_cell"))
    return point_loc, cells, cross


def _tiled(df: DataFrame, features: list[str], eps: float, key: str, metric: str, scratch: Scratch, named: bool = True):
    """Points with their locations, and the eps graph of the finite locations (:mod:`cohortlens.operators.epsgraph`).

    A location is named by its smallest key (integer keys), or else by a number of its own.
    """
    pts, eps, metric = _points(df, features, key, eps, metric)
    xs = [f"_x{i}" for i in range(len(features))]
    pts = scratch.keep(pts.select((F.col(key).cast("long") if named else F.col(key)).alias(key), F.array(*xs).alias("x")))
    locs = pts.groupBy("x").agg(*[F.min(key).alias("loc")] * named, F.count(F.lit(1)).alias("w"))
    locs = scratch.keep(locs if named else locs.withColumn("loc", F.monotonically_increasing_id()))
    finite = F.forall("x", lambda v: F.abs(v) < F.lit(float("inf")))       # any other location has no neighbour but itself
    return pts.join(locs, "x").select(key, "loc"), locs, EpsGraph(locs.where(finite), eps, metric, scratch)


def _tiled_counts(locs: DataFrame, graph: EpsGraph) -> DataFrame:
    """``loc, n``: neighbours of every location, its own rows included."""
    if graph.s is None:
        return locs.select("loc", F.col("w").alias("n"))
    return locs.join(graph.counts(), "loc", "left").select("loc", F.coalesce("n", "w").alias("n"))


def _tiled_dbscan(df, features, eps, min_samples, key, metric) -> DataFrame:
    scratch = Scratch(df.sparkSession, "dbscan")
    points, locs, graph = _tiled(df, features, eps, key, metric, scratch)
    core = scratch.keep(_tiled_counts(locs, graph).where(F.col("n") >= int(min_samples)).select("loc"))
    if graph.s is None or core.isEmpty():
        labels = core.select("loc", F.col("loc").alias("label"))
    else:
        joined = star_components(graph.links(core), scratch).withColumnRenamed("node", "loc")
        labels = scratch.keep(core.join(joined, "loc", "left").select("loc", F.coalesce("label", "loc").alias("label")))
        labels = labels.union(graph.border(labels))
    out = (df.select(key).join(points.join(labels, "loc").select(key, "label"), key, "left")
             .select(key, F.coalesce("label", F.lit(-1)).cast("long").alias("cluster")))
    out = Scratch(df.sparkSession, "dbscan-labels").keep(out)
    scratch.close()
    return out


def _location_counts(cells: DataFrame, cross: DataFrame) -> DataFrame:
    """Neighbours of every location: its cell's whole weight plus the cross pairs."""
    own = cells.join(cells.groupBy("_cell").agg(F.sum("_w").alias("_cw")), "_cell")
    far = cross.groupBy("_loc").agg(F.sum("_nw").alias("_xw"))
    return (own.join(far, "_loc", "left")
               .select("_loc", "_cell", (F.col("_cw") + F.coalesce(F.col("_xw"), F.lit(0))).alias("n_neighbours")))


def dbscan_core_points(df: DataFrame, features: list[str], eps: float, min_samples: int,
                       key: str = "key", metric: str = "euclidean") -> DataFrame:
    """(key, n_neighbours including itself, is_core), by one pass over pairs of tiles whatever the
    number of features: cells wholly within eps count by their weight, the others' points are compared as matrices."""
    scratch = Scratch(df.sparkSession, "dbscan-core")
    points, locs, graph = _tiled(df, features, eps, key, metric, scratch, named=False)
    cnt = points.join(_tiled_counts(locs, graph), "loc").select(key, F.col("n").alias("n_neighbours"))
    cnt = Scratch(df.sparkSession, "dbscan-counts").keep(cnt)
    scratch.close()
    return cnt.withColumn("is_core", F.col("n_neighbours") >= F.lit(int(min_samples)))


def connected_components(edges: DataFrame, nodes: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, label) with label = smallest node id of the node's component (:mod:`cohortlens.operators.components`)."""
    scratch = Scratch(edges.sparkSession, "components")
    found = star_components(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")), scratch)
    out = nodes.select("node").join(found, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    out = Scratch(edges.sparkSession, "component-labels").keep(out)
    scratch.close()
    return out


def dbscan(df: DataFrame, features: list[str], eps: float = 0.5, min_samples: int = 5, key: str = "key",
           metric: str = "euclidean") -> DataFrame:
    """DBSCAN labels ``(key, cluster)``; noise is -1.

    Above 3 features three passes over pairs of tiles give the neighbour counts, the links between
    core locations and the border labels (integer keys; :mod:`cohortlens.operators.epsgraph`).  Up to 3 it
    works on locations and small cells (see :func:`eps_neighbours`).  A
    location is core when the points within eps (its own included) number at
    least ``min_samples``.  Core locations of one cell are linked to the
    cell's smallest core location (a star, not all pairs); core locations of
    different cells are linked by the cross pairs.  Clusters are the connected
    components (:func:`connected_components`), labelled by the smallest core
    key; a border location takes the smallest label among its core
    neighbours (same cell or cross pairs); points inherit their location's
    label.
    """
    if len(features) > MAX_GRID_DIMS:
        return _tiled_dbscan(df, features, eps, min_samples, key, metric)
    point_loc, cells, cross = eps_neighbours(df, features, eps, key, metric)
    cross = materialize(cross)
    counts = materialize(_location_counts(cells, cross))
    core = counts.where(F.col("n_neighbours") >= F.lit(int(min_samples))).select("_loc", "_cell")
    core_ids = core.select(F.col("_loc").alias("node"))
    rep = core.groupBy("_cell").agg(F.min("_loc").alias("_rep"))
    star = core.join(rep, "_cell").where(F.col("_loc") != F.col("_rep"))
    cross_core = (cross.join(core.select("_loc"), "_loc", "left_semi")
                       .join(core.select(F.col("_loc").alias("_nloc")), "_nloc", "left_semi")
                       .select("_loc", "_nloc"))
    edges = (cross_core
             .unionByName(star.select("_loc", F.col("_rep").alias("_nloc")))
             .unionByName(star.select(F.col("_rep").alias("_loc"), F.col("_loc").alias("_nloc"))))
    labels = connected_components(edges, core_ids, "_loc", "_nloc")
    lab = labels.select(F.col("node").alias("_nloc"), F.col("label").alias("_l"))
    non_core = counts.join(core.select("_loc"), "_loc", "left_anti").select("_loc", "_cell")
    via_cross = cross.join(non_core.select("_loc"), "_loc", "left_semi").join(lab, "_nloc").select("_loc", "_l")
    cell_label = (rep.join(lab.withColumnRenamed("_nloc", "_rep"), "_rep").select("_cell", "_l"))
    via_cell = non_core.join(cell_label, "_cell").select("_loc", "_l")
    border = via_cross.unionByName(via_cell).groupBy("_loc").agg(F.min("_l").alias("label"))
    assigned = labels.select(F.col("node").alias("_loc"), "label").unionByName(border)
    labelled = point_loc.join(assigned, "_loc").select(key, "label")
    return (df.select(key).join(labelled, key, "left")
              .select(key, F.coalesce(F.col("label"), F.lit(-1)).cast("long").alias("cluster")))


# ------------------------------------------------------------------------ C6
def bisecting_kmeans(df: DataFrame, k: int = 5, features=None, key: str = "key", seed: int = 42):
    """Divisive hierarchical clustering of all rows (replaces the row-capped
    agglomerative tree: same "cut the hierarchy at k" output, not equal labels)."""
    feats = list(features) if features else numeric_columns(df, exclude={key})
    vec = _vectors(df, feats, key)
    model = BisectingKMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(vec)
    return model.transform(vec).select(key, F.col("cluster").cast("int").alias("cluster")), model


def _finite_locations(df: DataFrame, features: list[str], key: str, scratch: Scratch):
    rows = scratch.keep(vector_rows(df, features, F.col(key).cast("long").alias(key)).where(F.forall("x", lambda v: F.abs(v) < F.lit(float("inf")))))
    locs = scratch.keep(rows.groupBy("x").agg(F.min(key).alias("loc"), F.count(F.lit(1)).alias("w")))
    return rows.join(locs, "x").select(key, "loc"), locs


def linkage_tree(df: DataFrame, features: list[str], key: str = "key", metric: str = "euclidean") -> DataFrame:
    """``lo, hi, distance``: the merges of single linkage over all rows, which are the edges of their minimum
    spanning tree.  Rows with equal features are one end, named by the smallest key."""
    scratch = Scratch(df.sparkSession, "linkage")
    tree = spanning_tree(_finite_locations(df, features, key, scratch)[1], scratch, metric)
    if tree is not None:
        tree = Scratch(df.sparkSession, "linkage-tree").keep(tree.withColumnRenamed("d", "distance"))
    scratch.close()
    return tree if tree is not None else df.sparkSession.createDataFrame([], "lo long, hi long, distance double")


def single_linkage(df: DataFrame, k: int, features=None, key: str = "key", metric: str = "euclidean") -> DataFrame:
    """``key, cluster``: the single-linkage tree of all rows cut at ``k`` clusters; a cluster is named by its smallest key.

    The ``k - 1`` longest edges of the minimum spanning tree go, of equal ones those with the larger ends first; what
    is left connected is a cluster.  Rows with equal features stay together, so with fewer than ``k`` different rows each
    of them is a cluster.  Rows with a null or non-finite feature are left out.  Integer keys.
    """
    feats = list(features) if features else numeric_columns(df, exclude={key})
    scratch = Scratch(df.sparkSession, "linkage")
    points, locs = _finite_locations(df, feats, key, scratch)
    tree = spanning_tree(locs, scratch, metric)
    labels = locs.select("loc", F.col("loc").alias("label"))
    if tree is not None:
        tree = scratch.keep(tree)
        cut = tree.orderBy(F.desc("d"), F.desc("lo"), F.desc("hi")).limit(int(k) - 1).select("lo", "hi")
        joined = star_components(tree.join(cut, ["lo", "hi"], "left_anti").select(F.col("hi").alias("u"), F.col("lo").alias("v")), scratch)
        labels = locs.select("loc").join(joined.withColumnRenamed("node", "loc"), "loc", "left").select("loc", F.coalesce("label", "loc").alias("label"))
    out = Scratch(df.sparkSession, "linkage-labels").keep(points.join(labels, "loc").select(key, F.col("label").alias("cluster")))
    scratch.close()
    return out


# ------------------------------------------------------------------- C7 / C8
def lda_topics(docs: DataFrame, key: str, tokens: str, n_topics: int = 5, max_features: int = 1000,
               max_iter: int = 10, seed: int = 42, vectorizer: str = "count"):
    """Online LDA over count or TF-IDF vectors.

    Returns ``(doc_topics, model, vocabulary)`` with doc_topics = (key,
    topic_distribution array, dominant_topic); ``model.stages`` are the
    fitted vocabulary and the LDA model.  ``tfidf`` weights are the smoothed
    ``tf * (ln((1+n)/(1+df)) + 1)``, L2-normalised per document: Spark's IDF
    gives ``ln((1+n)/(1+df))``.  Vectors stay sparse and are stored alone, without
    the texts they come from, once for all passes of the fit and the topics.
    """
    if vectorizer not in ("count", "tfidf"):
        raise ValueError(f"unknown vectorizer {vectorizer}")
    scratch = Scratch(docs.sparkSession, "lda")     # stays: the topics are read from it
    base = docs.select(key, tokens)
    cv_model = CountVectorizer(inputCol=tokens, outputCol="counts", vocabSize=max_features).fit(base)
    vec = cv_model.transform(base)
    feats = "counts"
    if vectorizer == "tfidf":
        from pyspark.ml.feature import IDF, ElementwiseProduct, Normalizer
        from pyspark.ml.linalg import Vectors
        vec = scratch.keep(vec.select(key, "counts"))
        idf = IDF(inputCol="counts", outputCol="_idf").fit(vec).idf.toArray()
        weighted = ElementwiseProduct(scalingVec=Vectors.dense(idf + 1), inputCol="counts", outputCol="_raw").transform(vec)
        vec = Normalizer(inputCol="_raw", outputCol="_tfidf", p=2.0).transform(weighted)
        feats = "_tfidf"
    vec = scratch.keep(vec.select(key, feats)).persist()
    # every iteration sees the whole corpus (an epoch), as ``max_iter`` passes of the online method do
    lda_model = LDA(k=n_topics, maxIter=max_iter, optimizer="online", subsamplingRate=1.0, seed=seed,
                    featuresCol=feats, topicDistributionCol="_td").fit(vec)
    vec.unpersist()
    td = lda_model.transform(vec).select(key, vector_to_array("_td").alias("_v"))
    # a document without any vocabulary term gets the uniform (prior) distribution
    total = F.aggregate("_v", F.lit(0.0), lambda a, b: a + b)
    uniform = F.array_repeat(F.lit(1.0 / n_topics), n_topics)
    td = td.select(key, F.when(total > 0, F.col("_v")).otherwise(uniform).alias("topic_distribution"))
    td = td.withColumn("dominant_topic",
                       (F.array_position("topic_distribution", F.array_max("topic_distribution")) - 1).cast("int"))
    return td, PipelineModel(stages=[cv_model, lda_model]), cv_model.vocabulary


def top_terms_per_topic(pipe: PipelineModel, n: int = 10) -> DataFrame:
    """(topic, rank, term, weight) for the top ``n`` terms of every topic."""
    vocab = pipe.stages[0].vocabulary
    topics = pipe.stages[1].describeTopics(n)
    spark = topics.sparkSession
    vdf = spark.createDataFrame(list(enumerate(vocab)), "term_index int, term string")
    ex = topics.select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "tw"))
    ex = ex.select("topic", (F.col("rank") + 1).alias("rank"), F.col("tw.termIndices").alias("term_index"),
                   F.col("tw.termWeights").alias("weight"))
    return ex.join(vdf, "term_index").select("topic", "rank", "term", "weight")


# ------------------------------------------------------------------------ C9
def order_patterns_by_cluster(seq: DataFrame, labels: DataFrame, patient: str, sequence: str = "sequence",
                              max_orders: int = 20, per_cluster: int = 50, seed: int = 42,
                              cluster: str = "cluster") -> DataFrame:
    """Heat-map input ``(cluster, patient, order, n)``.

    Patients with both a sequence and a label are matched; the ``max_orders``
    most frequent orders over the matched sequences are kept; at most
    ``per_cluster`` patients per cluster are chosen by a seeded hash order
    (repeatable sampling, a partial group limit before the shuffle); each
    chosen patient gets one count per kept order (zeros included) from its
    sequence.
    """
    from cohortlens.operators.features import top_value_list
    matched = seq.select(patient, sequence).join(labels.select(patient, cluster), patient)
    top = top_value_list(matched.select(F.explode(sequence).alias("_o")), "_o", max_orders)
    rank = F.row_number().over(
        Window.partitionBy(cluster).orderBy(F.xxhash64(F.col(patient), F.lit(seed)), F.col(patient)))
    chosen = matched.withColumn("_r", rank).where(F.col("_r") <= per_cluster).drop("_r")
    counts = F.array(*[F.struct(F.lit(o).alias("order"),
                                F.size(F.filter(sequence, lambda x: x == F.lit(o))).cast("bigint").alias("n"))
                       for o in top])
    return (chosen.select(cluster, patient, F.explode(counts).alias("_c"))
                  .select(cluster, patient, F.col("_c.order").alias("order"), F.col("_c.n").alias("n")))


def order_counts_by_cluster(orders: DataFrame, labels: DataFrame, patient: str, order: str,
                            max_orders: int = 20, cluster: str = "cluster") -> DataFrame:
    """Heat-map counts ``(cluster, patient, order, n)`` over whole histories.

    Orders of labelled patients; the ``max_orders`` most frequent of them are
    kept; every patient with a kept order gets one count per kept order (zeros
    included).  A plot samples patients from this with :func:`seeded_sample`.
    """
    from cohortlens.operators.features import order_frequency
    lab = labels.where(F.col(cluster).isNotNull()).select(patient, cluster)
    matched = orders.select(patient, order).join(lab, patient, "left_semi")
    counts = order_frequency(matched, patient, order, top_n=max_orders)
    return counts.join(lab, patient).select(cluster, patient, F.col(order).alias("order"), "n")


# ------------------------------------------------------------------------ O5
def seeded_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """At most ``n`` rows chosen by a seeded hash of the key (repeatable)."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), F.col(key)).limit(int(n))


# ----------------------------------------------------------------------- M13
def feature_importance(labelled: DataFrame, features: list[str], cluster: str = "cluster",
                       n_trees: int = 100, seed: int = 42, max_depth: int = 10) -> DataFrame:
    """Random-forest importances for predicting the cluster from standardised features, largest first."""
    vec = VectorAssembler(inputCols=features, outputCol="_raw").transform(
        labelled.select(F.col(cluster).cast("double").alias("_y"), *features))
    sc = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True).fit(vec).transform(vec)
    rf = RandomForestClassifier(numTrees=n_trees, maxDepth=max_depth, seed=seed, featuresCol="_x", labelCol="_y").fit(sc)
    imp = rf.featureImportances.toArray().tolist()
    spark = labelled.sparkSession
    ranked = sorted(zip(features, [float(x) for x in imp]), key=lambda x: (-x[1], x[0]))
    return spark.createDataFrame(ranked, "feature string, importance double")
