"""Clustering quality metrics and agreement.

All metrics are computed from per-cluster aggregates (k rows, k checked
against ``MAX_CLUSTERS``) joined back to the rows on the cluster key.  ``silhouette_sq`` is the squared-
Euclidean silhouette (Spark's ``ClusteringEvaluator``), whose cluster means
decompose exactly into per-cluster sums; ``silhouette_exact`` is the plain-Euclidean
one, from tiled distance sums.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.functions.frames import q
from cohortlens.operators.tiles import TILE, tiles, vector_rows
from cohortlens.session import Scratch

MAX_CLUSTERS = 10_000


def _check_k(k: int) -> None:
    if k > MAX_CLUSTERS:
        raise ValueError(f"{k} clusters exceed the bound {MAX_CLUSTERS}")


def centroids(labelled: DataFrame, features: list[str], cluster: str = "cluster") -> DataFrame:
    """(cluster, n, feature means...) -- one row per cluster."""
    return labelled.groupBy(cluster).agg(F.count(F.lit(1)).alias("_n"),
                                         *[F.avg(q(f)).alias(f) for f in features])


def centroid_indices(labelled: DataFrame, features: list[str], cluster: str = "cluster") -> dict:
    """Inertia, Davies-Bouldin and Calinski-Harabasz from two passes.

    Pass 1: cluster means and sizes (k rows, k checked).  Pass 2: every row's
    distance to its own mean -- the k means travel as one literal map, so no
    join -- summed per cluster (k rows).  The indices are closed forms of
    those 2k rows.
    """
    cent = centroids(labelled, features, cluster).collect()
    k = len(cent)
    _check_k(k)
    out = {"k": k, "n": sum(r["_n"] for r in cent), "inertia": None, "davies_bouldin": None,
           "calinski_harabasz": None}
    if k == 0:
        return out
    means = F.create_map(*[x for r in cent for x in (
        F.lit(r[cluster]), F.array(*[F.lit(float(r[f]) if r[f] is not None else None) for f in features]))])
    x = F.array(*[q(f).cast("double") for f in features])
    d2 = F.aggregate(F.zip_with(x, F.element_at(means, F.col(cluster)), lambda a, b: (a - b) * (a - b)),
                     F.lit(0.0), lambda acc, v: acc + v)
    per = {r[cluster]: r for r in labelled.select(cluster, d2.alias("_d2")).groupBy(cluster).agg(
        F.sum("_d2").alias("_w"), F.avg(F.sqrt("_d2")).alias("_s")).collect()}
    C = np.array([[r[f] for f in features] for r in cent], dtype=float)
    N = np.array([r["_n"] for r in cent], dtype=float)
    W = np.array([per[r[cluster]]["_w"] for r in cent], dtype=float)
    S = np.array([per[r[cluster]]["_s"] for r in cent], dtype=float)
    n = out["n"]
    w = float(W.sum())
    out["inertia"] = w
    if k > 1:
        mu = (N[:, None] * C).sum(0) / n
        b = float((N * ((C - mu) ** 2).sum(1)).sum())
        out["calinski_harabasz"] = (b / (k - 1)) / (w / (n - k)) if n > k and w else None
        dist = np.sqrt(((C[:, None, :] - C[None, :, :]) ** 2).sum(-1))
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = (S[:, None] + S[None, :]) / dist
        np.fill_diagonal(ratio, -np.inf)
        out["davies_bouldin"] = float(np.mean(np.max(ratio, axis=1)))
    return out


def _one(labelled: DataFrame, name: str, value) -> DataFrame:
    return labelled.sparkSession.createDataFrame([(value,)], f"{name} double")


# ------------------------------------------------------------------------ M4
def inertia(labelled: DataFrame, features: list[str], cluster: str = "cluster") -> DataFrame:
    """Sum of squared distances of rows to their cluster mean."""
    return _one(labelled, "inertia", centroid_indices(labelled, features, cluster)["inertia"])


# ------------------------------------------------------------------------ M3
def calinski_harabasz(labelled: DataFrame, features: list[str], cluster: str = "cluster") -> DataFrame:
    """(B/(k-1)) / (W/(n-k)); null for a single cluster."""
    return _one(labelled, "calinski_harabasz", centroid_indices(labelled, features, cluster)["calinski_harabasz"])


# ------------------------------------------------------------------------ M2
def davies_bouldin(labelled: DataFrame, features: list[str], cluster: str = "cluster") -> DataFrame:
    """Mean over clusters of max_j (s_i + s_j) / d(c_i, c_j); s = mean distance to centre."""
    return _one(labelled, "davies_bouldin", centroid_indices(labelled, features, cluster)["davies_bouldin"])


# ------------------------------------------------------------------------ M1
def silhouette_sq(labelled: DataFrame, features: list[str], cluster: str = "cluster") -> DataFrame:
    """Mean squared-Euclidean silhouette (Spark ClusteringEvaluator); NaN for one cluster."""
    spark = labelled.sparkSession
    k = labelled.select(cluster).distinct().limit(MAX_CLUSTERS + 1).count()
    _check_k(k)
    if k < 2:
        return spark.createDataFrame([(float("nan"),)], "silhouette_sq double")
    vec = VectorAssembler(inputCols=features, outputCol="_v").transform(
        labelled.select(F.col(cluster).cast("double").alias("_p"), *features))
    ev = ClusteringEvaluator(featuresCol="_v", predictionCol="_p", metricName="silhouette",
                             distanceMeasure="squaredEuclidean")
    return spark.createDataFrame([(float(ev.evaluate(vec)),)], "silhouette_sq double")


TILE_GROUP = 64         # tiles that one task compares with a tile of queries


def silhouette_samples(labelled: DataFrame, features: list[str], key: str = "key", cluster: str = "cluster",
                       queries: Column | None = None) -> DataFrame:
    """``key, cluster, silhouette`` by plain Euclidean distances to *all* rows, for all rows or those of ``queries``.

    Rows are gathered into tiles of bounded size.  Every tile of queries meets every tile; a task keeps, for each
    query row, one distance sum per cluster, so what is shuffled is ``k`` sums per query row and group of tiles, never a
    pair of rows.  ``(b - a) / max(a, b)`` with ``a`` the mean distance to the own cluster's other rows and ``b``
    the least mean distance to another cluster; 0 in a cluster of one row, and where all distances are 0; NaN when there is only one cluster.  Rows
    with a null feature or cluster are left out.  Integer keys and clusters.
    """
    spark = labelled.sparkSession
    scratch = Scratch(spark, "silhouette")
    width = len(features)
    rows = scratch.keep(vector_rows(labelled.where(F.col(cluster).isNotNull()), features, F.col(key).cast("long").alias("key"),
                                    F.col(cluster).cast("long").alias("cluster"), *([] if queries is None else [queries.alias("asked")])))
    sizes = scratch.keep(rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("m")))
    n, k = sizes.agg(F.sum("m"), F.count(F.lit(1))).first()
    asked = rows if queries is None else rows.where("asked")
    if not n or k < 2:
        return asked.select(F.col("key").alias(key), F.col("cluster").alias(cluster), F.lit(float("nan")).alias("silhouette"))
    every = scratch.keep(tiles(rows.select("key", "cluster", "x"), width, n))
    few = every if queries is None else scratch.keep(tiles(asked.select("key", "cluster", "x"), width, asked.count()))
    few = few.select(F.col("tile").alias("q"), F.col("key").alias("qk"), F.col("cluster").alias("qc"), F.col("x").alias("qx"))
    count = max(1, -(-n // TILE))
    # one row per (tile of queries, tile): an equi-join on the tile's number, dealt to tasks by groups of tiles
    turns = (few.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))).join(every, "tile")
                .withColumn("g", F.floor(F.col("tile") / TILE_GROUP)).repartition("q", "g").sortWithinPartitions("q", "g"))
    schema = pa.schema([("key", pa.int64()), ("own", pa.int64()), ("cluster", pa.int64()), ("s", pa.float64())])

    def sums(batches):
        at, keys, own, acc = None, None, None, {}

        def done():
            names = sorted(acc)
            out = np.array([acc[c] for c in names])
            return pa.record_batch([pa.array(np.tile(keys, len(names))), pa.array(np.tile(own, len(names))), pa.array(np.repeat(names, len(keys)).astype(np.int64)),
                                    pa.array(out.reshape(-1))], schema=schema)
        for b in batches:
            for r in b.to_pylist():
                if at != (r["q"], r["g"]):
                    if at is not None:
                        yield done()
                    at, acc = (r["q"], r["g"]), {}
                    keys, own = np.frombuffer(r["qk"], dtype=np.int64), np.frombuffer(r["qc"], dtype=np.int64)
                    x = np.frombuffer(r["qx"]).reshape(-1, width)
                y, c = np.frombuffer(r["x"]).reshape(-1, width), np.frombuffer(r["cluster"], dtype=np.int64)
                order = np.argsort(c, kind="stable")
                names, first = np.unique(c[order], return_index=True)
                y = y[order]
                for s in range(0, len(x), 256):        # differences as such: no cancellation near zero
                    d2 = np.zeros((len(x[s:s + 256]), len(y)))
                    for j in range(width):
                        d2 += (x[s:s + 256, j, None] - y[None, :, j]) ** 2
                    part = np.add.reduceat(np.sqrt(d2), first, axis=1)
                    for i, name in enumerate(names.tolist()):
                        acc.setdefault(name, np.zeros(len(x)))[s:s + 256] += part[:, i]
        if at is not None:
            yield done()

    per = (turns.mapInArrow(sums, "key long, own long, cluster long, s double").groupBy("key", "own", "cluster").agg(F.sum("s").alias("s"))
                .join(sizes, "cluster"))
    same = F.col("cluster") == F.col("own")
    ab = per.groupBy("key", "own").agg(F.max(F.when(same, F.col("s") / F.nullif(F.col("m") - 1, F.lit(0)))).alias("a"),
                                       F.min(F.when(~same, F.col("s") / F.col("m"))).alias("b"), F.max(F.when(same, F.col("m"))).alias("m"))
    top = F.greatest("a", "b")
    value = F.when((F.col("m") == 1) | (top == 0), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / top)
    return ab.select(F.col("key").alias(key), F.col("own").alias(cluster), value.alias("silhouette"))


def silhouette_exact(labelled: DataFrame, features: list[str], key: str = "key", cluster: str = "cluster") -> DataFrame:
    """Mean plain-Euclidean silhouette of all rows; NaN for one cluster."""
    return silhouette_samples(labelled, features, key, cluster).agg(F.avg("silhouette").alias("silhouette_exact"))


# ----------------------------------------------------------------------- M11
def adjusted_rand(labels_a: DataFrame, labels_b: DataFrame, key: str = "key", cluster: str = "cluster",
                  noise=-1) -> DataFrame:
    """Adjusted Rand index of two labelings aligned on ``key``.

    Rows where either side is noise are removed; fewer than 2 rows -> NaN.
    Computed from the contingency counts (one aggregate) in closed form.
    """
    a = labels_a.select(key, F.col(cluster).alias("_a"))
    b = labels_b.select(key, F.col(cluster).alias("_b"))
    j = a.join(b, key)
    if noise is not None:
        j = j.where((F.col("_a") != F.lit(noise)) & (F.col("_b") != F.lit(noise)))
    cont = j.groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("nij"))

    def c2(x):
        return x * (x - 1) / 2.0

    # Row and column sums on the (bounded) contingency rows by window; each
    # cell contributes nij*(ai-1)/2 so the sums over cells equal sum_i C(ai, 2).
    ai = F.sum("nij").over(Window.partitionBy("_a"))
    bj = F.sum("nij").over(Window.partitionBy("_b"))
    r = (cont.select("nij", ai.alias("ai"), bj.alias("bj"))
             .agg(F.sum(c2(F.col("nij"))).alias("idx"), F.sum("nij").alias("n"),
                  F.sum(F.col("nij") * (F.col("ai") - 1) / 2.0).alias("sa"),
                  F.sum(F.col("nij") * (F.col("bj") - 1) / 2.0).alias("sb")))
    n = F.col("n").cast("double")
    expected = F.col("sa") * F.col("sb") / c2(n)
    mx = (F.col("sa") + F.col("sb")) / 2.0
    ari = (F.when(F.coalesce(n, F.lit(0.0)) < 2, F.lit(float("nan")))
            .when(mx == expected, F.lit(1.0))
            .otherwise((F.col("idx") - expected) / (mx - expected)))
    return r.select(ari.alias("adjusted_rand"))


# ----------------------------------------------------------------------- M12
def metrics_summary(labelled: DataFrame, features: list[str], name: str, cluster: str = "cluster",
                    noise=-1) -> DataFrame:
    """One row: clusters, noise %, silhouette (squared), Davies-Bouldin,
    Calinski-Harabasz -- indices on non-noise rows (M14)."""
    stats = labelled.agg(F.count(F.lit(1)).alias("n"),
                         F.sum((F.col(cluster) == F.lit(noise)).cast("bigint")).alias("noise"),
                         F.countDistinct(F.when(F.col(cluster) != F.lit(noise), F.col(cluster))).alias("k")
                         ).first()
    clean = labelled.where(F.col(cluster) != F.lit(noise))
    sil = silhouette_sq(clean, features, cluster).first()[0]
    ix = centroid_indices(clean, features, cluster)
    db, ch = ix["davies_bouldin"], ix["calinski_harabasz"]
    pct = 100.0 * (stats["noise"] or 0) / stats["n"] if stats["n"] else None
    spark = labelled.sparkSession
    return spark.createDataFrame(
        [(name, int(stats["k"]), pct, None if sil is None or math.isnan(sil) else sil, db, ch)],
        "algorithm string, n_clusters bigint, noise_pct double, silhouette_sq double, "
        "davies_bouldin double, calinski_harabasz double")
