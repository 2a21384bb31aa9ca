"""Exact k-nearest-neighbour distances and the DBSCAN eps suggestion
(SURVEY J16, C5, W7) in any dimension.

No pairwise cross product up to 3 features: points are grouped by identical coordinates
(one row per location with its multiplicity), then searched on a grid whose
cell size doubles each round.  In round j a still-unresolved location meets
only the locations of its own and adjacent cells of size ``r_j``; every
point within ``r_j`` is among them, so once at least k points lie within
``r_j`` the k-th smallest candidate distance is exact.  Locations are
dropped from the search as soon as they resolve, so a point never meets
more than the points within about twice its own k-distance.  Above ``MAX_DIMS``
features, where a grid prunes nothing, stripes of tiles are compared as matrices
(:func:`cohortlens.operators.epsgraph.kth_distances`).
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.session import Scratch, materialize
from cohortlens.functions.frames import q
from cohortlens.operators.epsgraph import kth_distances
from cohortlens.operators.tiles import vector_rows

MAX_DIMS = 3        # axes of the grid


def _dist(metric: str, a: list[Column], b: list[Column]) -> Column:
    if metric == "euclidean":
        return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b)), F.lit(0.0)))
    if metric == "manhattan":
        return sum((F.abs(x - y) for x, y in zip(a, b)), F.lit(0.0))
    raise ValueError(f"unsupported metric {metric}")


def _tiled_knn(df: DataFrame, features: list[str], k: int, key: str, metric: str) -> DataFrame:
    _dist(metric, [], [])       # validate the metric name
    scratch = Scratch(df.sparkSession, "knn")
    pts = scratch.keep(vector_rows(df, features, key))
    locs = scratch.keep(pts.groupBy("x").agg(F.count(F.lit(1)).alias("w")).withColumn("loc", F.monotonically_increasing_id()))
    finite = locs.where(F.forall("x", lambda v: F.abs(v) < F.lit(float("inf"))))       # no other location is within reach of any
    found = locs.select("loc", "x").join(kth_distances(finite, k, scratch, metric), "loc", "left")
    out = Scratch(df.sparkSession, "knn-distances").keep(pts.join(found, "x").select(key, "knn_distance"))
    scratch.close()
    return out


def knn_distances(df: DataFrame, features: list[str], k: int = 5, key: str = "key",
                  metric: str = "euclidean", r0: float | None = None, max_rounds: int = 64) -> DataFrame:
    """(key, knn_distance): distance to the k-th nearest point, counting the
    point itself as the first (distance 0); null when fewer than k points."""
    d = len(features)
    if d > MAX_DIMS:
        return _tiled_knn(df, features, k, key, metric)
    pts = df.select(key, *[q(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)]).where(
        " AND ".join(f"_x{i} IS NOT NULL" for i in range(d)))
    xs = [f"_x{i}" for i in range(d)]
    locs = pts.groupBy(*xs).agg(F.count(F.lit(1)).alias("_w")).withColumn("_loc", F.monotonically_increasing_id())
    locs = materialize(locs)  # stable location ids, read once per round
    gs = [f"_g{i}" for i in range(d)]
    grid = locs.select("_loc", "_w", F.array(*xs).alias("_x"), *[F.col(x).alias(g) for g, x in zip(gs, xs)])
    st = locs.agg(F.sum("_w").alias("n"), *[x for c in xs for x in (F.min(c), F.max(c))]).first()
    n = st["n"] or 0
    spans = [(st[2 + 2 * i] or 0.0) - (st[1 + 2 * i] or 0.0) for i in range(d)]
    diag = math.sqrt(sum(s * s for s in spans)) if metric == "euclidean" else sum(spans)
    if r0 is None:
        # start at the radius that holds ~k points in the *densest* region: a dense
        # spot (say a third of all points in a tiny area) then resolves in the first
        # rounds with few candidates each, instead of meeting all of its points at a
        # radius sized for the average density; sparse points just take more rounds.
        vol = math.prod(s for s in spans if s > 0) if any(s > 0 for s in spans) else 1.0
        dims = max(1, sum(1 for s in spans if s > 0))
        r_avg = (vol * k / max(n, 1)) ** (1.0 / dims) if n else 1.0
        r_avg = r_avg if r_avg > 0 else 1.0
        coarse = 4.0 * r_avg
        dense = (grid.groupBy(*[F.floor(F.col(g) / F.lit(coarse)) for g in gs])
                     .agg(F.sum("_w").alias("c")).agg(F.max("c")).first()[0] or 1)
        r0 = min(0.25 * r_avg, 0.5 * coarse * (k / dense) ** (1.0 / dims))
        r0 = r0 if r0 > 0 else 1.0
    offsets = [list(o) for o in itertools.product((-1, 0, 1), repeat=len(gs))]
    unresolved = grid
    done = []
    r = float(r0)
    for _ in range(max_rounds):
        cells = [F.floor(F.col(g) / F.lit(r)).cast("long") for g in gs]
        probe = (unresolved.select("_loc", "_x", F.explode(F.array(*[F.array(*[F.lit(v) for v in o])
                                                                  for o in offsets])).alias("_o"),
                                   *[c.alias(f"_c{i}") for i, c in enumerate(cells)])
                 .select("_loc", "_x", *[(F.col(f"_c{i}") + F.col("_o")[i]).alias(f"_c{i}") for i in range(len(gs))]))
        other = grid.select(F.col("_w").alias("_wn"), F.col("_x").alias("_y"),
                            *[c.alias(f"_c{i}") for i, c in enumerate(cells)])
        dist = _dist(metric, [F.col("_x")[i] for i in range(d)], [F.col("_y")[i] for i in range(d)])
        pairs = (probe.join(other, [f"_c{i}" for i in range(len(gs))])
                      .select("_loc", "_wn", dist.alias("_d"))
                      .where(F.col("_d") <= F.lit(r)))
        w = Window.partitionBy("_loc").orderBy("_d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cum = pairs.withColumn("_cum", F.sum("_wn").over(w))
        res = materialize(cum.where(F.col("_cum") >= k).groupBy("_loc").agg(F.min("_d").alias("knn_distance")))
        done.append(res)
        unresolved = materialize(unresolved.join(res.select("_loc"), "_loc", "left_anti"))
        if unresolved.isEmpty():
            break
        if r > 2 * diag + 1e-12:   # everything already within reach: fewer than k points
            break
        r *= 2.0
    found = done[0]
    for x in done[1:]:
        found = found.unionByName(x)
    loc_d = locs.join(found, "_loc", "left").select(*xs, "knn_distance")
    return pts.join(loc_d, xs, "left").select(key, "knn_distance")


GROUP = 4096        # intervals that one window sorts


def largest_gap_value(values: DataFrame, col: str, group: int = GROUP) -> float | None:
    """W7 on a distributed column: of the sorted values, the one just after the largest difference (the
    first such on ties); the value itself when all are equal, None for fewer than two.  Nulls and NaN are left out.

    By the pigeonhole principle no gap inside a bucket can be the largest when ``n`` values fall into more than
    ``n`` equal-width buckets, so a bucket is its minimum and maximum, one hash aggregate.  What lies between
    neighbouring buckets is found level by level: ``group`` bucket numbers share a window, which therefore never
    holds more than ``group`` rows, and go up as one interval; about ``log n / log group`` levels.
    """
    v = values.select(F.col(col).cast("double").alias("v")).where("v is not null and not isnan(v)")
    n, lo, hi = v.agg(F.count(F.lit(1)), F.min("v"), F.max("v")).first()
    if n < 2:
        return None
    if lo == hi or math.isinf(lo) or math.isinf(hi):
        # copies of one value, or a gap without end: before +inf, or after -inf
        return float(hi) if not math.isinf(lo) else float(v.where(F.col("v") > F.lit(lo)).agg(F.coalesce(F.min("v"), F.lit(lo))).first()[0])
    count = 2 * (n + 1)
    number = F.least(F.floor((F.col("v") - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(count))), F.lit(count - 1)).cast("long")
    level = materialize(v.groupBy(number.alias("b")).agg(F.min("v").alias("lo"), F.max("v").alias("hi")))
    best = (0.0, lo, lo)
    while count > 1:
        w = Window.partitionBy("g").orderBy("b")
        gaps = (level.withColumn("g", F.floor(F.col("b") / F.lit(group)))
                     .select("g", F.lag("hi").over(w).alias("before"), F.col("lo").alias("after"))
                     .where("before is not null").withColumn("gap", F.col("after") - F.col("before")))
        top = gaps.orderBy(F.desc("gap"), "before").limit(1).collect()
        if top and (-top[0].gap, top[0].before) < (-best[0], best[1]):
            best = (top[0].gap, top[0].before, top[0].after)
        level = level.groupBy(F.floor(F.col("b") / F.lit(group)).alias("b")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        count = -(-count // group)
    return float(best[2])


def suggest_eps(df: DataFrame, features: list[str], k: int = 5, key: str = "key",
                metric: str = "euclidean") -> DataFrame:
    """The k-distance value just after the steepest rise of the sorted
    k-distance curve, over all rows.  One row ``suggested_eps``."""
    kd = knn_distances(df, features, k, key, metric)
    eps = largest_gap_value(kd, "knn_distance")
    return df.sparkSession.createDataFrame([(eps,)], "suggested_eps double")
