"""DBSCAN and single linkage above three features, and star components: against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import cluster, epsgraph
from cohortlens.operators.components import star_components
from cohortlens.session import Scratch

COLS = [f"c{i}" for i in range(5)]


def table(spark, x, extra=()):
    rows = [(i, *map(float, r)) for i, r in enumerate(x)] + [(len(x) + i, *r) for i, r in enumerate(extra)]
    return spark.createDataFrame(rows, "key long, " + ", ".join(f"{c} double" for c in COLS))


def distances(x, metric):
    if metric == "cosine":
        u = x / np.sqrt((x * x).sum(1, keepdims=True))
        return 1 - u @ u.T
    d = x[:, None] - x[None]
    return np.sqrt((d * d).sum(-1)) if metric == "euclidean" else np.abs(d).sum(-1)


def brute_dbscan(d, eps, m):
    near = d <= eps
    core = near.sum(1) >= m
    label = np.where(core, np.arange(len(d)), len(d))
    while True:
        new = np.where(core, np.where(near & core[None], label[None], len(d)).min(1, initial=len(d)), len(d))
        if (new == label).all():
            break
        label = new
    border = np.where(near & core[None], label[None], len(d)).min(1, initial=len(d))
    out = np.where(core, label, border)
    return {i: int(c) if c < len(d) else -1 for i, c in enumerate(out)}, near.sum(1)


@pytest.fixture()
def small_tiles(monkeypatch):
    """Several tiles in a cell and several cells, on a few hundred points."""
    monkeypatch.setattr(epsgraph.EpsGraph.__init__, "__defaults__", (16,))
    monkeypatch.setattr(epsgraph.spanning_tree, "__defaults__", ("euclidean", 16))
    monkeypatch.setattr(epsgraph, "LEAVES", 8)
    monkeypatch.setattr(epsgraph, "STEP", 7)
    monkeypatch.setattr(epsgraph, "TILE_GROUP", 3)


def blobs(seed=3):
    rng = np.random.default_rng(seed)
    x = np.vstack([rng.normal(size=(70, 5)) * 0.4 + np.eye(5)[c] * 6 for c in range(3)] + [rng.uniform(-3, 12, size=(40, 5))])
    x[100:140] = x[100] + rng.normal(size=(40, 5)) * 1e-3       # a dense spot inside one cell
    x[200:230] = x[200]                                         # copies
    return rng.permutation(x)


@pytest.mark.parametrize("metric,eps", [("euclidean", 0.9), ("manhattan", 1.5), ("cosine", 0.01)])
def test_dbscan_equals_brute_force(spark, small_tiles, metric, eps):
    x = blobs()
    want, n = brute_dbscan(distances(x, metric), eps, 5)
    got = {r["key"]: r["cluster"] for r in cluster.dbscan(table(spark, x), COLS, eps, 5, metric=metric).collect()}
    assert got == want and len(set(want.values())) > 3
    core = {r["key"]: r["n_neighbours"] for r in cluster.dbscan_core_points(table(spark, x), COLS, eps, 5, metric=metric).collect()}
    assert core == dict(enumerate(n.tolist()))


def test_dbscan_counts_a_distance_of_exactly_eps(spark, small_tiles):
    x = np.zeros((40, 5))
    x[:, 0] = np.arange(40) * 0.5       # neighbours at exactly eps
    got = {r["key"]: r["n_neighbours"] for r in cluster.dbscan_core_points(table(spark, x + 1000.0), COLS, 0.5, 3).collect()}
    assert got == {i: 2 if i in (0, 39) else 3 for i in range(40)}


def test_dense_spot_is_decided_by_weights(spark, small_tiles):
    """A spot of most rows in one place: its cells are inside one another's reach and no tile pair is left."""
    rng = np.random.default_rng(0)
    rows = table(spark, rng.normal(size=(300, 5)) * 1e-4)
    scratch = Scratch(spark, "test")
    _, locs, graph = cluster._tiled(rows, COLS, 0.5, "key", "euclidean", scratch)
    assert graph.part.count() == 0 and graph.whole.count() > 8
    assert {r.n for r in graph.counts().collect()} == {300}
    links = graph.links(locs.select("loc"))
    assert links.count() <= 300 + graph.whole.count()           # in proportion to the rows, not to their pairs
    assert cluster.dbscan(rows, COLS, 0.5, 5).select("cluster").distinct().collect()[0][0] == 0
    scratch.close()


def test_nulls_infinities_and_nothing(spark):
    x = np.zeros((6, 5))
    odd = [(None, 0.0, 0.0, 0.0, 0.0), (float("inf"), 0.0, 0.0, 0.0, 0.0), (float("nan"), 0.0, 0.0, 0.0, 0.0)]
    got = {r["key"]: r["cluster"] for r in cluster.dbscan(table(spark, x, odd), COLS, 0.5, 3).collect()}
    assert got == {**{i: 0 for i in range(6)}, 6: -1, 7: -1, 8: -1}
    assert {r["key"]: r["cluster"] for r in cluster.single_linkage(table(spark, x, odd), 3, COLS).collect()} == {i: 0 for i in range(6)}
    empty = table(spark, x).where("key < 0")
    assert cluster.dbscan(empty, COLS, 0.5, 3).count() == 0
    assert cluster.single_linkage(empty, 3, COLS).count() == 0 and cluster.linkage_tree(empty, COLS).count() == 0


def brute_linkage(d, k):
    """Kruskal over all edges until ``k`` clusters are left; also the heights of all merges."""
    n = len(d)
    label, heights, at_k = list(range(n)), [], None
    if n <= k:
        at_k = list(label)
    for i, j in sorted(((i, j) for i in range(n) for j in range(i + 1, n)), key=lambda e: (d[e], e)):
        if label[i] != label[j]:
            lo, hi = sorted((label[i], label[j]))
            label = [lo if v == hi else v for v in label]
            heights.append(d[i, j])
            if at_k is None and len(set(label)) == k:
                at_k = list(label)
    return at_k, sorted(heights)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_single_linkage_equals_kruskal(spark, small_tiles, metric):
    x = np.unique(blobs(5), axis=0)[:150]
    labels, heights = brute_linkage(distances(x, metric), 9)
    got = {r["key"]: r["cluster"] for r in cluster.single_linkage(table(spark, x), 9, COLS, metric=metric).collect()}
    assert got == dict(enumerate(labels)) and len(set(labels)) == 9
    tree = cluster.linkage_tree(table(spark, x), COLS, metric=metric).collect()
    assert len(tree) == len(x) - 1 and np.allclose(sorted(r.distance for r in tree), heights, rtol=1e-12, atol=0)


def test_single_linkage_of_copies_and_ties(spark, small_tiles):
    x = np.zeros((60, 5))
    x[:, 0] = np.arange(60) // 2        # pairs of copies, all gaps equal
    got = {r["key"]: r["cluster"] for r in cluster.single_linkage(table(spark, x), 3, COLS).collect()}
    assert got == {i: 0 if i < 56 else 56 if i < 58 else 58 for i in range(60)}
    alone = {r["key"]: r["cluster"] for r in cluster.single_linkage(table(spark, x), 100, COLS).collect()}
    assert alone == {i: i - i % 2 for i in range(60)}


def test_star_components_of_one_giant(spark):
    """A star, a path and small components; the giant's edges are not one task's."""
    n = 3000
    star = spark.range(1, n).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
    path = spark.range(n, n + 200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    pairs = spark.range(5000, 5100).select((F.col("id") * 2).alias("u"), (F.col("id") * 2 + 1).alias("v"))
    scratch = Scratch(spark, "test")
    got = {r.node: r.label for r in star_components(star.union(path).union(pairs), scratch).collect()}
    scratch.close()
    assert len(got) == n + 201 + 200
    assert all(got[i] == 0 for i in range(n)) and all(got[i] == n for i in range(n, n + 201))
    assert all(got[2 * i] == got[2 * i + 1] == 2 * i for i in range(5000, 5100))


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_kth_distances_equal_brute_force(spark, small_tiles, monkeypatch, metric):
    """Copies, a dense spot and tiles in several stripes; no pairs are exploded on a grid."""
    from cohortlens.operators import neighbors
    monkeypatch.setattr(epsgraph.kth_distances, "__defaults__", ("euclidean", 16))
    x = blobs(8)
    odd = [(None, 0.0, 0.0, 0.0, 0.0), (float("nan"), 0.0, 0.0, 0.0, 0.0), (float("inf"), 0.0, 0.0, 0.0, 0.0)]
    got = {r.key: r.knn_distance for r in neighbors.knn_distances(table(spark, x, odd), COLS, 4, metric=metric).collect()}
    want = np.sort(distances(x, metric), axis=1)[:, 3]
    assert set(got) == {*range(len(x)), len(x) + 1, len(x) + 2} and got[len(x) + 1] is None and got[len(x) + 2] is None
    assert all(abs(got[i] - want[i]) < 1e-12 for i in range(len(x))) and (want == 0).sum() > 20
    few = neighbors.knn_distances(table(spark, x[:3]), COLS, 4, metric=metric).collect()
    assert [r.knn_distance for r in few] == [None] * 3


def test_pairs_of_tiles_meet_once_and_points_move_once_per_stripe(spark, small_tiles):
    import pyarrow as pa
    scratch = Scratch(spark, "test")
    x = np.random.default_rng(1).normal(size=(400, 5))
    locs = table(spark, x).select(F.col("key").alias("loc"), F.lit(1).cast("long").alias("w"), F.array(*COLS).alias("x"))
    s = epsgraph.split(locs, scratch, "euclidean", 16)
    n = int(s.base[-1])
    assert s.stripes > 2 and s.per <= 3

    def work(tiles, pairs):
        return [len(tiles)] + [tiles[i].number for i, _ in pairs], [-1] + [tiles[j].number for _, j in pairs]
    schema = pa.schema([("i", pa.int64()), ("j", pa.int64())])
    every = [(p, q) for p in range(s.stripes) for q in range(p, s.stripes)]
    rows = epsgraph.meet(s, scratch, every, work, schema, "i long, j long").collect()
    pairs = [(r.i, r.j) for r in rows if r.j >= 0]
    assert len(pairs) == len(set(pairs)) == n * (n + 1) // 2
    assert sum(r.i for r in rows if r.j < 0) == n * s.stripes        # tiles sent: not one for each pair of tiles
    scratch.close()


def test_core_points_of_two_features_without_pair_rows(spark, monkeypatch):
    """Two features take the same pass: no join of cells, whose longest task grew with the square of a dense spot."""
    monkeypatch.setattr(cluster, "eps_neighbours", None)
    x = np.random.default_rng(2).normal(size=(200, 5)).round(2)
    got = {r.key: r.n_neighbours for r in cluster.dbscan_core_points(table(spark, x), COLS[:2], 0.3, 5).collect()}
    assert got == dict(enumerate((distances(x[:, :2], "euclidean") <= 0.3).sum(1).tolist()))
