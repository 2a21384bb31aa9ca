"""Exact silhouette, many K-means in one pass: against brute force, the earlier operators and hand-made cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import cluster, evaluate, lloyd
from cohortlens.operators.tiles import vector_rows

COLS = ["x", "y", "z"]


def table(spark, x, labels):
    return spark.createDataFrame([(i, None if c is None else int(c), *map(float, r)) for i, (r, c) in enumerate(zip(x, labels))], "key long, cluster int, x double, y double, z double")


def brute_silhouette(x, labels):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = {}
    for i, c in enumerate(labels):
        mean = {o: d[i, labels == o].sum() / max(1, (labels == o).sum() - (o == c)) for o in set(labels.tolist())}
        a, b = mean.pop(c), min(mean.values())
        out[i] = 0.0 if (labels == c).sum() == 1 or max(a, b) == 0 else (b - a) / max(a, b)
    return out


@pytest.mark.parametrize("tile", [2048, 7])
def test_silhouette_equals_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(evaluate, "TILE", tile)
    monkeypatch.setattr("cohortlens.operators.tiles.TILE", tile)
    monkeypatch.setattr(evaluate.tiles, "__defaults__", (tile,))
    rng = np.random.default_rng(0)
    x, labels = rng.normal(size=(90, 3)).round(1), rng.integers(0, 4, size=90)
    labels[0] = 9                                       # a cluster of one row
    x[30:60], labels[30:60] = x[30], 2                  # a third of the rows are copies
    got = {r.key: r.silhouette for r in evaluate.silhouette_samples(table(spark, x, labels), COLS).collect()}
    want = brute_silhouette(x, labels)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    some = {r.key: r.silhouette for r in evaluate.silhouette_samples(table(spark, x, labels), COLS, queries=F.col("key") % 10 == 0).collect()}
    assert set(some) == set(range(0, 90, 10)) and all(abs(some[k] - want[k]) < 1e-9 for k in some)
    mean = evaluate.silhouette_exact(table(spark, x, labels), COLS).first()[0]
    assert abs(mean - np.mean(list(want.values()))) < 1e-9


def test_silhouette_of_one_cluster_nulls_and_nothing(spark):
    one = evaluate.silhouette_samples(table(spark, np.eye(3), [1, 1, 1]), COLS).collect()
    assert len(one) == 3 and all(math.isnan(r.silhouette) for r in one)
    assert evaluate.silhouette_samples(table(spark, np.zeros((0, 3)), []), COLS).count() == 0
    odd = table(spark, np.eye(3), [1, 2, None]).union(spark.createDataFrame([(7, 1, None, 0.0, 0.0)], "key long, cluster int, x double, y double, z double"))
    assert {r.key for r in evaluate.silhouette_samples(odd, COLS).collect()} == {0, 1}


def test_shared_rounds_equal_single_models(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(60, 3)) + 4 * c for c in range(3)])
    rows = vector_rows(table(spark, x, [0] * len(x)).repartition(3), COLS)
    models = [x[:3], x[10:15], x[50:52]]

    def brute(c):
        while True:
            at = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
            after = np.array([x[at == j].mean(0) if (at == j).any() else c[j] for j in range(len(c))])
            if np.allclose(after, c, atol=1e-12):
                return c, ((x - c[at]) ** 2).sum()
            c = after
    centres, cost = lloyd.lloyd(rows, models, tol=0.0)
    for m, c, v in zip(models, centres, cost):
        want, best = brute(m)
        assert np.allclose(c, want) and abs(v - best) < 1e-8
    ix = lloyd.indices(rows, centres)
    for c, got in zip(centres, ix):
        at = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
        lab = table(spark, x, at)
        want = evaluate.centroid_indices(lab, COLS)
        assert abs(got["davies_bouldin"] - want["davies_bouldin"]) < 1e-9 and abs(got["calinski_harabasz"] - want["calinski_harabasz"]) < 1e-6
        assert abs(got["silhouette_sq"] - evaluate.silhouette_sq(lab, COLS).first()[0]) < 1e-9


def test_as_many_jobs_as_the_longest_model(spark, monkeypatch):
    x = np.vstack([np.random.default_rng(2).normal(size=(50, 3)) + 9 * c for c in range(4)])
    calls, step = [], lloyd.step
    monkeypatch.setattr(lloyd, "step", lambda rows, centres, width: calls.append(len(centres)) or step(rows, centres, width))
    lloyd.lloyd(vector_rows(table(spark, x, [0] * len(x)), COLS), lloyd.starts(vector_rows(table(spark, x, [0] * len(x)), COLS), [2, 3, 4], 10, 42))
    assert calls[0] == 30 and calls == sorted(calls, reverse=True) and len(calls) < 40


def test_scan_of_empty_and_repeated_rows(spark):
    assert cluster.kmeans_k_scan(table(spark, np.zeros((0, 3)), []), [2, 3], COLS).count() == 0
    same = cluster.kmeans_k_scan(table(spark, np.ones((20, 3)), [0] * 20), [2], COLS).first()
    assert same.inertia == 0
