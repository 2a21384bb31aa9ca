"""Many K-means models in one pass.

All models -- every ``k``, every start -- share each scan of the data: a task computes the distances to all
centres of all unfinished models at once and keeps, per centre, a count, a cost and a coordinate sum.  One
round is one job whatever the number of models; a model whose centres stand still drops out, so the
number of jobs is that of the longest model.  Starts are k-means++ picks from a bounded sample.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortlens.operators.epsgraph import small_batches
from cohortlens.operators.tiles import matrix

SAMPLE = 4096       # rows that starts are picked from
TOL = 1e-4          # centres stand still when they move by less than this share of the mean variance
STEP = 4096         # rows whose distances are held at once
BLOCK = 1024        # rows of a packed block
SPREAD = 8192       # rows of a packed partition


def plus_plus(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ centres among the rows of ``x`` (rows repeat where there are fewer distinct ones)."""
    centres = [x[rng.integers(len(x))]]
    d2 = ((x - centres[0]) ** 2).sum(axis=1)
    for _ in range(k - 1):
        total = d2.sum()
        centres.append(x[rng.choice(len(x), p=d2 / total)] if total > 0 else x[rng.integers(len(x))])
        d2 = np.minimum(d2, ((x - centres[-1]) ** 2).sum(axis=1))
    return np.array(centres)


def starts(rows: DataFrame, ks: list[int], n_init: int, seed: int) -> list[np.ndarray]:
    """Starting centres of every model (``n_init`` for each k) from ``rows(x)``."""
    n = rows.count()
    some = rows if n <= SAMPLE else rows.sample(min(1.0, 1.2 * SAMPLE / n), seed=seed).limit(SAMPLE)
    t = some.select("x").toArrow()
    if not t.num_rows:
        return []
    col = t.column("x").combine_chunks()
    x = matrix(col, len(col[0]))
    x = x[np.lexsort(x.T[::-1])]
    return [plus_plus(x, k, np.random.default_rng([seed, k, i])) for k in ks for i in range(n_init)]


def pack(rows: DataFrame, width: int) -> DataFrame:
    """``x`` of ``rows(x)`` as binary blocks of rows, which every round reads; spread evenly, however few files hold the rows."""
    def run(batches):
        for b in batches:
            x = matrix(b.column("x"), width)
            yield pa.record_batch([pa.array([x[at:at + BLOCK].tobytes() for at in range(0, len(x), BLOCK)], pa.binary())], names=["x"])

    n, rows = rows.count(), rows.select("x")
    return (rows.repartition(-(-n // SPREAD)) if n > SPREAD else rows).mapInArrow(run, "x binary")


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances to all centres, and the nearest one (the first of equals)."""
    d2 = np.maximum(0, (x * x).sum(axis=1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(axis=1)[None, :])
    return d2, d2.argmin(axis=1)


def _sums(models, width: int):
    """Of a task's rows: ``c`` (centre over all models), ``j`` (dimension; -1 the count, -2 the cost) and the sum."""
    def run(batches):
        centres = models.value
        flat, cut = np.concatenate(centres), np.cumsum([0] + [len(c) for c in centres])
        acc = np.zeros((len(flat), width + 2))
        mid = flat.mean(axis=0)         # distances from the middle: less cancellation
        for b in batches:
            whole = matrix(b.column("x"), width)
            for at in range(0, len(whole), STEP):
                x = whole[at:at + STEP]
                d2 = nearest(x - mid, flat - mid)[0]
                own, r = np.zeros((len(x), len(flat))), np.arange(len(x))
                for s, e in zip(cut, cut[1:]):
                    best = s + d2[:, s:e].argmin(axis=1)
                    own[r, best] = 1
                    acc[:, 1] += np.bincount(best, weights=d2[r, best], minlength=len(flat))
                acc[:, 0] += own.sum(axis=0)
                acc[:, 2:] += own.T @ x         # the sums of all models as one product
        used = np.flatnonzero(acc[:, 0])
        yield pa.record_batch([pa.array(np.repeat(used, width + 2)), pa.array(np.tile(np.arange(-2, width), len(used))), pa.array(acc[used].reshape(-1))], names=["c", "j", "s"])
    return run


def step(rows: DataFrame, centres: list[np.ndarray], width: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Counts, costs (to the given centres) and coordinate sums of every model's centres after one shared scan."""
    models = rows.sparkSession.sparkContext.broadcast(centres)
    with small_batches(rows.sparkSession):
        got = (rows.select("x").mapInArrow(_sums(models, width), "c long, j long, s double").groupBy("c", "j").agg(F.sum("s").alias("s")).toArrow())
    acc = np.zeros((sum(len(c) for c in centres), width + 2))
    acc[got.column("c").to_numpy(), got.column("j").to_numpy() + 2] = got.column("s").to_numpy()
    out, at = [], 0
    for c in centres:
        part = acc[at:at + len(c)]
        out.append((part[:, 0], part[:, 1], part[:, 2:]))
        at += len(c)
    models.unpersist()
    return out


def moved(centres: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Means of what each centre attracts; a centre without rows stays."""
    return np.where(counts[:, None] > 0, sums / np.maximum(1, counts)[:, None], centres)


def lloyd(rows: DataFrame, models: list[np.ndarray], max_iter: int = 300, tol: float = TOL) -> tuple[list[np.ndarray], list[float]]:
    """Fitted centres and cost of every model over ``rows(x)``; a scan per round for all that still move."""
    width = models[0].shape[1]
    centres, cost = [m.copy() for m in models], [float("nan")] * len(models)
    open_, scale, last = list(range(len(models))), None, 0
    for it in range(max_iter + 1):
        got = step(rows, [centres[i] for i in open_], width)
        if scale is None:       # mean variance of the features, from the sums of any model
            counts, _, sums = got[0]
            n, mean = counts.sum(), sums.sum(axis=0) / counts.sum()
            spread = got[0][1].sum() + sum(c * ((m - mean) ** 2).sum() - 2 * ((s - c * m) @ (mean - m)) for c, m, s in zip(counts, centres[open_[0]], sums))
            scale = max(0.0, spread / n / width)
        still = []
        for i, (counts, costs, sums) in zip(open_, got):
            cost[i] = float(costs.sum())        # of the centres that were scanned
            after = moved(centres[i], counts, sums)
            if it < max_iter and ((after - centres[i]) ** 2).sum() > tol * scale:
                centres[i] = after
                still.append(i)
        open_ = still
        if not open_:
            break
    return centres, cost


def fixed_steps(rows: DataFrame, centres: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres after ``steps`` rounds from given ones, and the rows each attracted in the last round."""
    counts = np.zeros(len(centres))
    for _ in range(steps):
        ((counts, _, sums),) = step(rows, [centres], centres.shape[1])
        centres = moved(centres, counts, sums)
    return centres, counts


def indices(rows: DataFrame, models: list[np.ndarray]) -> list[dict]:
    """Squared silhouette, Davies-Bouldin and Calinski-Harabasz of every model's partition, from two shared scans.

    The first gives sizes, means and costs of all partitions; the second, per centre, the sum of distances to the
    own mean and of the silhouettes, whose mean squared distances follow from sizes, means and mean squares.
    """
    width = models[0].shape[1]
    first = step(rows, models, width)
    means = [moved(m, c, s) for m, (c, _, s) in zip(models, first)]
    # mean squared distance of a partition's rows to its own mean, per centre
    inner = [np.maximum(0, cost / np.maximum(1, c) - ((m - mu) ** 2).sum(axis=1)) for m, mu, (c, cost, _) in zip(models, means, first)]
    shared = rows.sparkSession.sparkContext.broadcast((models, means, inner, [c for c, _, _ in first]))

    def run(batches):
        ms, mus, inn, ns = shared.value
        dist, sil = [np.zeros(len(m)) for m in ms], [0.0] * len(ms)
        for b in batches:
            whole = matrix(b.column("x"), width)
            for at in range(0, len(whole), STEP):
                x = whole[at:at + STEP]
                for i, (m, mu, v, n) in enumerate(zip(ms, mus, inn, ns)):
                    own = nearest(x - m.mean(axis=0), m - m.mean(axis=0))[1]
                    d2 = nearest(x - mu.mean(axis=0), mu - mu.mean(axis=0))[0]
                    dist[i] += np.bincount(own, weights=np.sqrt(((x - mu[own]) ** 2).sum(axis=1)), minlength=len(m))
                    to = d2 + v[None, :]                        # mean squared distance to each cluster's rows
                    to[:, n == 0] = np.inf
                    r = np.arange(len(x))
                    size = n[own]
                    a = to[r, own] * size / np.maximum(1, size - 1)
                    to[r, own] = np.inf
                    near = to.min(axis=1)
                    top = np.maximum(a, near)
                    sil[i] += float(np.where((size <= 1) | (top == 0), 0.0, (near - a) / np.where(top == 0, 1.0, top))[np.isfinite(near)].sum())
        out = [(i, j, float(x)) for i, d in enumerate(dist) for j, x in enumerate(d)] + [(i, -1, s) for i, s in enumerate(sil)]
        yield pa.record_batch([pa.array([o[c] for o in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["i", "j", "s"])

    with small_batches(rows.sparkSession):
        got = rows.select("x").mapInArrow(run, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()    # a number per centre
    dist, sil = [np.zeros(len(m)) for m in models], [0.0] * len(models)
    for r in got:
        if r.j < 0:
            sil[r.i] = r.s
        else:
            dist[r.i][r.j] = r.s
    out = []
    for mu, v, d, s, (c, _, sums) in zip(means, inner, dist, sil, first):
        full = c > 0
        mu, v, d, c, n = mu[full], v[full], d[full], c[full], c.sum()
        k, w = len(c), float((v * c).sum())
        row = {"silhouette_sq": s / n if k > 1 else float("nan"), "davies_bouldin": None, "calinski_harabasz": None}
        if k > 1:
            gap = np.sqrt(((mu[:, None, :] - mu[None, :, :]) ** 2).sum(axis=-1))
            spread = d / c
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = (spread[:, None] + spread[None, :]) / gap
            np.fill_diagonal(ratio, -np.inf)
            row["davies_bouldin"] = float(ratio.max(axis=1).mean())
            between = float((c * ((mu - sums.sum(axis=0) / n) ** 2).sum(axis=1)).sum())
            row["calinski_harabasz"] = (between / (k - 1)) / (w / (n - k)) if n > k and w else None
        out.append(row)
    return out
