"""Neighbourhoods and spanning trees of points with many features, tile against tile.

A grid is of no use above a few features.  Here the data itself is split: a tree of median cuts, fitted on a
bounded sample, deals *all* points to at most ``LEAVES`` cells, whose exact bounding boxes then say of two
cells whether all their points are close, none is, or the points must be compared.  Cells of many points are cut
into tiles of about ``TILE`` points, and neighbouring tiles make stripes of bounded size.  A task gets two stripes,
once each, compares their tiles as matrices where the boxes do not decide, and returns a few numbers for each
of *its points* (a count, a link, the nearest other point, the k nearest distances).  So a pass over all pairs moves every
point once per stripe, not once per tile; a table of all close pairs never exists, and a dense spot is decided by weights, cell by cell.

Distances are first taken as matrix products; those of doubtful pairs, which rounding could turn, are summed anew
feature by feature, in the order of the features, so results equal a plain ``sqrt(sum of squares) <= eps`` whatever the tiles are.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cohortlens.operators.components import star_components
from cohortlens.operators.tiles import TILE, matrix
from cohortlens.session import Scratch

LEAVES = 4096           # cells at most
BOX = 1 << 20           # numbers in all cells' boxes at most (two of 8 bytes each are broadcast)
SAMPLE = 16_384         # points that the cuts are fitted on
STEP = 512              # rows of a tile compared at once
TILE_GROUP = 64         # tiles of a stripe at most
STRIPE = 64 << 20       # bytes of the features of a stripe at most, but one tile at least
STRIPES = 8             # stripes that smaller data is cut into, so that tasks share the work
NONE = np.iinfo(np.int64).max


# ------------------------------------------------------------------ distances of two blocks
def _exact(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Squared (Euclidean) or plain (Manhattan) distances of paired rows, summed in the order of the features."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        d = a[:, j] - b[:, j]
        out += d * d if metric == "euclidean" else np.abs(d)
    return out


def _rough(a: np.ndarray, b: np.ndarray, metric: str):
    """``(first row, distances, how far they may be off)`` as in :func:`_exact` of all rows of two blocks, ``STEP`` rows of ``a`` at a time."""
    top = np.inf
    if metric == "euclidean":
        mid = b.mean(axis=0)
        x, y = a - mid, b - mid
        aa, bb = (x * x).sum(axis=1), (y * y).sum(axis=1)
        top = float(aa.max() + bb.max())
    if not top < 1e300:         # no product: Manhattan, or squares that overflow
        for s in range(0, len(a), STEP):
            part = a[s:s + STEP]
            out = np.zeros((len(part), len(b)))
            for j in range(a.shape[1]):
                d = part[:, j, None] - b[None, :, j]
                out += d * d if metric == "euclidean" else np.abs(d)
            yield s, out, 0.0
        return
    unit = 4e-15
    if 1e-20 < top < 1e30:      # single precision is enough to tell the doubtful pairs
        x, y, aa, bb, unit = x.astype(np.float32), y.astype(np.float32), aa.astype(np.float32), bb.astype(np.float32), 2.4e-7
    off = unit * (a.shape[1] + 8) * top
    for s in range(0, len(a), STEP):
        d = x[s:s + STEP] @ y.T
        d *= -2
        d += aa[s:s + STEP, None]
        d += bb[None]
        yield s, d, off


def _up(bound: np.ndarray, d: np.ndarray) -> np.ndarray:
    """``bound`` in the precision of ``d``, not below it."""
    return bound if d.dtype == bound.dtype else np.nextafter(bound.astype(d.dtype), d.dtype.type(np.inf))


def close(a: np.ndarray, b: np.ndarray, eps: float, metric: str):
    """``(first row, mask)`` of the pairs within ``eps``, ``STEP`` rows of ``a`` at a time."""
    limit = eps * eps if metric == "euclidean" else eps
    for s, d, off in _rough(a, b, metric):
        off += 1e-12 * limit + (1e-6 * limit if d.dtype == np.float32 else 0)
        mask = d <= d.dtype.type(limit - off)
        i, j = np.nonzero(mask ^ (d <= d.dtype.type(limit + off)))
        for at in range(0, len(i), 65_536):
            p, q = i[at:at + 65_536], j[at:at + 65_536]
            e = _exact(a[s + p], b[q], metric)
            mask[p, q] = (np.sqrt(e) if metric == "euclidean" else e) <= eps
        yield s, mask


# ------------------------------------------------------------------ the split
@dataclass
class Split:
    """Points dealt to cells and tiles: ``points(leaf, tile, loc, w)``, ``tiles(tile, loc, w, x)`` as blocks, the cells' boxes."""
    points: DataFrame
    tiles: DataFrame
    leaves: np.ndarray      # names of the cells that hold points
    lo: np.ndarray
    hi: np.ndarray
    base: np.ndarray        # of every cell the number of its first tile; at last the number of all tiles
    stripes: int
    per: int                # tiles of a stripe
    width: int
    metric: str

    def __post_init__(self):
        self.boxes = self.tiles.sparkSession.sparkContext.broadcast((self.lo, self.hi, self.base))


def _cuts(x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature and cut of every inner node of a complete tree: the widest feature at its median."""
    axis, cut = np.zeros((1 << depth) - 1, dtype=np.int64), np.zeros((1 << depth) - 1)
    parts = {0: x}
    for node in range(len(axis)):
        p = parts.pop(node)
        if len(p) > 1:
            axis[node] = int(np.ptp(p, axis=0).argmax())
            cut[node] = np.median(p[:, axis[node]])
        right = p[:, axis[node]] > cut[node]
        parts[2 * node + 1], parts[2 * node + 2] = p[~right], p[right]
    return axis, cut


def split(locations: DataFrame, scratch: Scratch, metric: str, tile: int = TILE) -> Split | None:
    """Deal ``locations(loc, w, x)`` (finite features) to cells; None without any."""
    spark = locations.sparkSession
    r = locations.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).first()
    if not r.n:
        return None
    n, width = r.n, r.d
    some = locations.select("x") if n <= SAMPLE else locations.select("x").sample(min(1.0, 1.2 * SAMPLE / n), seed=1).limit(SAMPLE)
    table = some.toArrow()
    seen = matrix(table.column("x"), width) if table.num_rows else np.zeros((0, width))
    depth = max(1, min(LEAVES, BOX // width, -(-n // tile))).bit_length() - 1
    tree = spark.sparkContext.broadcast(_cuts(seen, depth))

    def deal(batches):
        axis, cut = tree.value
        for b in batches:
            if b.num_rows:
                x, node = matrix(b.column("x"), width), np.zeros(b.num_rows, dtype=np.int64)
                for _ in range(depth):
                    node = 2 * node + 1 + (x[np.arange(len(x)), axis[node]] > cut[node])
                yield pa.record_batch([pa.array((node - len(axis)).astype(np.int32)), *[b.column(c) for c in ("loc", "w", "x")]], names=["leaf", "loc", "w", "x"])

    def boxes(batches):
        lo, hi = {}, {}
        for b in batches:
            if b.num_rows:
                x, leaf = matrix(b.column("x"), width), b.column("leaf").to_numpy()
                order = np.argsort(leaf, kind="stable")
                names, first = np.unique(leaf[order], return_index=True)
                for k, least, most in zip(names.tolist(), np.minimum.reduceat(x[order], first), np.maximum.reduceat(x[order], first)):
                    lo[k], hi[k] = np.minimum(lo.get(k, least), least), np.maximum(hi.get(k, most), most)
        for k in lo:
            yield pa.record_batch([pa.array(np.full(width, k, dtype=np.int32)), pa.array(np.arange(width, dtype=np.int32)), pa.array(lo[k]), pa.array(hi[k])],
                                  names=["leaf", "axis", "lo", "hi"])

    dealt = scratch.keep(locations.select("loc", "w", "x").mapInArrow(deal, "leaf int, loc long, w long, x array<double>"))
    sides = (dealt.select("leaf", "x").mapInArrow(boxes, "leaf int, axis int, lo double, hi double")
                  .groupBy("leaf", "axis").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("leaf", "axis").toArrow())     # BOX rows at most
    lo, hi = (sides.column(c).to_numpy().reshape(-1, width) for c in ("lo", "hi"))
    about = dealt.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("int").alias("chunks"))
    about = sorted(map(tuple, about.collect()))                                             # LEAVES rows at most
    base = np.cumsum([0, *[c for _, c in about]])
    total = int(base[-1])
    per = max(1, min(TILE_GROUP, STRIPE // (tile * width * 8)))
    per = -(-total // max(-(-total // per), min(total, STRIPES)))
    first = spark.createDataFrame([(leaf, c, int(b)) for (leaf, c), b in zip(about, base)], "leaf int, chunks int, base int")
    points = dealt.join(F.broadcast(first), "leaf").withColumn("tile", F.col("base") + F.pmod(F.xxhash64("loc"), F.col("chunks")).cast("int"))
    tiles = scratch.keep(blobs(points, width))
    return Split(points.select("leaf", "tile", "loc", "w"), tiles, np.array([leaf for leaf, _ in about]), lo, hi, base, -(-total // per), per, width, metric)


def _spans(gap: np.ndarray, metric: str) -> np.ndarray:
    return np.sqrt((gap * gap).sum(axis=-1)) if metric == "euclidean" else gap.sum(axis=-1)


def _gaps(lo, hi, i, j, metric: str) -> np.ndarray:
    """No two points of the boxes ``i`` and ``j`` are closer."""
    return _spans(np.maximum(0, np.maximum(lo[j] - hi[i], lo[i] - hi[j])), metric) * (1 - 1e-9)


def _inside(lo, hi, i, j, eps: float, metric: str) -> np.ndarray:
    """All points of the boxes ``i`` and ``j`` are within ``eps``."""
    return _spans(np.maximum(hi[j] - lo[i], hi[i] - lo[j]), metric) * (1 + 1e-9) < eps


def leaf_pairs(s: Split, reach: np.ndarray, eps: float | None = None, idle: np.ndarray | None = None) -> DataFrame:
    """``a, b, inside`` with ``a <= b`` of the cells whose boxes are no further apart than the larger of their ``reach``.

    ``inside`` tells that all points of both are within ``eps``.  Cells with the same number in ``idle`` (0 or more) are left out.
    Made in tasks from the broadcast boxes.
    """
    spark = s.points.sparkSession
    shared = spark.sparkContext.broadcast((s.leaves, s.lo, s.hi, reach, idle))
    metric = s.metric

    def run(batches):
        leaf, lo, hi, reach, idle = shared.value
        for batch in batches:
            out = []
            for i in batch.column("id").to_pylist():
                j = np.arange(i, len(leaf))
                near = _gaps(lo, hi, i, j, metric) <= np.maximum(reach[i], reach[j])
                if idle is not None:
                    near &= (idle[i] < 0) | (idle[j] != idle[i])
                inside = np.zeros(len(j), dtype=bool) if eps is None else _inside(lo, hi, i, j, eps, metric)
                out += [(int(leaf[i]), int(leaf[i + k]), bool(inside[k])) for k in np.flatnonzero(near).tolist()]
            yield pa.record_batch([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.bool_()))], names=["a", "b", "inside"])

    return spark.range(len(s.leaves), numPartitions=max(1, min(64, len(s.leaves) // 16))).mapInArrow(run, "a int, b int, inside boolean")


def _ints(column) -> np.ndarray:
    return column.fill_null(np.iinfo(np.int64).min).to_numpy().astype(np.int64)


def blobs(points: DataFrame, width: int) -> DataFrame:
    """One row per tile: ``tile, loc, w, x`` as binary blocks, by ascending ``loc``."""
    def run(key, table):
        loc = _ints(table.column("loc"))
        order = np.argsort(loc, kind="stable")
        cells = [loc[order], _ints(table.column("w"))[order], matrix(table.column("x"), width)[order]]
        return pa.table([pa.array([key[0].as_py()], pa.int32()), *[pa.array([c.tobytes()], pa.binary()) for c in cells]], names=["tile", "loc", "w", "x"])

    return points.select("tile", "loc", "w", "x").groupBy("tile").applyInArrow(run, "tile int, loc binary, w binary, x binary")


def value_blobs(values: DataFrame) -> DataFrame:
    """Of ``values(tile, loc, v, b)`` one row per tile: ``tile, loc, v, b`` as binary blocks, by ascending ``loc``."""
    def run(key, table):
        loc = _ints(table.column("loc"))
        order = np.argsort(loc, kind="stable")
        cells = [loc[order], _ints(table.column("v"))[order], table.column("b").to_numpy().astype(float)[order]]
        return pa.table([pa.array([key[0].as_py()], pa.int32()), *[pa.array([c.tobytes()], pa.binary()) for c in cells]], names=["tile", "loc", "v", "b"])

    return values.select("tile", "loc", "v", "b").groupBy("tile").applyInArrow(run, "tile int, loc binary, v binary, b binary")


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.union(pairs.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), *pairs.columns[2:]))


def stripe_pairs(s: Split, pairs: DataFrame) -> list[tuple[int, int]]:
    """The pairs ``p <= q`` of stripes that hold tiles of the cells in ``pairs(a, b)``."""
    rows = [(int(leaf), int(b) // s.per, (int(e) - 1) // s.per) for leaf, b, e in zip(s.leaves, s.base, s.base[1:])]
    at = F.broadcast(s.tiles.sparkSession.createDataFrame(rows, "leaf int, s0 int, s1 int"))
    both = (pairs.select("a", "b").join(at.toDF("a", "a0", "a1"), "a").join(at.toDF("b", "b0", "b1"), "b").select("a0", "a1", "b0", "b1").distinct()
                 .withColumn("p", F.explode(F.sequence("a0", "a1"))).withColumn("q", F.explode(F.sequence("b0", "b1"))))
    return sorted(map(tuple, both.select(F.least("p", "q"), F.greatest("p", "q")).distinct().collect()))       # stripes, not points


class Tile:
    """One tile in a task: its points, and the values of those that have one (others are left out)."""

    def __init__(self, number: int, leaf: int, loc, w, x, v=None, b=None):
        self.number, self.leaf, self.loc, self.w, self.x, self.v, self.b = number, leaf, loc, w, x, v, b


def _read(table: pa.Table, base: np.ndarray, width: int, valued: bool) -> list[Tile]:
    xs, vs = {}, {}
    cells = {c: table.column(c) for c in ("tile", "loc", "w", "x", *("vb" if valued else ""))}

    def of(c, i, kind):
        return np.frombuffer(cells[c][i].as_buffer(), dtype=kind)

    for i in range(table.num_rows):
        at = cells["tile"][i].as_py()
        if cells["x"][i].is_valid:
            xs[at] = of("loc", i, np.int64), of("w", i, np.int64), of("x", i, np.float64).reshape(-1, width)
        else:
            vs[at] = of("loc", i, np.int64), of("v", i, np.int64), of("b", i, np.float64)
    out = []
    for at in sorted(xs):
        leaf, (loc, w, x) = int(np.searchsorted(base, at, side="right")) - 1, xs[at]
        if not valued:
            out.append(Tile(at, leaf, loc, w, x))
        elif at in vs:
            known, v, b = vs[at]
            k = np.minimum(np.searchsorted(known, loc), len(known) - 1)
            has = known[k] == loc
            out.append(Tile(at, leaf, loc[has], w[has], x[has], v[k[has]], b[k[has]]))
    return out


@contextmanager
def small_batches(spark):
    """A few rows per Arrow batch while a plan whose rows hold tiles is run."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, "8")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def meet(s: Split, scratch: Scratch, groups: list[tuple[int, int]], work, schema: pa.Schema, ddl: str, values: DataFrame | None = None) -> DataFrame:
    """Rows of ``work(tiles, pairs)`` for each two stripes of ``groups``, stored.

    ``pairs`` are index pairs of the tiles that meet there: each pair of tiles meets once, a tile also itself.
    """
    spark, n, per, width, boxes, valued = scratch.spark, s.stripes, s.per, s.width, s.boxes, values is not None
    if not groups:
        return spark.createDataFrame([], ddl)
    seats = sorted({(x, p * n + q) for p, q in groups for x in (p, q)})
    rows = s.tiles.unionByName(values, allowMissingColumns=True) if valued else s.tiles
    sent = (rows.withColumn("stripe", F.floor(F.col("tile") / per).cast("int")).join(F.broadcast(spark.createDataFrame(seats, "stripe int, g long")), "stripe")
                .drop("stripe").repartition(min(4 * len(groups), max(len(groups), 400)), "g"))

    def run(key, table):
        p, q = divmod(key[0].as_py(), n)
        tiles = _read(table, boxes.value[2], width, valued)
        side = [t.number // per for t in tiles]
        left, right = [i for i, x in enumerate(side) if x == p], [i for i, x in enumerate(side) if x == q]
        out = work(tiles, [(i, j) for i in left for j in right if p < q or i <= j])
        return pa.table(list(out), schema=schema)

    with small_batches(spark):
        return scratch.keep(sent.groupBy("g").applyInArrow(run, ddl))


def _near(s: Split, eps: float):
    """The pairs of tiles that must be compared: within reach, not wholly inside."""
    boxes, metric = s.boxes, s.metric

    def pick(tiles, pairs):
        lo, hi, _ = boxes.value
        seen = {}
        for i, j in pairs:
            at = tiles[i].leaf, tiles[j].leaf
            if at not in seen:
                a, b = np.array([min(at)]), np.array([max(at)])
                seen[at] = bool(_gaps(lo, hi, a, b, metric)[0] <= eps) and not _inside(lo, hi, a, b, eps, metric)[0]
            if seen[at]:
                yield tiles[i], tiles[j]
    return pick


_OUT, _OUT_DDL = pa.schema([("loc", pa.int64()), ("value", pa.int64())]), "loc long, value long"


def _weight(mask: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.count_nonzero(mask, axis=1) if (w == 1).all() else (mask.astype(float) @ w.astype(float)).astype(np.int64)


def join_all(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Join the components of ``u`` and ``v``, pairwise; ``root`` names every node's component by one of its nodes."""
    while True:
        a, b = root[u], root[v]
        differ = a != b
        if not differ.any():
            return
        u, v = u[differ], v[differ]
        np.minimum.at(root, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
        while True:
            after = root[root]
            if (after == root).all():
                break
            root[:] = after


# ------------------------------------------------------------------ DBSCAN
class EpsGraph:
    """The graph of points within ``eps``, asked by passes over pairs of stripes."""

    def __init__(self, locations: DataFrame, eps: float, metric: str, scratch: Scratch, tile: int = TILE):
        self.scratch, self.eps, self.metric = scratch, eps, metric
        self.s = split(locations, scratch, metric, tile)
        if self.s:
            self.pairs = scratch.keep(leaf_pairs(self.s, np.full(len(self.s.leaves), eps), eps))
            self.whole = self.pairs.where("inside").select("a", "b")
            self.part = self.pairs.where("not inside").select("a", "b")
            self.groups = stripe_pairs(self.s, self.part)

    def counts(self) -> DataFrame:
        """``loc, n``: weight of the points within eps, its own included."""
        s, eps, metric, near = self.s, self.eps, self.metric, _near(self.s, self.eps)
        heavy = s.points.groupBy("leaf").agg(F.sum("w").alias("w"))
        sure = (_both_ways(self.whole).join(heavy.withColumnRenamed("leaf", "b"), "b").groupBy("a").agg(F.sum("w").alias("value"))
                    .select(F.col("a").alias("leaf"), "value"))                                     # one row per cell
        sure = s.points.join(F.broadcast(sure), "leaf").select("loc", "value")

        def work(tiles, pairs):
            n = {t.number: np.zeros(len(t.loc), dtype=np.int64) for t in tiles}
            for a, b in near(tiles, pairs):
                for at, mask in close(a.x, b.x, eps, metric):
                    n[a.number][at:at + len(mask)] += _weight(mask, b.w)
                    if a is not b:
                        n[b.number] += _weight(mask.T, a.w[at:at + len(mask)])
            loc, n = (np.concatenate(x) if tiles else np.zeros(0, dtype=np.int64) for x in ([t.loc for t in tiles], [n[t.number] for t in tiles]))
            return loc[n > 0], n[n > 0]

        found = meet(s, self.scratch, self.groups, work, _OUT, _OUT_DDL)
        out = found.union(sure).groupBy("loc").agg(F.sum("value").alias("n"))
        return self.scratch.keep(out)

    def links(self, core: DataFrame) -> DataFrame:
        """``u, v``: links between ``core(loc)`` points that join all that are connected."""
        s, eps, metric, near = self.s, self.eps, self.metric, _near(self.s, self.eps)
        points = self.scratch.keep(s.points.join(core, "loc", "left_semi").select(*s.points.columns))
        rep = points.groupBy("leaf").agg(F.min("loc").alias("rep"))                                 # one row per cell
        # cells wholly within reach: their first points with one another, every point with one cell's first
        firsts = (self.whole.join(rep.select(F.col("leaf").alias("a"), F.col("rep").alias("u")), "a")
                            .join(rep.select(F.col("leaf").alias("b"), F.col("rep").alias("v")), "b"))
        target = (_both_ways(self.whole).join(rep.withColumnRenamed("leaf", "b"), "b").groupBy("a").agg(F.min("rep").alias("v"))
                      .select(F.col("a").alias("leaf"), "v"))
        sure = firsts.select("u", "v").union(points.join(F.broadcast(target), "leaf").select(F.col("loc").alias("u"), "v"))

        def work(tiles, pairs):
            start = dict(zip((t.number for t in tiles), np.cumsum([0, *[len(t.loc) for t in tiles]])))
            loc = np.concatenate([t.loc for t in tiles]) if tiles else np.zeros(0, dtype=np.int64)
            root = np.arange(len(loc))
            for a, b in near(tiles, pairs):
                for at, mask in close(a.x, b.x, eps, metric):
                    i, j = np.nonzero(mask)
                    join_all(root, start[a.number] + at + i, start[b.number] + j)
            least = np.full(len(loc), NONE)
            np.minimum.at(least, root, loc)
            keep = loc != least[root]
            return loc[keep], least[root][keep]

        values = value_blobs(points.select("tile", "loc", F.lit(0).cast("long").alias("v"), F.lit(0.0).alias("b")))
        found = meet(s, self.scratch, self.groups, work, _OUT, _OUT_DDL, values)
        return found.select(F.col("loc").alias("u"), F.col("value").alias("v")).union(sure)

    def border(self, labels: DataFrame) -> DataFrame:
        """``loc, label``: the smallest label within eps, for points that have none in ``labels(loc, label)``."""
        s, eps, metric, near = self.s, self.eps, self.metric, _near(self.s, self.eps)
        every = self.scratch.keep(s.points.join(labels, "loc", "left").select(*s.points.columns, "label"))
        known, rest = every.where("label is not null"), every.where("label is null")
        least = known.groupBy("leaf").agg(F.min("label").alias("label"))                            # one row per cell
        sure = (_both_ways(self.whole).join(least.withColumnRenamed("leaf", "b"), "b").groupBy("a").agg(F.min("label").alias("value"))
                    .select(F.col("a").alias("leaf"), "value"))
        sure = rest.join(F.broadcast(sure), "leaf").select("loc", "value")

        def work(tiles, pairs):
            out = {t.number: np.full(len(t.loc), NONE) for t in tiles}

            def look(a, b):         # points of a without a label, points of b with one
                i, j = np.flatnonzero(a.b > 0), np.flatnonzero(b.b == 0)
                if len(i) and len(j):
                    for at, mask in close(a.x[i], b.x[j], eps, metric):
                        p, q = np.nonzero(mask)
                        np.minimum.at(out[a.number], i[at + p], b.v[j[q]])

            for a, b in near(tiles, pairs):
                look(a, b)
                if a is not b:
                    look(b, a)
            loc, value = (np.concatenate(x) if tiles else np.zeros(0, dtype=np.int64) for x in ([t.loc for t in tiles], [out[t.number] for t in tiles]))
            return loc[value < NONE], value[value < NONE]

        values = value_blobs(every.select("tile", "loc", F.coalesce("label", F.lit(0)).cast("long").alias("v"), F.col("label").isNull().cast("double").alias("b")))
        found = meet(s, self.scratch, self.groups if not rest.isEmpty() else [], work, _OUT, _OUT_DDL, values)
        return found.union(sure).groupBy("loc").agg(F.min("value").alias("label"))


# ------------------------------------------------------------------ k nearest
_KNN, _KNN_DDL = pa.schema([("loc", pa.int64()), ("d", pa.float64()), ("w", pa.int64())]), "loc long, d double, w long"


def _hits(d: np.ndarray, off: float, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows of ``d`` the columns that may be among the ``k`` least, where ``bound`` holds the k-th so far."""
    if np.isinf(bound).any() and d.shape[1] > k:
        bound = np.minimum(bound, np.partition(d, k - 1, axis=1)[:, k - 1].astype(float) + off)
    return np.nonzero(d <= _up(bound + off, d)[:, None])


def _keep_least(best: np.ndarray, weight: np.ndarray, rows: np.ndarray, d: np.ndarray, w: np.ndarray) -> None:
    """Enter distances into the ``k`` least of their rows."""
    if not len(rows):
        return
    k, at = best.shape[1], np.unique(rows)
    r, d, w = np.concatenate([np.repeat(at, k), rows]), np.concatenate([best[at].reshape(-1), d]), np.concatenate([weight[at].reshape(-1), w])
    order = np.lexsort((d, r))
    r, d, w = r[order], d[order], w[order]
    keep = np.arange(len(r)) - np.searchsorted(r, r) < k
    best[at], weight[at] = d[keep].reshape(-1, k), w[keep].reshape(-1, k)


def kth_distances(locations: DataFrame, k: int, scratch: Scratch, metric: str = "euclidean", tile: int = TILE) -> DataFrame:
    """``loc, knn_distance``: distance within which ``k`` rows of ``locations(loc, w, x)`` lie, its own included; locations without are left out.

    A task returns the k nearest of each of its points in two stripes; they are merged by point.
    """
    s = split(locations, scratch, metric, tile)
    if s is None:
        return locations.sparkSession.createDataFrame([], "loc long, knn_distance double")
    boxes = s.boxes

    def work(tiles, pairs):
        lo, hi, _ = boxes.value
        best = [np.full((len(t.loc), k), np.inf) for t in tiles]
        weight = [np.zeros((len(t.loc), k), dtype=np.int64) for t in tiles]
        i, j = np.array(pairs, dtype=np.int64).reshape(-1, 2).T
        leaf = np.array([t.leaf for t in tiles], dtype=np.int64)
        gap = _gaps(lo, hi, leaf[i], leaf[j], metric) if len(i) else np.zeros(0)
        for at in np.lexsort((i != j, gap)).tolist():
            p, q = int(i[at]), int(j[at])
            a, b, far = tiles[p], tiles[q], gap[at] ** 2 if metric == "euclidean" else gap[at]
            if far * (1 - 1e-9) > max(best[p][:, -1].max(), best[q][:, -1].max()):
                continue
            for r, d, off in _rough(a.x, b.x, metric):
                for x, y, z, o, e in ((p, a, b, r, d), (q, b, a, 0, d.T))[:1 if p == q else 2]:
                    u, v = _hits(e, off, best[x][o:o + len(e), -1], k)
                    u, v = (u + o, v) if x == p and e is d else (u, v + r)
                    _keep_least(best[x], weight[x], u, _exact(y.x[u], z.x[v], metric), z.w[v])
        n = [np.isfinite(b) for b in best]
        if not tiles:
            return [], [], []
        d = np.concatenate([b[m] for b, m in zip(best, n)])
        return (np.concatenate([np.repeat(t.loc, m.sum(axis=1)) for t, m in zip(tiles, n)]), np.sqrt(d) if metric == "euclidean" else d,
                np.concatenate([w[m] for w, m in zip(weight, n)]))

    groups = [(p, q) for p in range(s.stripes) for q in range(p, s.stripes)]
    found = meet(s, scratch, groups, work, _KNN, _KNN_DDL)
    upto = Window.partitionBy("loc").orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return found.withColumn("n", F.sum("w").over(upto)).where(F.col("n") >= k).groupBy("loc").agg(F.min("d").alias("knn_distance"))


# ------------------------------------------------------------------ single linkage
_EDGE_DDL = "comp long, d double, lo long, hi long, other long"
_EDGE = pa.schema([(c, pa.float64() if c == "d" else pa.int64()) for c in ("comp", "d", "lo", "hi", "other")])


def _first_of(group: np.ndarray, d, lo, hi) -> np.ndarray:
    """Of every group the row that comes first by (distance, smaller end, larger end)."""
    order = np.lexsort((hi, lo, d, group))
    return order[np.unique(group[order], return_index=True)[1]]


def _nearest_outside(s: Split):
    """``work`` for :func:`meet`: the nearest outside point of every component of two stripes.

    ``v`` is a point's component, ``b`` a bound on its component's least edge (minus infinity: none is looked for).
    """
    metric, boxes = s.metric, s.boxes

    def work(tiles, pairs):
        lo, hi, _ = boxes.value
        if not tiles:
            return [[]] * 5
        names, index = np.unique(np.concatenate([t.v for t in tiles]), return_inverse=True)
        bound = np.full(len(names), np.inf)
        np.minimum.at(bound, index, np.concatenate([t.b for t in tiles]))
        best = {"d": np.full(len(names), np.inf), **{c: np.full(len(names), NONE) for c in ("lo", "hi", "other")}}
        comps = []
        for t, c in zip(tiles, np.split(index, np.cumsum([len(t.loc) for t in tiles])[:-1])):
            order = np.argsort(np.isneginf(bound[c]), kind="stable")        # those that look for nothing come last
            t.loc, t.x, c = t.loc[order], t.x[order], c[order]
            comps.append((c, int((~np.isneginf(bound[c])).sum()), len(np.unique(c)) == 1))
        i, j = np.array(pairs, dtype=np.int64).reshape(-1, 2).T
        leaf = np.array([t.leaf for t in tiles], dtype=np.int64)
        gap = _gaps(lo, hi, leaf[i], leaf[j], metric) if len(i) else np.zeros(0)

        def enter(c, d, lo_, hi_, other):
            f = _first_of(c, d, lo_, hi_)
            c, d, lo_, hi_, other = c[f], d[f], lo_[f], hi_[f], other[f]
            old = [best[x][c] for x in ("d", "lo", "hi")]
            less = (d < old[0]) | ((d == old[0]) & ((lo_ < old[1]) | ((lo_ == old[1]) & (hi_ < old[2]))))
            for x, y in zip(("d", "lo", "hi", "other"), (d, lo_, hi_, other)):
                best[x][c[less]] = y[less]
            np.minimum.at(bound, c, d)

        def compare(a, ca, b, cb):
            (loc_a, xa), (loc_b, xb) = a, b
            for r, d, off in _rough(xa, xb, metric):
                c = ca[r:r + len(d)]
                ra, rb = bound[c], bound[cb]
                if np.isposinf(ra).any() or np.isposinf(rb).any():
                    d = np.where(c[:, None] == cb[None], d.dtype.type(np.inf), d)
                    now = bound.copy()
                    np.minimum.at(now, c, d.min(axis=1).astype(float) + off)
                    np.minimum.at(now, cb, d.min(axis=0).astype(float) + off)
                    ra, rb = now[c], now[cb]
                hit = d <= _up(ra + off, d)[:, None]
                hit |= d <= _up(rb + off, d)[None]
                if np.count_nonzero(hit) > hit.size // 50:
                    hit &= c[:, None] != cb[None]
                p, q = np.nonzero(hit)
                p, q = (x[c[p] != cb[q]] for x in (p, q))
                for at in range(0, len(p), 65_536):
                    u, v = p[at:at + 65_536], q[at:at + 65_536]
                    e = _exact(xa[r + u], xb[v], metric)
                    ok = e < np.inf
                    u, v, e = u[ok], v[ok], e[ok]
                    ends = loc_a[r + u], loc_b[v]
                    le, ge, cu, cv = np.minimum(*ends), np.maximum(*ends), c[u], cb[v]
                    x, y = e <= bound[cu], e <= bound[cv]
                    if x.any() or y.any():
                        enter(*(np.concatenate([m[x], n[y]]) for m, n in ((cu, cv), (e, e), (le, le), (ge, ge), (cv, cu))))

        for at in np.lexsort((i != j, gap)).tolist():
            p, q = int(i[at]), int(j[at])
            (ca, na, one_a), (cb, nb, one_b) = comps[p], comps[q]
            far = gap[at] ** 2 if metric == "euclidean" else gap[at]
            if not na + nb or (one_a and one_b and ca[0] == cb[0]) or far * (1 - 1e-9) > max(bound[ca].max(), bound[cb].max()):
                continue
            a, b = tiles[p], tiles[q]
            if na:
                compare((a.loc[:na], a.x[:na]), ca[:na], (b.loc, b.x), cb)
            if nb and na < len(ca):
                compare((a.loc[na:], a.x[na:]), ca[na:], (b.loc[:nb], b.x[:nb]), cb[:nb])
        ok = np.flatnonzero(best["d"] < np.inf)
        return names[ok], best["d"][ok], best["lo"][ok], best["hi"][ok], names[best["other"][ok]]

    return work


def _least_edges(found: DataFrame) -> DataFrame:
    return found.groupBy("comp").agg(F.min(F.struct("d", "lo", "hi", "other")).alias("e")).select("comp", "e.*")


def spanning_tree(locations: DataFrame, scratch: Scratch, metric: str = "euclidean", tile: int = TILE) -> DataFrame | None:
    """``lo, hi, d``: the minimum spanning tree of ``locations(loc, w, x)``, equal distances by the ends; None without points.

    Boruvka rounds: every component but the largest looks for its nearest point outside, all these edges belong to the tree, and
    the components they join become one, so at most about half are left.  In a round a stripe first meets itself, which gives
    an upper bound for each of its components; then only stripes with cells that lie within the bound are
    compared, and in them no tiles that hold the same single component, and no two points of the largest one.
    """
    s = split(locations, scratch, metric, tile)
    if s is None:
        return None
    spark, work = locations.sparkSession, _nearest_outside(s)
    leaf_of = np.searchsorted(s.base, np.arange(s.base[-1]), side="right") - 1
    comps = scratch.keep(s.points.select("tile", "loc", F.col("loc").alias("comp")))
    tree, left, infinite = None, locations.count(), F.lit(float("inf"))
    while left > 1:
        giant = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "comp").first()["comp"]
        rest = F.col("comp").eqNullSafe(F.lit(giant))
        start = comps.select("tile", "loc", F.col("comp").alias("v"), F.when(rest, -infinite).otherwise(infinite).alias("b"))
        inner = scratch.keep(_least_edges(meet(s, scratch, [(p, p) for p in range(s.stripes)], work, _EDGE, _EDGE_DDL, value_blobs(start))))
        known = scratch.keep(comps.join(inner.select("comp", "d"), "comp", "left")
                                  .select("tile", "loc", F.col("comp").alias("v"), F.when(rest, -infinite).otherwise(F.coalesce("d", infinite)).alias("b")))
        # per tile: the widest bound of its components, and its component if it holds only one
        reach, only = np.zeros(len(s.leaves)), np.full(len(s.leaves), -1, dtype=np.int64)
        seen: dict[int, int] = {}
        single: dict[int, set] = {}
        for r in known.groupBy("tile").agg(F.max("b").alias("b"), F.min("v").alias("least"), F.max("v").alias("most")).collect():
            at = int(leaf_of[r.tile])
            reach[at] = max(reach[at], 0.0 if r.b < 0 else float(np.sqrt(r.b)) if metric == "euclidean" else r.b)
            single.setdefault(at, set()).update((r.least, r.most))
        for at, names in single.items():
            if len(names) == 1:
                only[at] = seen.setdefault(names.pop(), len(seen))
        groups = [g for g in stripe_pairs(s, leaf_pairs(s, reach * (1 + 1e-9), None, only)) if g[0] < g[1]]
        outer = meet(s, scratch, groups, work, _EDGE, _EDGE_DDL, value_blobs(known))
        edges = scratch.keep(_least_edges(inner.union(outer)))
        step = edges.select("lo", "hi", "d").distinct()
        tree = step if tree is None else tree.union(step)
        joined = star_components(edges.select(F.col("comp").alias("u"), F.col("other").alias("v")), scratch)
        after = scratch.keep(comps.join(joined.withColumnRenamed("node", "comp"), "comp", "left").select("tile", "loc", F.coalesce("label", "comp").alias("comp")))
        scratch.drop(comps, known)
        comps = after
        now = comps.select("comp").distinct().count()
        if now == left:         # what is left cannot be reached (distances overflow)
            break
        left = now
        scratch.sweep()
    if tree is None:
        return spark.createDataFrame([], "lo long, hi long, d double")
    return tree.select("lo", "hi", (F.sqrt("d") if metric == "euclidean" else F.col("d")).alias("d"))
