r"""Near-duplicate vectors by PCA-ordered tiled comparison.

Two vectors link when their cosine, in double precision, is ``threshold`` or more.

1. Equal vectors collapse into one with a weight, so a group of copies costs one row.
2. The second moments of all unit vectors give an orthonormal basis in descending order of
   energy (PCA without centring: a rotation, which keeps every inner product).
3. A k-d tree over the leading axes, fitted on a bounded sample (``SAMPLE`` vectors), deals *all*
   vectors to at most ``LEAVES`` leaves, and large leaves to chunks by hash; a tile is one
   chunk of about ``TILE`` vectors.  Exact bounding boxes of the leaves decide pairs of leaves: too far for
   any link (left out), near enough that all link (one link and a weight, no comparison), or to be compared.
4. Tiles are compared block by block: the products of the leading axes first, plus the product of the
   norms of what is left (Cauchy-Schwarz) as a bound; only pairs whose bound still reaches the threshold get
   the next axes.  Single precision is used with a margin; pairs inside the margin are decided in double precision
   from the original components.  So no link is lost and none added, whatever the tree or the basis looks like.
5. A pair of tiles returns a count of links per vector and a spanning forest of its links, never all pairs; components
   are joined from the forests.

Defined results: a vector that is null, empty, zero, or holds null or non-finite components links with nothing
(``n_links`` 0, its own component); vectors of different length do not link; rows that repeat an id are vectors of their
own; the component of rows without any id is null and they are not kept; an empty table gives no rows; extra columns
(labels) are ignored.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortlens.llm.components import components
from cohortlens.session import Scratch

THRESHOLD = 0.9
TILE = 4096              # vectors of a tile, about
LEAVES = 4096            # leaves of the tree at most; with ``BOX`` it bounds what is broadcast
BOX = 1 << 18            # numbers in all leaves' boxes at most
SAMPLE = 16_384          # vectors that the tree is fitted on
AXES = 8                 # leading axes that the tree may cut
STEP = 1024              # rows of a tile compared at once
MARGIN = 1e-5            # rounding of single-precision products of unit vectors is far below
_NO_ID = 1 << 62         # names of copies without any id start here


def _matrix(col, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column as doubles, padded with zeros, and their lengths."""
    off = col.offsets.to_numpy().astype(np.int64)
    flat = col.values.to_numpy(zero_copy_only=False)[off[0]:off[-1]].astype(np.float64)
    size = np.diff(off)
    if len(size) and (size == width).all():
        return flat.reshape(len(size), width), size
    out = np.zeros((len(size), width))
    out[np.arange(width) < size[:, None]] = flat
    return out, size


def unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors; the largest component is divided out first, so no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _moments(width: int):
    def run(batches):
        g = np.zeros((width, width))
        for b in batches:
            if b.num_rows:
                x = unit(_matrix(b.column("e"), width)[0])
                g += x.T @ x
        i, j = np.triu_indices(width)
        yield pa.record_batch([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(g[i, j])], names=["i", "j", "v"])
    return run


def basis(classes: DataFrame, width: int) -> np.ndarray:
    """Orthonormal columns by descending energy."""
    g = np.zeros((width, width))
    for r in classes.select("e").mapInArrow(_moments(width), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        g[r.i, r.j] = g[r.j, r.i] = r.v
    return np.ascontiguousarray(np.linalg.eigh(g)[1][:, ::-1])


def fit_tree(z: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and cut of every inner node of a complete tree of ``depth`` levels: the widest leading axis at its median."""
    axis, cut = np.zeros((1 << depth) - 1, dtype=np.int64), np.zeros((1 << depth) - 1)
    parts = {0: z[:, :AXES]}
    for node in range(len(axis)):
        p = parts.pop(node)
        if len(p) > 1:
            axis[node] = int(np.ptp(p, axis=0).argmax())
            cut[node] = np.median(p[:, axis[node]])
        right = p[:, axis[node]] > cut[node]
        parts[2 * node + 1], parts[2 * node + 2] = p[~right], p[right]
    return axis, cut


def leaf_of(z: np.ndarray, axis: np.ndarray, cut: np.ndarray) -> np.ndarray:
    node = np.zeros(len(z), dtype=np.int64)
    for _ in range((len(axis) + 1).bit_length() - 1):
        node = 2 * node + 1 + (z[np.arange(len(z)), axis[node]] > cut[node])
    return (node - len(axis)).astype(np.int32)


def _dealt(width: int, shared):
    def run(batches):
        rot, axis, cut = shared.value
        for b in batches:
            if b.num_rows:
                leaf = leaf_of(unit(_matrix(b.column("e"), width)[0]) @ rot, axis, cut)
                yield pa.record_batch([pa.array(leaf), *[b.column(c) for c in ("node", "w", "e")]], names=["leaf", "node", "w", "e"])
    return run


_STATS = "leaf int, part int, n long, w long, rep long, short int, long int, lo binary, hi binary"


def _boxes(width: int, shared):
    """Of a task's rows, one row per leaf: rows, weight, smallest node, shortest and longest length, bounding box in all axes."""
    def run(batches):
        import pandas as pd
        rot = shared.value[0]
        acc: dict[int, list] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x, size = _matrix(b.column("e"), width)
            z, leaf = unit(x) @ rot, b.column("leaf").to_numpy()
            w, node = b.column("w").to_numpy(), b.column("node").to_numpy()
            for k in np.unique(leaf):
                m = leaf == k
                _merge_box(acc, int(k), int(m.sum()), int(w[m].sum()), int(node[m].min()), int(size[m].min()), int(size[m].max()), z[m].min(axis=0), z[m].max(axis=0))
        rows = [(k, 0, *v[:5], v[5].tobytes(), v[6].tobytes()) for k, v in acc.items()]
        names = [c.split()[0] for c in _STATS.split(", ")]
        if rows:
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=names).astype({"leaf": "int32", "part": "int32", "short": "int32", "long": "int32"}), preserve_index=False)
    return run


def _merge_box(acc, k, n, w, rep, short, long, lo, hi):
    if k in acc:
        a = acc[k]
        acc[k] = [a[0] + n, a[1] + w, min(a[2], rep), min(a[3], short), max(a[4], long), np.minimum(a[5], lo), np.maximum(a[6], hi)]
    else:
        acc[k] = [n, w, rep, short, long, lo, hi]


def _merged(key, frame):
    import pandas as pd
    acc: dict[int, list] = {}
    for r in frame.itertuples(index=False):
        _merge_box(acc, 0, r.n, r.w, r.rep, r.short, r.long, np.frombuffer(r.lo), np.frombuffer(r.hi))
    v = acc[0]
    return pd.DataFrame([(key[0], 0, *v[:5], v[5].tobytes(), v[6].tobytes())], columns=[c.split()[0] for c in _STATS.split(", ")])


def _leaf_pairs(shared, threshold: float):
    """Partners of each leaf: ``(a, b, inside)`` with ``a <= b``; leaves too far apart are left out."""
    far = 2 - 2 * threshold         # squared distance of unit vectors at the threshold

    def run(batches):
        leaf, lo, hi, short, long = shared.value
        for b in batches:
            out = []
            for i in b.column("id").to_pylist():
                gap = np.maximum(0, np.maximum(lo[i:] - hi[i], lo[i] - hi[i:]))
                reach = np.maximum(hi[i:] - lo[i], hi[i] - lo[i:])
                near = np.flatnonzero((gap * gap).sum(axis=1) <= far + MARGIN)
                all_in = (reach * reach).sum(axis=1) < far - MARGIN
                same = (short[i:] == long[i]) & (long[i:] == short[i])
                out += [(int(leaf[i]), int(leaf[i + j]), bool(all_in[j] and same[j])) for j in near.tolist()]
            yield pa.record_batch([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.bool_()))], names=["a", "b", "inside"])
    return run


def _tile(width: int, kind):
    schema = pa.schema([("leaf", pa.int32()), ("chunk", pa.int32()), ("node", pa.binary()), ("w", pa.binary()), ("size", pa.binary()), ("x", pa.binary())])

    def run(key, table):
        x, size = _matrix(table.column("e").combine_chunks(), width)
        cells = [table.column("node").to_numpy().astype(np.int64), table.column("w").to_numpy().astype(np.int64), size.astype(np.int32), x.astype(kind)]
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), *[pa.array([c.tobytes()], pa.binary()) for c in cells]], schema=schema)
    return run


def linked(xa: np.ndarray, xb: np.ndarray, na: np.ndarray, nb: np.ndarray, rot: np.ndarray, first: int, threshold: float):
    """Yields ``(first row, mask)`` of the links between the rows of two tiles, ``STEP`` rows of the first at a time."""
    width = xa.shape[1]
    ua, ub = unit(xa), unit(xb)
    za, zb = (ua @ rot).astype(np.float32), (ub @ rot).astype(np.float32)
    left_a, left_b = (np.sqrt(np.maximum(0, np.cumsum((z * z)[:, ::-1], axis=1)[:, ::-1])) for z in (za, zb))    # norms from an axis on
    low = np.float32(threshold - MARGIN)
    steps = [*range(first, width, max(8, first)), width]
    for r in range(0, len(xa), STEP):
        a = slice(r, r + STEP)
        part = za[a, :first] @ zb[:, :first].T
        mask = np.zeros(part.shape, dtype=bool)
        if first < width:
            bound = np.outer(left_a[a, first], left_b[:, first])
            bound += part
            alive = bound >= low
            n = int(alive.sum())
        else:
            n = part.size
        if n > part.size // 16:         # dense: the remaining products of the whole block at once
            if first < width:
                part += za[a, first:] @ zb[:, first:].T
            i, j = np.nonzero(part >= low)
            value = part[i, j]
        else:                           # sparse: axis block by axis block, only for the pairs still open
            i, j = np.nonzero(alive)
            value = part[i, j]
            for k, to in zip(steps, steps[1:]):
                if not len(i):
                    break
                value = value + np.einsum("ij,ij->i", za[r + i, k:to], zb[j, k:to])
                if to < width:
                    open_ = value + left_a[r + i, to] * left_b[j, to] >= low
                    i, j, value = i[open_], j[open_], value[open_]
            i, j = i[value >= low], j[value >= low]
            value = value[value >= low]
        close = np.flatnonzero(value < threshold + MARGIN)
        good = np.ones(len(i), dtype=bool)
        for at in range(0, len(close), 65_536):      # double precision, from the vectors as they came
            c = close[at:at + 65_536]
            p, q = xa[r + i[c]], xb[j[c]]
            p, q = p / np.abs(p).max(axis=1, keepdims=True), q / np.abs(q).max(axis=1, keepdims=True)
            dot, pp, qq = (np.einsum("ij,ij->i", s, t) for s, t in ((p, q), (p, p), (q, q)))
            good[c] = dot / (np.sqrt(pp) * np.sqrt(qq)) >= threshold
        good &= na[r + i] == nb[j]
        mask[i[good], j[good]] = True
        yield r, mask


class Forest:
    """Spanning forest of the links between rows and columns that come row by row."""

    def __init__(self, columns: int):
        self.comp = np.full(columns, -1, dtype=np.int64)
        self.links: list[tuple[int, int]] = []

    def add(self, row: int, cols: np.ndarray) -> None:
        c = self.comp[cols]
        lo, hi = int(c.min()), int(c.max())
        self.links.append((row, int(cols[0])))
        if lo == hi and lo >= 0:
            return
        fresh = cols[c < 0]
        self.links += [(row, int(x)) for x in fresh if x != cols[0]]
        old = np.unique(c[c >= 0])
        name = int(old[0]) if len(old) else row
        for o in old:
            here = np.flatnonzero(self.comp == o)
            if here[0] != cols[0]:
                self.links.append((row, int(here[0])))
            if o != name:
                self.comp[here] = name
        self.comp[fresh] = name


def _compare(width: int, kind, shared, threshold: float):
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("other", pa.int64())])

    def run(batches):
        rot, first = shared.value
        for b in batches:
            for row in b.to_pylist():
                node_a, node_b = (np.frombuffer(row[f"node_{s}"], dtype=np.int64) for s in "ab")
                w_a, w_b = (np.frombuffer(row[f"w_{s}"], dtype=np.int64) for s in "ab")
                size_a, size_b = (np.frombuffer(row[f"size_{s}"], dtype=np.int32) for s in "ab")
                x_a, x_b = (np.frombuffer(row[f"x_{s}"], dtype=kind).reshape(-1, width).astype(np.float64) for s in "ab")
                own = row["same"]
                count_a, count_b = np.zeros(len(node_a), dtype=np.int64), np.zeros(len(node_b), dtype=np.int64)
                forest = Forest(len(node_b))
                for r, mask in linked(x_a, x_b, size_a, size_b, rot, first, threshold):
                    if own:
                        np.fill_diagonal(mask[:, r:], False)
                    rows = np.flatnonzero(mask.any(axis=1))
                    if not len(rows):
                        continue
                    for i in rows.tolist():
                        cols = np.flatnonzero(mask[i])
                        count_a[r + i] += int(w_b[cols].sum())
                        forest.add(r + i, cols)
                    if not own:
                        cols = np.flatnonzero(mask.any(axis=0))
                        count_b[cols] += w_a[r + rows] @ mask[np.ix_(rows, cols)].astype(np.int64)
                out = [(int(node_a[i]), int(count_a[i]), None) for i in np.flatnonzero(count_a).tolist()]
                out += [(int(node_b[i]), int(count_b[i]), None) for i in np.flatnonzero(count_b).tolist()]
                out += [(int(node_a[i]), None, int(node_b[j])) for i, j in forest.links]
                if out:
                    yield pa.record_batch([pa.array([o[c] for o in out], pa.int64()) for c in range(3)], schema=schema)
    return run


@contextmanager
def small_batches(spark):
    """A few rows per Arrow batch while a plan with tiles in its rows is made and run."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, "8")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding",
                    tile: int = TILE, leaves: int = LEAVES, sample: int = SAMPLE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neardup")
    fine = F.expr("coalesce(size(e) > 0 and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(e, x -> x <> 0), false)")
    rows = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("e")).withColumn("fine", fine)
                   .withColumn("k1", F.xxhash64("e")).withColumn("k2", F.xxhash64(F.reverse("e"), F.size("e"))))
    classes = scratch.keep(rows.where("fine").groupBy("k1", "k2", "e").agg(F.min("vec_id").alias("_id"), F.count(F.lit(1)).alias("w"))
                               .select(F.coalesce("_id", F.shiftrightunsigned("k1", 2) + F.lit(_NO_ID)).alias("node"), "w", "e", "k1", "k2"))
    size = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("e")).alias("d")).first()
    if not size.n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    n, width = size.n, size.d
    kind = np.float32 if dict(vectors.dtypes)[vec_col] == "array<float>" else np.float64

    rot = basis(classes, width)
    taken = classes.select("e") if n <= sample else classes.select("e").sample(min(1.0, 1.2 * sample / n), seed=1).limit(sample)
    fitted = np.zeros((0, width))
    if (seen := taken.toArrow()).num_rows:
        fitted = unit(_matrix(seen.column("e").combine_chunks(), width)[0]) @ rot
    tree = fit_tree(fitted, max(1, min(leaves, BOX // width, -(-n // tile))).bit_length() - 1)
    # the first block of axes: what is left of it holds half of the energy
    energy = np.cumsum((fitted * fitted).mean(axis=0)) if len(fitted) else np.ones(width)
    first = min(width, 8 * int(np.ceil((1 + int(np.searchsorted(energy, 0.5))) / 8)))

    model = spark.sparkContext.broadcast((rot, *tree))
    dealt = scratch.keep(classes.select("node", "w", "e").mapInArrow(_dealt(width, model), f"leaf int, node long, w long, e {dict(vectors.dtypes)[vec_col]}"))
    parts = dealt.mapInArrow(_boxes(width, model), _STATS).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)).cast("int"))
    stats = sorted(parts.groupBy("leaf", "part").applyInPandas(_merged, _STATS).groupBy("leaf").applyInPandas(_merged, _STATS).collect(), key=lambda r: r.leaf)
    boxes = spark.sparkContext.broadcast((np.array([r.leaf for r in stats]), np.array([np.frombuffer(r.lo) for r in stats]), np.array([np.frombuffer(r.hi) for r in stats]),
                                          np.array([r.short for r in stats]), np.array([r.long for r in stats])))
    about = spark.createDataFrame([(r.leaf, -(-r.n // tile), r.w, r.rep) for r in stats], "leaf int, chunks int, lw long, rep long")     # at most ``leaves`` rows
    pairs = scratch.keep(spark.range(len(stats), numPartitions=max(1, min(64, len(stats) // 16)))
                              .mapInArrow(_leaf_pairs(boxes, threshold), "a int, b int, inside boolean"))

    def named(s):
        return F.broadcast(about.select(F.col("leaf").alias(s), F.col("chunks").alias(f"c{s}"), F.col("lw").alias(f"w{s}"), F.col("rep").alias(f"r{s}")))

    both = pairs.join(named("a"), "a").join(named("b"), "b")
    # leaves in one another's reach as a whole: every vector links with all of the partners, by weights and one link each
    whole = both.where("inside")
    partners = (whole.select(F.col("a").alias("leaf"), F.col("rb").alias("v"), F.col("wb").alias("g"), (F.col("a") == F.col("b")).alias("own"))
                     .union(whole.where("a <> b").select("b", "ra", "wa", F.lit(False)))
                     .groupBy("leaf").agg(F.min("v").alias("v"), F.sum("g").alias("g"), F.max("own").alias("own")))      # one row per leaf
    inside = scratch.keep(dealt.select("leaf", "node", "w").join(F.broadcast(partners), "leaf")
                               .select("node", "v", (F.col("g") - F.when(F.col("own"), F.col("w")).otherwise(0)).alias("n")))
    sure = (inside.select(F.col("node").alias("u"), "v").union(whole.where("a <> b").select(F.col("ra").alias("u"), F.col("rb").alias("v"))))

    # the other pairs of tiles
    tiles = scratch.keep(dealt.join(F.broadcast(about.select("leaf", "chunks")), "leaf")
                              .withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
                              .select("leaf", "chunk", "node", "w", "e").groupBy("leaf", "chunk")
                              .applyInArrow(_tile(width, kind), "leaf int, chunk int, node binary, w binary, size binary, x binary"))
    todo = (both.where("not inside").select("a", "b", F.explode(F.sequence(F.lit(0), F.col("ca") - 1)).alias("i"), "cb")
                .select("a", "b", "i", F.explode(F.sequence(F.when(F.col("a") == F.col("b"), F.col("i")).otherwise(0), F.col("cb") - 1)).alias("j")))

    def side(s, chunk):
        return tiles.select(F.col("leaf").alias(s), F.col("chunk").alias(chunk), *[F.col(c).alias(f"{c}_{s}") for c in ("node", "w", "size", "x")])

    ready = (todo.join(side("a", "i"), ["a", "i"]).join(side("b", "j"), ["b", "j"])
                 .withColumn("same", (F.col("a") == F.col("b")) & (F.col("i") == F.col("j"))))
    start = spark.sparkContext.broadcast((rot, first))
    with small_batches(spark):
        found = scratch.keep(ready.mapInArrow(_compare(width, kind, start, threshold), "node long, n long, other long"))
    links = found.where("other is not null").select(F.col("node").alias("u"), F.col("other").alias("v"))
    counts = (found.where("n is not null").select("node", "n").union(inside.select("node", "n"))
                   .groupBy("node").agg(F.sum("n").alias("n")))
    labels = components(links.union(sure)).withColumnRenamed("v", "node")

    known = (classes.select("node", "w", "k1", "k2").join(counts, "node", "left").join(labels, "node", "left")
                    .where((F.col("w") > 1) | F.col("n").isNotNull()))
    known = scratch.keep(known.select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n"), F.coalesce("comp", "node").alias("comp")))
    out = rows.select("vec_id", F.when(F.col("fine"), F.col("k1")).alias("k1"), F.when(F.col("fine"), F.col("k2")).alias("k2")).join(known, ["k1", "k2"], "left")
    comp = F.when(F.col("comp").isNull(), F.col("vec_id")).when(F.col("comp") < _NO_ID, F.col("comp"))
    out = scratch.keep(out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id")))
    scratch.drop(classes, dealt, pairs, inside, tiles, found, known)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
