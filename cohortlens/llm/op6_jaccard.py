r"""n-gram Jaccard join with grouped prefixes, and the components of its links.

A document's set is its distinct word ``q``-gram shingles (64-bit hashes).  Two
documents link when ``100 |A & B| >= threshold_pct |A | B|``.

* **Order.**  Shingle frequencies over all documents are counted in a table of
  hashed counters (``BUCKETS``, doubled with the number of documents up to ``MAX_BUCKETS``).  Shingles whose counter stands out of the chance
  variation of its load come last, by doublings; all others come in hash order.  Shingles of
  common lines and passages so stay out of prefixes.
* **Groups.**  The prefix of a set of ``n`` shingles is its first
  ``n - ceil(t n) + 1``; linked sets share a prefix shingle.  Documents with identical
  sets are one node; nodes with identical prefix and size are one group and post their
  prefix once.
* **Filters.**  Size, position of the shared shingle, and an exact bound from histograms of the
  sets (``|A ^ B| >= sum |a_i - b_i|``) drop pairs before any set is read: 32 bins inside the
  join, then bins in proportion to the set size, then parities of two to four bits a shingle.
* **Expand and verify.**  What is asked for is the components, so pairs inside one
  component need no look.  Star rounds verify members against their group's first
  node, groups against pivots of each shared shingle's groups, then nodes against
  several random pivots per shingle.  The closing round verifies *every* remaining
  candidate pair of nodes in different components, so no link is lost, while a dense
  group of thousands of near copies costs rows in proportion to its size: at each shingle
  only nodes outside its most frequent component look for partners, and only in bands of
  sizes that can link.

Verification intersects the whole sets, rebuilt from the texts of the candidate nodes.

Defined results: a null or empty text, or one without words, has ``n_shingles`` 0 and links
with nothing (its component is its own id); fewer than ``q`` words make one
shingle of the whole sequence; repeated rows and copies share a component; a null doc_id
is never a component's name unless all members lack one; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortlens.llm.components import components
from cohortlens.llm.textops import CHUNK, codepoints, lower_ascii, mix, word_hashes
from cohortlens.session import Scratch

BUCKETS = 1 << 20
MAX_BUCKETS = 1 << 24
_CHUNK = 1 << 14              # counters that travel in one row
BINS = 32
FINE = 64                     # finer histogram: this many bins for up to 4,096 shingles, doubled with the size
BROADCAST_IDS = 1_000_000     # ids (8 bytes each) a side may have to be broadcast; larger ones are joined by shuffle
PIVOTS = 6
DENSE, DENSE_SHARE = 32, 1500      # pivot rounds look at shingles of this many groups, or 1 / DENSE_SHARE of them, or more; the closing round at all
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                  0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def shingles(text: str | None, q: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    if not text:
        return np.zeros(0, dtype=np.uint64)
    h = word_hashes(lower_ascii(codepoints(text)))
    n = len(h)
    if n == 0:
        return h
    if n < q:
        return mix((h * _MULT[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
    s = np.full(n - q + 1, q, dtype=np.uint64)
    for k in range(q):
        s += h[k:n - q + 1 + k] * _MULT[k]
    return np.unique(mix(s))


def prefix_size(n: int, pct: int) -> int:
    return n - -(-pct * n // 100) + 1


def _bucket(s: np.ndarray, buckets: int) -> np.ndarray:
    return (s >> np.uint64(65 - buckets.bit_length())).astype(np.int64)


def _sketch(q: int, buckets: int):
    def run(batches):
        c = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            held, n = [], 0
            for text in [*b.column("text").to_pylist(), None]:
                s = shingles(text, q)
                held.append(s)
                n += len(s)
                if text is None or n > CHUNK:
                    at = _bucket(np.concatenate(held), buckets)
                    if buckets <= 1 << 22:
                        c += np.bincount(at, minlength=buckets)
                    else:
                        at, more = np.unique(at, return_counts=True)
                        c[at] += more
                    held, n = [], 0
        parts = c.reshape(-1, min(buckets, _CHUNK))
        yield pa.record_batch([pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["chunk", "counts"])
    return run


def _merge(key, frame):
    import pandas as pd
    total = sum(np.frombuffer(raw, dtype=np.int64) for raw in frame["counts"])
    return pd.DataFrame({"chunk": [key[0]], "salt": [0], "counts": [total.tobytes()]})


def frequency_classes(docs: DataFrame, q: int) -> np.ndarray:
    """Per counter: 0 for ordinary shingles, else 1 and the doublings of its excess over the mean load."""
    buckets = min(MAX_BUCKETS, max(BUCKETS, 1 << (4 * docs.count()).bit_length()))
    parts = docs.select("text").mapInArrow(_sketch(q, buckets), "chunk int, counts binary")
    merged = "chunk int, salt int, counts binary"
    parts = parts.withColumn("salt", F.floor(F.spark_partition_id() / 64).cast("int"))     # merged in two levels: a few tables per task
    rows = (parts.groupBy("chunk", "salt").applyInPandas(_merge, merged)
                 .groupBy("chunk").applyInPandas(_merge, merged).collect())         # ``buckets`` counters in all
    c = np.zeros((buckets // min(buckets, _CHUNK), min(buckets, _CHUNK)), dtype=np.int64)
    for r in rows:
        c[r.chunk] = np.frombuffer(r.counts, dtype=np.int64)
    c = c.reshape(-1)
    mean = c.sum() / buckets
    chance = 6 * np.sqrt(mean) + 8          # six deviations of a load of single shingles
    over = (c - mean) / chance
    return np.where(over > 1, 1 + np.floor(np.log2(np.maximum(over, 1))), 0).astype(np.uint8)


_HIST = [f"h{i}" for i in range(BINS // 8)]      # 32 bins of one byte each, packed into longs
_PROFILE = f"doc_id long, th long, n long, sid long, gkey long, {', '.join(h + ' long' for h in _HIST)}, fine binary, prefix array<long>"


def fine_bins(n: int) -> int:
    return FINE << max(0, (n - 1).bit_length() - 12)


def _profile(q: int, pct: int, shared):
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("sid", pa.int64()), ("gkey", pa.int64()),
                        *((h, pa.int64()) for h in _HIST), ("fine", pa.binary()), ("prefix", pa.list_(pa.int64()))])

    def run(batches):
        classes = shared.value
        for b in batches:
            n, sid, gkey, hist, fine, prefix = [], [], [], [], [], []
            for text in b.column("text").to_pylist():
                s = shingles(text, q)
                k = len(s)
                n.append(k)
                if not k:
                    sid.append(0)
                    gkey.append(0)
                    hist.append(np.zeros(len(_HIST), dtype=np.int64))
                    fine.append(b"")
                    prefix.append([])
                    continue
                cls = classes[_bucket(s, len(classes))]
                first = s[np.argsort(cls, kind="stable")[:prefix_size(k, pct)]]
                weight = np.arange(1, k + 1, dtype=np.uint64)
                sid.append(int(mix((mix(s ^ np.uint64(k)) * weight).sum(keepdims=True, dtype=np.uint64)).view(np.int64)[0]))
                gkey.append(int(mix((mix(first) * weight[:len(first)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(k)).view(np.int64)[0]))
                # saturated bins differ by no more than the true ones: the bound stays a bound
                hist.append(np.minimum(np.bincount((s & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).view(np.int64))
                bins = fine_bins(k)
                fine.append(np.bincount(((s >> np.uint64(8)) & np.uint64(bins - 1)).astype(np.int64), minlength=bins).astype(np.uint16).tobytes())
                prefix.append(first.view(np.int64))
            yield pa.record_batch([b.column("doc_id"), b.column("th"), pa.array(n, pa.int64()), pa.array(sid, pa.int64()),
                                   pa.array(gkey, pa.int64()), *(pa.array([h[i] for h in hist], pa.int64()) for i in range(len(_HIST))), pa.array(fine, pa.binary()),
                                   pa.array(prefix, pa.list_(pa.int64()))], schema=schema)
    return run


def _once(batches, q: int):
    """Text hashes and sets of each batch; copies of a text in this task are read once."""
    seen: set[int] = set()
    for b in batches:
        th, sets = [], []
        for t, text in zip(b.column("th").to_pylist(), b.column("text").to_pylist()):
            if t not in seen:
                seen.add(t)
                th.append(t)
                sets.append(shingles(text, q))
        yield th, sets


def _sets(q: int):
    schema = pa.schema([("th", pa.int64()), ("toks", pa.list_(pa.int64()))])

    def run(batches):
        for th, sets in _once(batches, q):
            yield pa.record_batch([pa.array(th, pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], schema=schema)
    return run


def parity(s: np.ndarray) -> bytes:
    """Of each of 2 to 4 bits a shingle (a power of two, 8 at least), whether an odd number of shingles falls on it."""
    bits = 8 << max(0, (2 * len(s) - 1).bit_length() - 3)
    at = (s & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def parity_gap(x: bytes, y: bytes) -> int:
    """Odd bits of the symmetric difference: no more than it has shingles."""
    w = min(len(x), len(y))         # the finer one folds onto the coarser one
    x, y = (np.bitwise_xor.reduce(np.frombuffer(p, dtype=np.uint8).reshape(-1, w), axis=0) for p in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def _parities(q: int):
    schema = pa.schema([("th", pa.int64()), ("n", pa.int64()), ("bits", pa.binary())])

    def run(batches):
        for th, sets in _once(batches, q):
            yield pa.record_batch([pa.array(th, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                                   pa.array([parity(s) for s in sets], pa.binary())], schema=schema)
    return run


def _parity_filter(pct: int):
    """Keeps the pairs whose parities leave room for a link."""
    def run(batches):
        for b in batches:
            keep = [parity_gap(x, y) * (100 + pct) <= (100 - pct) * (na + nb)
                    for na, nb, x, y in zip(b.column("na").to_pylist(), b.column("nb").to_pylist(), b.column("xa").to_pylist(), b.column("xb").to_pylist())]
            yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b", "ta", "tb"])
    return run


def _close(a: str, b: str, pct: int):
    """Size and histogram filters on two node structs: necessary for a link."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    gap = F.lit(0)
    for h in _HIST:
        for at in range(0, 64, 8):
            x, y = (F.shiftrightunsigned(F.col(f"{s}.{h}"), at).bitwiseAND(F.lit(255)) for s in (a, b))
            gap = gap + F.abs(x - y)
    # |A ^ B| <= (1 - t) / (1 + t) (|A| + |B|)
    return ((F.least(na, nb) * 100 >= F.greatest(na, nb) * pct)
            & (gap * (100 + pct) <= (100 - pct) * (na + nb)))


def _fine_filter(pct: int):
    """Keeps the pairs that pass the histogram bound with bins in proportion to their sizes."""
    def run(batches):
        for b in batches:
            keep = []
            for na, nb, x, y in zip(b.column("na").to_pylist(), b.column("nb").to_pylist(), b.column("fa").to_pylist(), b.column("fb").to_pylist()):
                x, y = np.frombuffer(x, dtype=np.uint16).astype(np.int64), np.frombuffer(y, dtype=np.uint16).astype(np.int64)
                w = min(len(x), len(y))     # the finer one folds onto the coarser one
                gap = int(np.abs(x.reshape(-1, w).sum(axis=0) - y.reshape(-1, w).sum(axis=0)).sum())
                keep.append(gap * (100 + pct) <= (100 - pct) * (na + nb))
            yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b", "ta", "tb"])
    return run


def _attached(pairs: DataFrame, nodes: DataFrame, pct: int) -> DataFrame:
    """Node pairs ``a, b`` that pass the fine histograms, with the text hash of each."""
    at = nodes.select("sid", "th", "n", "fine")
    left = at.select(F.col("sid").alias("a"), F.col("th").alias("ta"), F.col("n").alias("na"), F.col("fine").alias("fa"))
    right = at.select(F.col("sid").alias("b"), F.col("th").alias("tb"), F.col("n").alias("nb"), F.col("fine").alias("fb"))
    return (pairs.select("a", "b").distinct().join(left, "a").join(right, "b")
                 .mapInArrow(_fine_filter(pct), "a long, b long, ta long, tb long"))


def _texts_of(docs: DataFrame, pairs: DataFrame) -> DataFrame | None:
    """``text, th`` of the texts that ``pairs(ta, tb)`` name; none without a pair."""
    ids = pairs.select(F.col("ta").alias("th")).union(pairs.select(F.col("tb").alias("th"))).distinct()
    n = ids.count()
    ids = F.broadcast(ids) if n <= BROADCAST_IDS else ids
    return docs.select("text", F.xxhash64("text").alias("th")).join(ids, "th", "left_semi") if n else None


def _verify(docs: DataFrame, pairs: DataFrame, q: int, pct: int, scratch: Scratch) -> DataFrame:
    """Of ``pairs(a, b, ta, tb)`` (nodes and a text hash of each) those that link, by whole sets: ``u, v``.

    A pair takes a whole set through the shuffle, so parities (2 to 4 bits a shingle, not 64) drop most of the others first.
    """
    none = docs.sparkSession.createDataFrame([], "u long, v long")
    pairs = scratch.keep(pairs.select("a", "b", "ta", "tb"))
    texts = _texts_of(docs, pairs)
    if texts is None:
        scratch.drop(pairs)
        return none
    bits = scratch.keep(texts.mapInArrow(_parities(q), "th long, n long, bits binary").distinct())
    near = scratch.keep(pairs.join(bits.select(F.col("th").alias("ta"), F.col("n").alias("na"), F.col("bits").alias("xa")), "ta")
                             .join(bits.select(F.col("th").alias("tb"), F.col("n").alias("nb"), F.col("bits").alias("xb")), "tb")
                             .mapInArrow(_parity_filter(pct), "a long, b long, ta long, tb long"))
    scratch.drop(pairs, bits)
    texts = _texts_of(docs, near)
    if texts is None:
        scratch.drop(near)
        return none
    sets = scratch.keep(texts.mapInArrow(_sets(q), "th long, toks array<long>").distinct())
    both = (near.join(sets.select(F.col("th").alias("ta"), F.col("toks").alias("x")), "ta")
                .join(sets.select(F.col("th").alias("tb"), F.col("toks").alias("y")), "tb")
                .select("a", "b", F.size("x").cast("long").alias("na"), F.size("y").cast("long").alias("nb"),
                        F.size(F.array_intersect("x", "y")).cast("long").alias("i")))
    found = scratch.keep(both.where(F.col("i") * 100 >= (F.col("na") + F.col("nb") - F.col("i")) * pct)
                             .select(F.col("a").alias("u"), F.col("b").alias("v")))
    scratch.drop(near, sets)
    return found


def _joined(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``labels(sid, gkey, comp)`` after ``links``: only the components that these touch are contracted."""
    comp = labels.select("sid", "comp")
    e = (links.join(comp.select(F.col("sid").alias("u"), F.col("comp").alias("cu")), "u")
              .join(comp.select(F.col("sid").alias("v"), F.col("comp").alias("cv")), "v").select(F.col("cu").alias("u"), F.col("cv").alias("v")))
    merged = components(e).select(F.col("v").alias("comp"), F.col("comp").alias("to"))
    return scratch.keep(labels.join(merged, "comp", "left").select("sid", "gkey", F.coalesce("to", "comp").alias("comp")))


def jaccard_components(docs: DataFrame, q: int = 3, threshold_pct: int = 90) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document."""
    return _components(docs, q, threshold_pct).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, q: int = 3, threshold_pct: int = 90) -> DataFrame:
    """``docs`` with one row of each component, its smallest doc_id; all columns as they are.

    Only the keys of what goes are joined, never the texts of what stays.
    """
    scratch = Scratch(docs.sparkSession, "keep-one")
    found = scratch.keep(_components(docs, q, threshold_pct).where(F.col("n_shingles") > 0)
                         .groupBy("doc_id", "th").agg(F.max((~F.col("doc_id").eqNullSafe(F.col("component_id"))).cast("int")).alias("_goes"),
                                                      F.count(F.lit(1)).alias("_rows")))
    def of(rows):
        keys = rows.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"))
        return F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys

    marked = docs.withColumn("_h", F.xxhash64("text"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_th"))
    out = marked.join(of(found.where(F.col("_goes") == 1)), same, "left_anti")
    again = found.where((F.col("_goes") == 0) & (F.col("_rows") > 1))     # rows that repeat id and text
    if not again.isEmpty():
        keys = of(again)
        once = out.join(keys, same, "left_semi").dropDuplicates(["doc_id", "_h"])
        out = out.join(keys, same, "left_anti").unionByName(once)
    return out.drop("_h")


def _components(docs: DataFrame, q: int, threshold_pct: int) -> DataFrame:
    """``doc_id, th, n_shingles, component_id`` (``th``: hash of the text) of every document."""
    pct, spark = threshold_pct, docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    classes = spark.sparkContext.broadcast(frequency_classes(docs, q))
    rows = scratch.keep(docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(_profile(q, pct, classes), _PROFILE))
    full = rows.where(F.col("n") > 0)
    # nodes (distinct sets) and groups (identical prefix and size): all columns are keys, so copies collapse before they are shuffled
    scratch.sweep()
    nodes = scratch.keep(full.groupBy("sid", "n", "gkey", *_HIST, "fine").agg(F.min("th").alias("th")))
    groups = full.select("gkey", "n", "prefix").distinct()

    # postings of groups: one exchange by shingle serves the count per shingle and the join with it (both read the same columns, and
    # the join's null filter stands before the exchange)
    before = F.concat(F.array(F.lit(0).cast("long")), F.slice("prefix", F.lit(1), F.size("prefix") - 1))
    post = (groups.select("gkey", "n", F.posexplode(F.arrays_zip(F.col("prefix").alias("tok"), before.alias("prev"))).alias("pos", "e"))
                  .select("gkey", "n", "pos", "e.tok", "e.prev").where(F.col("tok").isNotNull()).repartition("tok"))
    toks = (post.groupBy("tok").agg(F.count(F.lit(1)).alias("m"), F.min_by("gkey", F.struct("n", "pos", "prev")).alias("pivot"), F.min("n").alias("pn"))
                .where(F.col("m") > 1))
    shared = scratch.keep(post.join(toks, "tok").select("tok", "gkey", "n", "pos", "prev", "m", "pivot", "pn"))
    node = F.struct("sid", "n", *_HIST)
    pair = [F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b")]

    # star rounds: group members with their group's first node, groups with the first group of each shared shingle
    reps = nodes.groupBy("gkey").agg(F.min("sid").alias("sid"))
    heads = scratch.keep(nodes.join(reps.select("sid"), "sid", "left_semi").select("gkey", node.alias("x")))
    close = (F.col("n") * 100 >= F.col("pn") * pct) & (F.col("pn") * 100 >= F.col("n") * pct)
    cross = (shared.where((F.col("gkey") != F.col("pivot")) & close).select("gkey", "pivot").distinct()
                   .join(heads, "gkey").join(heads.select(F.col("gkey").alias("pivot"), F.col("x").alias("y")), "pivot"))
    within = (nodes.select("gkey", node.alias("x")).join(heads.select("gkey", F.col("x").alias("y")), "gkey").where(F.col("x.sid") != F.col("y.sid")))
    pairs = cross.select("x", "y").union(within.select("x", "y")).where(_close("x", "y", pct)).select(*pair)
    labels = _joined(nodes.select("sid", "gkey", F.col("sid").alias("comp")), _verify(docs, _attached(pairs, nodes, pct), q, pct, scratch), scratch)

    dense = shared.where(F.col("m") >= max(DENSE, heads.count() // DENSE_SHARE)).select("tok", "gkey", "pos", "prev")
    scratch.sweep()
    for seed in range(3):
        # several random pivots per shingle whose postings still span components
        seats = scratch.keep(_seats(dense, labels, nodes, node))
        open_ = seats.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where(F.col("lo") != F.col("hi")).select("tok")
        seats_ = seats.join(open_, "tok", "left_semi")
        pick = [F.min_by(F.struct("comp", "pos", "x"), F.xxhash64("x.sid", F.lit(seed * PIVOTS + k))).alias(f"p{k}") for k in range(PIVOTS)]
        pivots = (seats_.groupBy("tok").agg(*pick).select("tok", F.explode(F.array(*[f"p{k}" for k in range(PIVOTS)])).alias("p"))
                        .select("tok", F.col("p.pos").alias("qos"), F.col("p.comp").alias("comp2"), F.col("p.x").alias("y")).distinct())
        pairs = seats_.join(pivots, "tok").where(_candidate(pct)).select(*pair)
        more = _verify(docs, _attached(pairs, nodes, pct), q, pct, scratch)
        scratch.drop(seats)
        if more.isEmpty():
            break
        labels, old = _joined(labels, more, scratch), labels
        scratch.drop(old)
        scratch.sweep()

    # closing round: every candidate pair of nodes that lie in different components
    seats = scratch.keep(_seats(shared.select("tok", "gkey", "pos", "prev"), labels, nodes, node))
    scratch.drop(shared, heads)
    scratch.sweep()
    # leads and pairs are written: in place, their aggregates stood several times in one plan, which the driver holds
    leads = scratch.keep(_leads(seats, "tok"))
    at = seats.join(leads, "tok").withColumn("band", _band(F.col("x.n"), pct))
    other = at.select("tok", F.col("pos").alias("qos"), F.col("prev").alias("qrev"), F.col("comp").alias("comp2"), F.col("x").alias("y"),
                      F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    # where the shingle before is shared too, the pair is met there: it comes once per run of shared shingles
    again = (F.col("pos") > 0) & (F.col("qos") > 0) & (F.col("prev") == F.col("qrev"))
    once = (F.col("comp2") == F.col("lead")) | (F.col("x.sid") < F.col("y.sid"))
    inside = at.where(F.col("comp") != F.col("lead")).join(other, ["tok", "band"]).where(once & ~again & _candidate(pct)).select(*pair)
    member = labels.join(nodes.select("sid", node.alias("x")), "sid").select("gkey", "comp", "x")
    inner = scratch.keep(_leads(member, "gkey"))
    mates = member.join(inner, "gkey")
    same = (mates.where(F.col("comp") != F.col("lead")).join(mates.select("gkey", F.col("comp").alias("comp2"), F.col("x").alias("y")), "gkey")
                 .where(once & (F.col("comp") != F.col("comp2")) & _close("x", "y", pct)).select(*pair))
    pairs = scratch.keep(inside.union(same).distinct())
    scratch.drop(seats, leads, inner)
    scratch.sweep()
    more = _verify(docs, _attached(pairs, nodes, pct), q, pct, scratch)
    scratch.drop(pairs)
    if not more.isEmpty():
        labels, old = _joined(labels, more, scratch), labels
        scratch.drop(old)
    scratch.drop(nodes)
    scratch.sweep()

    placed = (rows.select("doc_id", "th", F.col("n").alias("n_shingles"), "sid").join(labels.select("sid", "comp"), "sid", "left")
                  .withColumn("comp", F.coalesce("comp", "sid")))
    names = placed.where(F.col("n_shingles") > 0).groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return (placed.join(names, "comp", "left")
                  .select("doc_id", "th", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def _candidate(pct: int):
    """Of ``x`` at ``pos`` and ``y`` at ``qos`` of one shingle: different components, and size, position and histogram allow a link."""
    most = F.least("pos", "qos") + F.least(F.col("x.n") - F.col("pos"), F.col("y.n") - F.col("qos"))    # that can be shared
    return (F.col("comp") != F.col("comp2")) & (most * (100 + pct) >= pct * (F.col("x.n") + F.col("y.n"))) & _close("x", "y", pct)


def _seats(at: DataFrame, labels: DataFrame, nodes: DataFrame, node) -> DataFrame:
    """``tok, pos, prev, comp, x``: the nodes of the postings ``at(tok, gkey, pos, prev)`` and their components."""
    who = labels.select("sid", "comp").join(nodes.select("sid", "gkey", node.alias("x")), "sid").select("gkey", "comp", "x")
    return at.join(who, "gkey").select("tok", "pos", "prev", "comp", "x")


def _leads(seats: DataFrame, key: str) -> DataFrame:
    """The keys of ``seats`` that span several components, with each key's most frequent component, ``lead``."""
    comps = seats.groupBy(key, "comp").agg(F.count(F.lit(1)).alias("c"))
    return comps.groupBy(key).agg(F.count(F.lit(1)).alias("_k"), F.max_by("comp", F.col("c")).alias("lead")).where(F.col("_k") > 1).select(key, "lead")


def _band(n, pct: int):
    """Sizes that can link lie in the same or in adjacent bands."""
    return F.floor(F.log(n.cast("double")) / max(np.log(100 / pct) * (1 + 1e-9), 1e-6)).cast("long")
