r"""Toxicity: averaged subword embeddings under a linear softmax, trained jointly.

A word (maximal run of letters and digits, lower-cased, with a mark on either
side) gives its character 4- and 5-grams and itself as hashed features.  A text is
the mean of its distinct features' embedding vectors (a text of few features is padded
with zero vectors, so one n-gram cannot decide it); a linear softmax over {0, 1} scores
it.  Embeddings and softmax are trained jointly in numpy (AdaGrad), so a
misspelling never seen in training is still placed by the n-grams it shares.

Training reads a bounded sample of labelled rows: at most about ``sample_rows``
documents (``positive_share`` of them of label 1 where there are enough), chosen by a
hash of doc_id; the sampled texts are read whole.  The loss weighs the sample
by the label shares of all eligible labels, label 1 ``POSITIVE_WEIGHT``-fold.  Scoring is one pass over all
documents: the softmax of a mean of vectors needs only each feature's margin
``E_f . (w_1 - w_0)``, one float per bucket.

Defined results: a text without any word (or null) scores the share of label 1; without
labels every score is 0; repeated labels of a document count once (the highest); an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortlens.llm.textops import CHUNK, codepoints, mix, run_hashes

BUCKETS = 1 << 17
DIM = 8
GRAMS = (4, 5)
SAMPLE_ROWS = 6000
PAD = 200          # a text with fewer distinct features is averaged with zero vectors up to this many
POSITIVE_SHARE = 0.4
POSITIVE_WEIGHT = 4.0   # the loss counts label 1 so many times its share (a miss costs more than a false alarm)

_fold: np.ndarray | None = None


def fold_table() -> np.ndarray:
    """Code point (BMP) to its lower case if it is a letter or digit, else 0; other planes: itself."""
    global _fold
    if _fold is None:
        t = np.zeros(1 << 16, dtype=np.uint32)
        for i in range(1 << 16):
            c = chr(i)
            if unicodedata.category(c)[0] in "LN":
                low = c.lower()
                t[i] = ord(low) if len(low) == 1 else i
        _fold = t
    return _fold


def features(text: str | None) -> np.ndarray:
    """Buckets of the distinct features of a text."""
    if not text:
        return np.zeros(0, dtype=np.int64)
    t, cp, out = fold_table(), codepoints(text), []
    at = 0
    while at < len(cp):   # pieces of bounded size; a piece ends at a separator where there is one
        end = min(len(cp), at + CHUNK)
        if end < len(cp):
            seps = np.flatnonzero(t[np.minimum(cp[at:end], 0xFFFF)] == 0)
            if len(seps):
                end = at + int(seps[-1]) + 1
        out.append(_piece(t, cp[at:end]))
        at = end
    seen = np.zeros(BUCKETS, dtype=bool)
    for f in out:
        seen[f] = True
    return np.flatnonzero(seen)


def _piece(t: np.ndarray, cp: np.ndarray) -> np.ndarray:
    c = np.where(cp < 0x10000, t[np.minimum(cp, 0xFFFF)], cp)
    c = np.concatenate(([0], c, [0])).astype(np.uint32)
    keep = np.ones(len(c), dtype=bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)     # one mark between words
    c = c[keep]
    letter = c != 0
    if not letter.any():
        return np.zeros(0, dtype=np.int64)
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    hs = [run_hashes(c, np.flatnonzero(first), letter)]
    v = c.astype(np.uint64) + np.uint64(1)
    inner = letter[1:-1]                          # of windows of three
    h = v[:-1] * np.uint64(0x9E3779B97F4A7C15) + v[1:]
    for n in range(3, max(GRAMS) + 1):
        h = h[:-1] * np.uint64(0xD6E8FEB86659FD93) + v[n - 1:]
        if n > 3:
            inner = inner[:-1] & letter[n - 2:-1]
        if n in GRAMS:
            hs.append(mix(h[inner] + np.uint64(n)))
    return (np.concatenate(hs) & np.uint64(BUCKETS - 1)).astype(np.int64)


def sample_ids(labels: DataFrame, eligible, sample_rows: int, positive_share: float):
    """A bounded, hash-chosen sample of ``(doc_id, y)`` and the share of label 1 among all eligible rows."""
    y = (labels.where(eligible & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
               .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("y")))
    n = {r.y: r.n for r in y.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    want = {1: min(pos, int(sample_rows * positive_share))}
    want[0] = min(neg, sample_rows - want[1])
    u = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("toxicity")), F.lit(1_000_000))
    take = F.lit(False)
    for k in (0, 1):
        if n.get(k):
            take = take | ((F.col("y") == k) & (u < int(np.ceil(1_000_000 * want[k] / n[k]))))
    return y.where(take), pos / max(1, pos + neg)


def _featurize(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("idx", pa.list_(pa.int32()))])
    for b in batches:
        idx = [features(text).astype(np.int32) for text in b.column("text").to_pylist()]
        yield pa.record_batch([b.column("doc_id"), b.column("y"), pa.array(idx, pa.list_(pa.int32()))], schema=schema)


def train(idx, tf, y, share: float, epochs: int = 6, batch: int = 32, lr: float = 0.5, l2: float = 4e-5,
          min_docs: int = 5, seed: int = 7):
    """Margins per bucket and the bias of ``logit P(1)``.

    A feature of fewer than ``min_docs`` sampled documents has no vector (it counts
    in the mean as zero): it could only memorise the sample.
    """
    rng = np.random.default_rng(seed)
    df = np.zeros(BUCKETS, dtype=np.int64)
    for i in idx:
        df[i] += 1              # a document's features are distinct
    known = df >= min_docs
    # what is known, in one array: the sample is a large part of what the driver holds
    size = [int(known[i].sum()) for i in idx]
    flat, ends = np.empty(sum(size), dtype=np.int32), np.cumsum([0, *size])
    for r, i in enumerate(idx):
        flat[ends[r]:ends[r + 1]] = i[known[i]]
    tf = [np.broadcast_to(v[:1], n) if len(v) else v for v, n in zip(tf, size)]     # one value a document
    idx = [flat[a:b] for a, b in zip(ends, ends[1:])]
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    w = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    b = np.zeros(2, dtype=np.float32)
    g_emb = np.full((BUCKETS, DIM), 1e-8, dtype=np.float32)
    g_w, g_b = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    n, pos = len(y), max(1, int(y.sum()))
    share = min(0.5, POSITIVE_WEIGHT * share)
    weight = np.where(y == 1, share * n / pos, (1 - share) * n / max(1, n - pos)).astype(np.float32)
    if pos == n or not y.any():
        weight[:] = 1
    order = np.arange(n)
    for epoch in range(epochs):
        rng.shuffle(order)
        rate = lr * (1 - epoch / epochs)
        for at in range(0, n, batch):
            rows = order[at:at + batch]
            rows = rows[[len(idx[r]) > 0 for r in rows]]
            if not len(rows):
                continue
            i, v = np.concatenate([idx[r] for r in rows]), np.concatenate([tf[r] for r in rows])
            size = np.array([len(idx[r]) for r in rows])
            row = np.repeat(np.arange(len(rows)), size)
            h = np.add.reduceat(emb[i] * v[:, None], np.concatenate(([0], np.cumsum(size)[:-1])), axis=0)
            z = h @ w + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            err = p.copy()
            err[np.arange(len(rows)), y[rows]] -= 1
            err *= weight[rows][:, None] / len(rows)
            gw, gb, gh = h.T @ err, err.sum(axis=0), err @ w.T
            uniq, inv = np.unique(i, return_inverse=True)
            ge = np.empty((len(uniq), DIM), dtype=np.float32)
            for k in range(DIM):
                ge[:, k] = np.bincount(inv, weights=v * gh[row, k], minlength=len(uniq))
            if l2:
                ge += l2 * emb[uniq]
            g_emb[uniq] += ge * ge
            emb[uniq] -= rate * ge / np.sqrt(g_emb[uniq])
            g_w += gw * gw
            w -= rate * gw / np.sqrt(g_w)
            g_b += gb * gb
            b -= rate * gb / np.sqrt(g_b)
    return np.where(known, emb @ (w[:, 1] - w[:, 0]), 0).astype(np.float32), float(b[1] - b[0])


def fit(docs: DataFrame, labels: DataFrame, eligible, sample_rows: int = SAMPLE_ROWS,
        positive_share: float = POSITIVE_SHARE):
    """``(margin per bucket, bias, score of a text without words)``; None without labels."""
    ids, share = sample_ids(labels, eligible, sample_rows, positive_share)
    picked = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
                  .join(F.broadcast(ids), "doc_id"))   # at most about sample_rows ids
    sample = picked.mapInArrow(_featurize, "doc_id long, y int, idx array<int>").withColumn("at", F.monotonically_increasing_id())
    # a task trains on the bounded sample, the driver gets one float a bucket: what it would need for the sample it keeps for all later stages
    model = sample.groupBy(F.lit(0).alias("all")).applyInArrow(_trained(share), "margin binary, bias double").toArrow()
    if not model.num_rows:
        return None
    return np.frombuffer(model.column("margin")[0].as_py(), dtype=np.float32), model.column("bias")[0].as_py(), share


def _trained(share: float):
    """Margins and bias from the rows ``doc_id, y, idx, at`` of the whole sample, by doc_id, then place."""
    def run(t: pa.Table) -> pa.Table:
        order = np.lexsort((t.column("at").to_numpy(), t.column("doc_id").to_numpy()))
        y = t.column("y").to_numpy()[order].astype(np.int64)
        views = [i.values.to_numpy() for i in t.column("idx")]         # into the table, not copies
        idx = [views[r] for r in order]
        tf = [np.full(1 if len(i) else 0, 1 / max(PAD, len(i)), dtype=np.float32) for i in idx]
        margin, bias = train(idx, tf, y, share)
        return pa.table({"margin": pa.array([margin.tobytes()], pa.binary()), "bias": pa.array([bias], pa.float64())})
    return run


def _scores(texts, model) -> np.ndarray:
    if model is None:
        return np.zeros(len(texts))
    margin, bias, empty = model
    s = np.empty(len(texts))
    for k, text in enumerate(texts):
        f = features(text)
        z = margin[f].sum(dtype=np.float64) / max(PAD, len(f)) + bias
        s[k] = 1 / (1 + np.exp(-np.clip(z, -500, 500))) if len(f) else empty
    return s


def score(docs: DataFrame, model, threshold: float = 0.3) -> DataFrame:
    """``doc_id, score, predicted`` of every document."""
    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])
        for b in batches:
            s = _scores(b.column("text").to_pylist(), model)
            yield pa.record_batch([b.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], schema=schema)

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
                .mapInArrow(run, "doc_id long, score double, predicted int"))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, all columns as they are."""
    model = fit(docs, labels, ~held_out())

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(_scores(b.column("text").to_pylist(), model) < threshold))

    return docs.mapInArrow(run, docs.schema)


def held_out(remainder: int = 2, of: int = 4):
    """Rows never learned from: crc32 of the doc_id as text leaves this remainder."""
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return F.pmod(crc, F.lit(of)) == remainder


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    out = score(docs, fit(docs, labels, ~held_out()))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
