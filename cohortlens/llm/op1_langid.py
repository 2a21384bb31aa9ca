r"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are character 1- to 3-grams over the letters of a text (lower-cased, every run
of other characters is one space), hashed into ``BUCKETS``.  Document frequencies are
counted over all documents that may be learned from.  The model is fitted in numpy on a
bounded sample of them (about ``SAMPLE_ROWS``, spread evenly over the languages, chosen
by a hash of doc_id, texts read whole) by follow-the-regularised-leader with elastic-net
penalties (the L1 part keeps the weights sparse); a held-back fifth of the sample sets
one temperature that calibrates the probabilities.

Defined results: a null text or one without a letter is ``und`` with score 0, and so is every
text when there is nothing to learn from; an empty table gives no rows; repeated rows
are predicted alike; equal probabilities give the first language by name; extra
columns are ignored.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortlens.llm.textops import CHUNK, codepoints, mix

BUCKETS = 1 << 14
SAMPLE_ROWS = 3000
UNDETERMINED = "und"

_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """Code point (BMP) to its lower case if it is a letter, else to a space."""
    global _letters
    if _letters is None:
        t = np.full(1 << 16, 32, dtype=np.uint32)
        for i in range(1 << 16):
            c = chr(i)
            if unicodedata.category(c)[0] == "L":
                low = c.lower()
                t[i] = ord(low) if len(low) == 1 else i
        _letters = t
    return _letters


def _folded(cp: np.ndarray) -> np.ndarray:
    t = letter_table()
    c = t[np.minimum(cp, 0xFFFF)]
    high = cp >= 0x10000
    if high.any():
        c[high] = [x if unicodedata.category(chr(x))[0] == "L" else 32 for x in cp[high]]
    return c


def counts(text: str | None) -> np.ndarray | None:
    """n-gram counts per bucket; None for a text without letters.  Long texts are counted in pieces."""
    if not text:
        return None
    cp, total, some = codepoints(text), None, False
    for at in range(0, len(cp), CHUNK):
        c = _folded(cp[at:at + CHUNK + 2])     # two code points over: no n-gram is lost at a seam
        letter = c != 32
        if not letter.any():
            continue
        some = True
        keep = letter.copy()
        keep[1:] |= letter[:-1]                # one space per gap
        c = np.concatenate(([32], c[keep], [32])).astype(np.uint64)
        uni, bi = c[1:-1], c[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[1:]
        tri = bi[:-1] * np.uint64(0xD6E8FEB86659FD93) + c[2:]
        h = np.concatenate((mix(uni), mix(bi + np.uint64(2)), mix(tri + np.uint64(3)))) & np.uint64(BUCKETS - 1)
        n = np.bincount(h.astype(np.int64), minlength=BUCKETS)
        total = n if total is None else total + n
    return total if some else None


def may_learn(remainder: int = 1, of: int = 3):
    """Rows that may be learned from: crc32 of the doc_id as text does not leave this remainder."""
    return ~held_out(remainder, of) & F.col("lang").isNotNull() & F.col("text").isNotNull()


def held_out(remainder: int = 1, of: int = 3):
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return F.pmod(crc, F.lit(of)) == remainder


def _df(batches):
    """One task's document frequencies per bucket, and its number of documents at bucket -1."""
    df, n = np.zeros(BUCKETS, dtype=np.int64), 0
    for b in batches:
        for text in b.column("text").to_pylist():
            c = counts(text)
            if c is not None:
                df += c > 0
                n += 1
    at = np.flatnonzero(df)
    yield pa.record_batch([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["bucket", "df"])


def _sparse(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("idx", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))])
    for b in batches:
        idx, n, keep = [], [], []
        for k, text in enumerate(b.column("text").to_pylist()):
            c = counts(text)
            if c is not None:
                i = np.flatnonzero(c)
                idx.append(i.astype(np.int32))
                n.append(c[i].astype(np.int32))
                keep.append(k)
        b = b.take(pa.array(keep, pa.int64()))
        yield pa.record_batch([b.column("doc_id"), b.column("lang"), pa.array(idx, pa.list_(pa.int32())),
                               pa.array(n, pa.list_(pa.int32()))], schema=schema)


def ftrl(rows, y, k: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 2e-4, l2: float = 1e-4, epochs: int = 4, seed: int = 3):
    """Weights ``(BUCKETS + 1, k)``, the last row the bias, by FTRL-proximal with elastic net.

    ``rows`` are ``(idx, x)`` of unit length; the penalties are per example.
    """
    rng = np.random.default_rng(seed)
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))
    seen, order = 0, np.arange(len(rows))

    def weights(i):
        zi = z[i]
        step = (beta + np.sqrt(n[i])) / alpha + l2 * seen
        return np.where(np.abs(zi) <= l1 * seen, 0.0, -(zi - np.sign(zi) * l1 * seen) / step)

    for _ in range(epochs):
        rng.shuffle(order)
        for r in order:
            i, x = np.append(rows[r][0], BUCKETS), np.append(rows[r][1], 1.0)
            w = weights(i)
            logit = x @ w
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[y[r]] -= 1
            g = x[:, None] * p
            g2 = g * g
            z[i] += g - (np.sqrt(n[i] + g2) - np.sqrt(n[i])) / alpha * w
            n[i] += g2
            seen += 1
    return weights(np.arange(BUCKETS + 1))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature that minimises the cross entropy against smoothed targets (golden-section
    search on its logarithm); the smoothing keeps a held-back set without errors from driving it to 0."""
    n, k = logits.shape
    target = np.full((n, k), 1 / ((n + 2) * (k - 1)))
    target[np.arange(n), y] = (n + 1) / (n + 2)

    def nll(t):
        s = logits / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return -(target * (s - np.log(np.exp(s).sum(axis=1, keepdims=True)))).sum(axis=1).mean()

    a, b, g = -4.0, 4.0, (5 ** 0.5 - 1) / 2
    while b - a > 1e-3:
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if nll(c) <= nll(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(docs: DataFrame, eligible, sample_rows: int = SAMPLE_ROWS):
    """``(languages, idf, weights, temperature)``; None when there is nothing to learn from."""
    rows = docs.where(eligible).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    per_lang = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}   # one row per language
    langs = sorted(per_lang)
    if not langs:
        return None
    df, n_docs = np.zeros(BUCKETS), 0
    for r in rows.select("text").mapInArrow(_df, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect():
        if r.bucket < 0:
            n_docs = r.df
        else:
            df[r.bucket] = r.df
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    want = max(1, sample_rows // len(langs))
    u = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("langid")), F.lit(1_000_000))
    take = F.lit(False)
    for lang, n in per_lang.items():
        take = take | ((F.col("lang") == F.lit(lang)) & (u < int(np.ceil(1_000_000 * want / n))))
    t = rows.where(take).mapInArrow(_sparse, "doc_id long, lang string, idx array<int>, n array<int>").toArrow()
    if not t.num_rows:
        return None
    order = np.argsort(t.column("doc_id").to_numpy(), kind="stable")
    li, ln = t.column("idx").combine_chunks(), t.column("n").combine_chunks()
    off, vi, vn = li.offsets.to_numpy(), li.values.to_numpy(), ln.values.to_numpy()
    at = {lang: i for i, lang in enumerate(langs)}
    y = np.array([at[x] for x in t.column("lang").to_pylist()])[order]
    x = []
    for r in order:
        i = vi[off[r]:off[r + 1]]
        v = vn[off[r]:off[r + 1]] * idf[i]
        x.append((i, v / np.linalg.norm(v)))
    check = np.arange(len(y)) % 5 == 4
    fit_on = np.flatnonzero(~check) if check.any() else np.arange(len(y))
    w = ftrl([x[r] for r in fit_on], y[fit_on], len(langs))
    held = np.flatnonzero(check)
    t_ = temperature(np.array([x[r][1] @ w[x[r][0]] + w[-1] for r in held]), y[held]) if len(held) and len(langs) > 1 else 1.0
    return langs, idf, w, t_


def predict(docs: DataFrame, model) -> DataFrame:
    """``doc_id, lang_pred, score`` of every document."""
    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
        for b in batches:
            lang, score = [], []
            for text in b.column("text").to_pylist():
                c = counts(text) if model is not None else None
                if c is None:
                    lang.append(UNDETERMINED)
                    score.append(0.0)
                    continue
                langs, idf, w, temp = model
                i = np.flatnonzero(c)
                v = c[i] * idf[i]
                s = (v @ w[i] / np.linalg.norm(v) + w[-1]) / temp
                p = np.exp(s - s.max())
                k = int(p.argmax())
                lang.append(langs[k])
                score.append(float(p[k] / p.sum()))
            yield pa.record_batch([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], schema=schema)

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
                .mapInArrow(run, "doc_id long, lang_pred string, score double"))


def language_id(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document."""
    out = predict(docs, fit(docs, may_learn()))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
