r"""Ranked lexical search by a hybrid of term-at-a-time and document-at-a-time evaluation.

All documents are ranked for each item of a query table.  Terms are the maximal runs of ASCII letters and digits
and of characters from U+0080 on, ASCII letters lower-cased.  Weights and scores are integers: a term's weight is
``floor(1000 ln((2N + 2) / (2 df + 1)))``, a document's length norm ``m = 25 + (75 n N) div L``, and the
score the sum over the item's terms (repeats included) of ``w * ((10^9 tf) div (1000 tf + 8 m))``.

1. **Postings.**  One pass over all whole texts stores, per document, its length and the frequencies of
   the items' terms.  ``N``, ``L`` and every term's ``df`` are aggregates of that table.
2. **Search.**  The stored table is searched partition by partition, in blocks of ``BLOCK`` documents, each
   with its own inverted lists and the greatest contribution of each list in the block.  For an item

   * *short lists* (up to ``SHORT`` of the block's documents) are summed term at a time into accumulators;
   * the accumulators then are one more iterator, bounded by their greatest sum, beside the *long lists*
     (bounded by their greatest contribution): in order of their bounds, those that together cannot lift a
     document to the item's present tenth score are only probed, by skipping to the candidates that the
     others produce, and a candidate is left as soon as its bound falls short.  A block whose bounds together
     fall short is skipped whole.

   Bounds are exact integers and a candidate stays while it can tie, so nothing that belongs to the result is lost.
3. **Merge.**  Each partition returns its ten best per item; the best ten of these are the result.  No
   list, however frequent its term, is ever gathered: a hot term is spread like the documents.

The item table is worked off in batches of about ``BATCH_TERMS`` (item, term) pairs, which bounds what is
broadcast; any number of items is answered in full.

Defined results: a null or empty text, or one without terms, is never found and does not count for ``N``;
repeated rows are documents of their own (equal scores by ascending doc_id, null ids last); an item's rows that
repeat id and text count once, different texts under one id are one query of all their terms; items without
terms and empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cohortlens.session import Scratch

TOP = 10
BLOCK = 16_384           # documents searched at once
SHORT = 1 / 32           # lists up to this share of a block's documents are summed into accumulators
BATCH_TERMS = 500_000    # (item, term) pairs broadcast at once
_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_KEEP).split() if text else []


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, term, q``: the terms of every item and how often each occurs."""
    def run(batches):
        for b in batches:
            ids, ts, qs = [], [], []
            for i, text in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist()):
                for t, q in Counter(terms(text)).items():
                    ids.append(i)
                    ts.append(t)
                    qs.append(q)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(ts, pa.binary()), pa.array(qs, pa.int64())], names=["item_id", "term", "q"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    return rows.mapInArrow(run, "item_id long, term binary, q long").groupBy("item_id", "term").agg(F.sum("q").alias("q"))


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, tids, tfs`` of every document with a term: its length, and the frequencies of the vocabulary's terms in it."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("tids", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64()))])

    def run(batches):
        get = known.value.get
        for b in batches:
            ids, ns, at, tids, tfs = [], [], [0], [], []
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                found = terms(text)
                if not found:
                    continue
                for t, c in Counter(found).items():
                    k = get(t)
                    if k is not None:
                        tids.append(k)
                        tfs.append(c)
                ids.append(i)
                ns.append(len(found))
                at.append(len(tids))
            lists = (pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(v, t)) for v, t in ((tids, pa.int32()), (tfs, pa.int64())))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), *lists], schema=schema)

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
                .mapInArrow(run, "doc_id long, n long, tids array<int>, tfs array<long>"))


class Block:
    """Inverted lists of some documents: local document numbers and contributions by term, and each list's greatest contribution."""

    def __init__(self, n: np.ndarray, at: np.ndarray, tids: np.ndarray, tfs: np.ndarray, weight: np.ndarray, n_docs: int, total: int):
        doc = np.repeat(np.arange(len(n), dtype=np.int64), np.diff(at))
        order = np.argsort(tids, kind="stable")
        self.size, self.doc, tid = len(n), doc[order], tids[order]
        m = 25 + (75 * n * n_docs) // total
        tf = tfs[order]
        self.gain = weight[tid] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[self.doc]))
        present, first = np.unique(tid, return_index=True)
        self.lo = np.zeros(len(weight), dtype=np.int64)
        self.hi = np.zeros(len(weight), dtype=np.int64)
        self.most = np.zeros(len(weight), dtype=np.int64)
        self.lo[present], self.hi[present] = first, np.append(first[1:], len(tid))
        self.most[present] = np.maximum.reduceat(self.gain, first) if len(first) else 0

    def search(self, tids: np.ndarray, q: np.ndarray, least: int, short: int, scores: np.ndarray) -> np.ndarray:
        """Numbers of the documents whose score is ``least`` or more; ``scores`` comes zeroed and holds their scores
        afterwards (the caller clears it at ``self.touched``)."""
        size = self.hi[tids] - self.lo[tids]
        tids, q, size = tids[size > 0], q[size > 0], size[size > 0]
        if not len(tids) or int((q * self.most[tids]).sum()) < least:
            return np.zeros(0, dtype=np.int64)
        few = size <= short
        # term at a time: the short lists' sums
        own: list[tuple[int, np.ndarray, np.ndarray]] = []
        if few.any():
            doc = np.concatenate([self.doc[self.lo[t]:self.hi[t]] for t in tids[few]])
            gain = np.concatenate([x * self.gain[self.lo[t]:self.hi[t]] for t, x in zip(tids[few], q[few].tolist())])
            np.add.at(scores, doc, gain)
            docs = np.unique(doc)
            sums = scores[docs]
            scores[docs] = 0
            own.append((int(sums.max()), docs, sums))
        # document at a time: the accumulators are one iterator among the long lists
        for t, x in zip(tids[~few].tolist(), q[~few].tolist()):
            lo, hi = self.lo[t], self.hi[t]
            own.append((x * int(self.most[t]), self.doc[lo:hi], x * self.gain[lo:hi]))
        own.sort(key=lambda e: e[0])
        reach = np.cumsum([e[0] for e in own])
        if reach[-1] < least:
            return np.zeros(0, dtype=np.int64)
        cut = int(np.searchsorted(reach, least))         # lists before it together stay below ``least``
        for _, docs, gains in own[cut:]:
            scores[docs] += gains
        touched = np.unique(np.concatenate([docs for _, docs, _ in own[cut:]]))
        cand = touched
        for j in range(cut - 1, -1, -1):
            cand = cand[scores[cand] + int(reach[j]) >= least]
            if not len(cand):
                break
            _, docs, gains = own[j]
            at = np.minimum(np.searchsorted(docs, cand), len(docs) - 1)      # skip to the candidates
            hit = docs[at] == cand
            scores[cand[hit]] += gains[at[hit]]
        self.touched = touched
        return cand[scores[cand] >= least]


def _best(ids: list, scores: list, top: int) -> list[tuple[int, bool, int]]:
    """Keys ``(-score, null id, id)`` of the best, in order."""
    return sorted(zip([-s for s in scores], [i is None for i in ids], [i or 0 for i in ids]))[:top]


def _searcher(plan, n_docs: int, total: int, top: int, block: int, share: float):
    schema = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        weight, items = plan.value
        best: list[list[tuple[int, bool, int]]] = [[] for _ in items]

        def work(held):
            rows = pa.Table.from_batches(held).combine_chunks()
            if not rows.num_rows:
                return
            col = lambda c: rows.column(c).chunk(0)
            off = col("tids").offsets.to_numpy().astype(np.int64)
            tids, tfs = (col(c).values.to_numpy()[off[0]:off[-1]].astype(np.int64) for c in ("tids", "tfs"))
            ids = col("doc_id").to_pylist()
            b = Block(col("n").to_numpy().astype(np.int64), off - off[0], tids, tfs, weight, n_docs, total)
            scores = np.zeros(b.size, dtype=np.int64)
            for k, (_, ts, q) in enumerate(items):
                held_ = best[k]
                least = max(1, -held_[-1][0]) if len(held_) == top else 1
                b.touched = None
                found = b.search(ts, q, least, max(64, int(b.size * share)), scores)
                if len(found):
                    s = scores[found]
                    if len(found) > top:
                        floor = np.partition(s, len(s) - top)[len(s) - top]
                        found, s = found[s >= floor], s[s >= floor]
                    best[k] = sorted(held_ + _best([ids[i] for i in found.tolist()], s.tolist(), top))[:top]
                if b.touched is not None:
                    scores[b.touched] = 0

        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= block:
                work(held)
                held, n = [], 0
        if held:
            work(held)
        out = [(items[k][0], None if none else i, -s) for k, keys in enumerate(best) for s, none, i in keys]
        yield pa.record_batch([pa.array([r[c] for r in out], pa.int64()) for c in range(3)], schema=schema)
    return run


def _ranked(found: DataFrame, keys: list[str], top: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block: int = BLOCK, short: float = SHORT,
           batch_terms: int = BATCH_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``top`` documents of highest score."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "search")
    queries = scratch.keep(item_terms(items))
    batches = -(-queries.count() // batch_terms)
    results = []
    for k in range(batches):
        rows = queries.where(F.pmod(F.xxhash64("item_id"), F.lit(batches)) == k).collect()     # about batch_terms rows
        vocabulary = {t: i for i, t in enumerate(sorted({bytes(r.term) for r in rows}))}
        found = scratch.keep(postings(docs, vocabulary))
        size = found.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
        if not size.n:
            break
        weight = np.zeros(len(vocabulary), dtype=np.int64)
        for r in found.select(F.explode("tids").alias("t")).groupBy("t").count().collect():     # at most the vocabulary
            weight[r.t] = term_weight(size.n, r["count"])
        by_item: dict[int | None, list[tuple[int, int]]] = {}
        for r in rows:
            by_item.setdefault(r.item_id, []).append((vocabulary[bytes(r.term)], r.q))
        plan = spark.sparkContext.broadcast((weight, [(i, *np.array(ts, dtype=np.int64).T.copy()) for i, ts in by_item.items()]))
        near = found.mapInArrow(_searcher(plan, size.n, size.l, top, block, short), "item_id long, doc_id long, score long")
        # two levels, so no task gathers what all partitions found for an item
        near = _ranked(near.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64))), ["item_id", "part"], top)
        results.append(scratch.keep(_ranked(near.drop("rank", "part"), ["item_id"], top).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")))
        scratch.drop(found)
    scratch.drop(queries)
    if not results:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = results[0]
    for r in results[1:]:
        out = out.union(r)
    return out
