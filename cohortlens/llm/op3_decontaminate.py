r"""Benchmark decontamination with SimHash windows and multi-index Hamming blocks.

Words are the runs of letters and digits of the lower-cased text; shingles are ``K`` words
(an item of fewer words is one shingle of them all).  A document leaks an item when
some window of the item's number of words (the whole document if it is shorter) has
weighted shingle similarity ``sum min(c_w, c_i) / sum max(c_w, c_i) >= threshold``
with it, ``c`` counting occurrences.

1. Every shingle of every document meets the items' rarest shingles in an equi-join.  A window at
   the threshold holds at least ``ceil(threshold * m)`` of an item's ``m`` shingles, so it holds one of any
   ``m - ceil(threshold * m) + 1`` of them; those that the fewest items have are taken.  Only windows of the item's size
   around such hits go on, each with the items it shares one with; nothing else is skipped.
2. Each of these windows gets a 64-bit SimHash of its counted shingles; so does each item.
3. The 64 bits are cut into ``RADIUS + 1`` blocks and windows meet their items on equal
   blocks: within Hamming distance ``RADIUS`` at least one block is equal, so no
   fingerprint within the radius is missed.  Blocks of 3 bits alone would let most windows meet most items of
   their size; the shared shingle is the other half of the key.  At similarity 0.8 the distance is 9.7 bits on average
   with a deviation of 2.9; the radius of 20 leaves out about 2 windows in 10,000 at the
   threshold itself and practically none above it.
4. Survivors are verified by the exact weighted similarity.

All of it runs on DataFrame functions.  Texts are keyed by a 64-bit hash, so copies are searched once.

Defined results: a null or empty text, or one without words, leaks nothing; neither does an
empty benchmark or an item without words; repeated documents give repeated results, repeated items
count once, an item id with several texts is several items; of equally similar windows the first is reported; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cohortlens.session import materialize

K = 5
THRESHOLD = 0.8
RADIUS = 20
BITS = 64
BROADCAST_IDS = 1_000_000     # text hashes (8 bytes each) that may be broadcast; more are joined by shuffle
_LANES, _WIDTH = 2, 31        # bit counters packed into one long: more shingles than an array can hold
_SEED = 17


def _words(text):
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _word_hashes(df: DataFrame, *keep) -> DataFrame:
    return df.select(*keep, F.transform(_words(F.col("text")), lambda w: F.xxhash64(w)).alias("wh"))


def _shingle(k: int):
    """Hashes of all windows of ``k`` words of ``wh``."""
    one = lambda i: F.xxhash64(F.lit(_SEED + k), *[F.get(F.col("wh"), i + j) for j in range(k)])
    return F.when(F.size("wh") >= k, F.transform(F.sequence(F.lit(0), F.size("wh") - k), one)).otherwise(F.array().cast("array<bigint>"))


def fingerprints(windows: DataFrame, keys: list[str]) -> DataFrame:
    """SimHash of the shingles ``s`` of each window: ``keys, m, fp`` (``m`` counts shingles)."""
    parts = [sum((F.shiftrightunsigned("s", b).bitwiseAND(F.lit(1)) * (1 << (_WIDTH * (b % _LANES)))
                  for b in range(at, min(at + _LANES, BITS))), F.lit(0)) for at in range(0, BITS, _LANES)]
    sums = windows.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"), *[F.sum(p).alias(f"_p{i}") for i, p in enumerate(parts)])
    fp = F.lit(0).cast("long")
    for b in range(BITS):
        n = F.shiftright(F.col(f"_p{b // _LANES}"), _WIDTH * (b % _LANES)).bitwiseAND(F.lit((1 << _WIDTH) - 1))
        fp = fp.bitwiseOR(F.when(n * 2 > F.col("m"), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return sums.select(*keys, "m", fp.alias("fp"))


def blocks(radius: int) -> list[tuple[int, int]]:
    """``(first bit, bits)`` of radius + 1 blocks that cover the fingerprint."""
    n = radius + 1
    cut = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cut, cut[1:])]


def _blocked(df: DataFrame, radius: int) -> DataFrame:
    parts = [F.struct(F.lit(i).alias("no"), F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << w) - 1)).alias("value"))
             for i, (a, w) in enumerate(blocks(radius))]
    return df.withColumn("block", F.explode(F.array(*parts)))


def _items(benchmark: DataFrame) -> tuple[DataFrame, DataFrame, list[int]]:
    """``id, item_id, wh, l, k`` (``item_id``: hash of id and words) of the distinct items, their shingles, and the shingle lengths in use."""
    items = _word_hashes(benchmark.where(F.col("text").isNotNull()), F.col("item_id").cast("long").alias("id")).where(F.size("wh") > 0).distinct()
    items = materialize(items.select("id", F.xxhash64("id", "wh").alias("item_id"), "wh", F.size("wh").alias("l"), F.least(F.lit(K), F.size("wh")).alias("k")))
    ks = sorted(r.k for r in items.select("k").distinct().collect())      # at most K values
    if not ks:
        return items, items, ks
    return items, materialize(_union([items.where(F.col("k") == k).select("item_id", "l", "k", F.explode(_shingle(k)).alias("s")) for k in ks])), ks


def rare_shingles(item_s: DataFrame, threshold: float) -> DataFrame:
    """``s, item_id, l, k``: the shingles of each item that the fewest items have, as many as a window at the threshold cannot all miss."""
    counted = item_s.groupBy("item_id", "l", "k", "s").agg(F.count(F.lit(1)).alias("c"))
    items_of = counted.groupBy("s").agg(F.count(F.lit(1)).alias("f"))
    upto = Window.partitionBy("item_id").orderBy("f", "s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m = F.col("l") - F.col("k") + 1
    return (counted.join(items_of, "s").withColumn("_upto", F.sum("c").over(upto))
                   .where(F.col("_upto") - F.col("c") <= m - F.ceil(F.lit(float(threshold)) * m - 1e-9)).select("s", "item_id", "l", "k"))


def leaking_texts(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """``th, item_id, similarity, start_word, n_words`` of every leaked item of every distinct text (``th``: its hash)."""
    spark = docs.sparkSession
    empty = spark.createDataFrame([], "th long, item_id long, similarity double, start_word int, n_words int")
    items, item_s, ks = _items(benchmark)
    if not ks:
        return empty
    near, windows, arrays, spans = _candidates(docs, item_s, ks, threshold, radius)
    if near is None:
        return empty

    # exact weighted similarity of the survivors
    kept = windows.join(near.select("th", "l", "w").distinct(), ["th", "l", "w"], "left_semi")
    in_w = (kept.join(arrays, ["th", "k"]).select("th", "l", "w", F.explode(spans).alias("s"))
                .groupBy("th", "l", "w", "s").agg(F.count(F.lit(1)).alias("cw")))
    in_i = item_s.groupBy("item_id", "s").agg(F.count(F.lit(1)).alias("ci"))
    shared = (near.join(in_w, ["th", "l", "w"]).join(in_i, ["item_id", "s"])
                  .groupBy("th", "l", "w", "item_id", "mw", "mi").agg(F.sum(F.least("cw", "ci")).alias("both")))
    sim = F.col("both") / (F.col("mw") + F.col("mi") - F.col("both"))
    best = (shared.withColumn("sim", sim).where(F.col("sim") >= threshold)
                  .groupBy("th", "item_id", "l").agg(F.max(F.struct("sim", (-F.col("w")).alias("w"))).alias("top")))
    named = best.join(items.select(F.col("id"), "item_id"), "item_id")
    return named.select("th", F.col("id").alias("item_id"), F.round("top.sim", 6).alias("similarity"), (-F.col("top.w")).cast("int").alias("start_word"),
                        F.col("l").cast("int").alias("n_words"))


def _candidates(docs: DataFrame, item_s: DataFrame, ks: list[int], threshold: float, radius: int):
    """``near(th, l, w, mw, item_id, mi)``: windows and items within the radius; the windows, the texts' shingles and the slice of
    a window; None where no text shares a shingle."""
    stacked = lambda make: _union([make(k) for k in ks])
    known = rare_shingles(item_s, threshold)
    texts = docs.where(F.col("text").isNotNull()).select("text", F.xxhash64("text").alias("th"))
    hashed = _word_hashes(texts, "th")
    found = stacked(lambda k: hashed.select("th", F.size("wh").alias("n"), F.posexplode(_shingle(k)).alias("pos", "s")))
    hits = materialize(found.join(known, "s").groupBy("th", "item_id", "l", "k", "n").agg(F.collect_set("pos").alias("at")))
    ids = hits.select("th").distinct()
    n_ids = ids.count()
    if n_ids == 0:
        return None, None, None, None

    # the windows of an item's size around its hits, as ranges of shingles
    last = F.greatest(F.lit(0), F.col("n") - F.col("l"))
    starts = F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(
        F.least(last, F.greatest(F.lit(0), p - F.col("l") + F.col("k"))), F.least(p, last)))))
    of_items = hits.select("th", "item_id", "l", "k", "n", F.explode(starts).alias("w"))
    windows = of_items.select("th", "l", "k", "n", "w").distinct()
    ids = F.broadcast(ids) if n_ids <= BROADCAST_IDS else ids
    again = _word_hashes(texts.join(ids, "th", "left_semi").dropDuplicates(["th"]), "th")
    arrays = materialize(stacked(lambda k: again.select("th", F.lit(k).alias("k"), _shingle(k).alias("hs"))))
    spans = F.slice("hs", F.col("w") + 1, F.least(F.col("l"), F.col("n")) - F.col("k") + 1)
    spread = windows.join(arrays, ["th", "k"]).select("th", "l", "w", F.explode(spans).alias("s"))
    fps = fingerprints(spread, ["th", "l", "w"])
    item_fp = fingerprints(item_s, ["item_id", "l"])

    a = (_blocked(of_items.join(fps, ["th", "l", "w"]), radius)
         .select("th", "item_id", "l", "w", F.col("m").alias("mw"), F.col("fp").alias("x"), "block"))
    b = _blocked(item_fp, radius).select("item_id", F.col("m").alias("mi"), F.col("fp").alias("y"), "block")
    near = (a.join(b, ["item_id", "block"]).where(F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= radius)
             .select("th", "l", "w", "mw", "item_id", "mi").distinct())
    return materialize(near), windows, arrays, spans


def leaks(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """``doc_id, item_id, similarity, start_word, n_words`` of every leaked item of every document."""
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"))
                .join(leaking_texts(docs, benchmark, **kw), "th")
                .select("doc_id", "item_id", "similarity", "start_word", "n_words"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs`` that leak nothing, all columns as they are."""
    bad = materialize(leaking_texts(docs, benchmark, **kw).select(F.col("th").alias("_th")).distinct())
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_IDS else bad
    return docs.withColumn("_th", F.xxhash64("text")).join(bad, "_th", "left_anti").drop("_th")
