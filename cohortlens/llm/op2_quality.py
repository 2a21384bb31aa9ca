r"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Words are the runs of ``[^\x20\x09-\x0D]``; features are their unigrams and bigrams, hashed by
CRC-32 into ``BUCKETS``.  Two multinomials are counted over all documents: the raw corpus (every text)
and the target (texts with a trusted quality label), the latter smoothed towards the raw one by
``ALPHA`` pseudo-counts per bucket, so little evidence means a ratio near 1.  A text scores the mean over
its features of ``ln p_target - ln p_raw`` and is kept when that reaches ``THRESHOLD``.  Log
ratios are rounded to millionths and summed as integers, so the verdict of every document is the same
in any order of summation.

Before the ratio, two base rules fail a text: fewer than ``MIN_WORDS`` words, or more than
``MAX_REPEAT_PCT`` per cent of its words inside 8-word windows that occur twice or more.

All of it runs on DataFrame functions; the only table that reaches the driver has ``BUCKETS`` rows.

Defined results: a null or empty text has no words and fails the base rules; without trusted
documents every ratio is 0 and the base rules decide alone; repeated rows count as often as
they occur and get equal verdicts; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

BUCKETS = 1 << 14
ALPHA = 8.0
THRESHOLD = -0.06
MIN_WORDS = 20
MAX_REPEAT_PCT = 30
WINDOW = 8
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
MICRO = 1_000_000
BROADCAST_IDS = 1_000_000     # trusted ids (8 bytes each) that may be broadcast; more are joined by shuffle


def words(text):
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def buckets(ws):
    """Bucket of every unigram and bigram of an array of words."""
    bucket = lambda s: F.crc32(s.cast("binary")).bitwiseAND(F.lit(BUCKETS - 1))
    pairs = F.zip_with(ws, F.slice(ws, F.lit(2), F.size(ws)), lambda a, b: F.when(b.isNotNull(), bucket(F.concat(a, F.lit(" "), b))))
    return F.concat(F.transform(ws, bucket), F.filter(pairs, lambda b: b.isNotNull()))


def corpus_counts(docs: DataFrame, trusted: DataFrame) -> dict[int, tuple[int, int]]:
    """Raw and target count of every bucket (at most ``BUCKETS`` rows reach the driver)."""
    ids = trusted.select(F.col("doc_id").cast("long").alias("_t")).where(F.col("_t").isNotNull()).distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("_id"), "text")
    texts = texts.join(ids, F.col("_id") == F.col("_t"), "left")
    feats = texts.select(F.col("_t").isNotNull().cast("long").alias("t"), words(F.col("text")).alias("ws"))
    rows = (feats.select("t", F.explode(buckets(F.col("ws"))).alias("b"))
                 .groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("target")).collect())
    return {r.b: (r.raw, r.target) for r in rows}


def log_ratios(counts: dict[int, tuple[int, int]]) -> list[int]:
    """``ln p_target - ln p_raw`` per bucket in millionths; all 0 without a target."""
    raw = sum(r for r, _ in counts.values())
    target = sum(t for _, t in counts.values())
    if not target:
        return [0] * BUCKETS
    out = []
    for b in range(BUCKETS):
        r, t = counts.get(b, (0, 0))
        ratio = (t + ALPHA * BUCKETS * r / raw) / ((target + ALPHA * BUCKETS) * r / raw) if r else 1.0
        out.append(int(math.floor(MICRO * math.log(ratio) + 0.5)))
    return out


def base_metrics(docs: DataFrame, *keep) -> DataFrame:
    """``keep..., ws, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    a = docs.select(*keep, "text", words(F.col("text")).alias("ws"), lines.alias("lines"))
    a = a.select(*keep, "ws", F.size("ws").cast("long").alias("n_words"),
                 F.length(F.array_join("ws", "")).cast("long").alias("word_chars"),
                 F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                 (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                 F.transform("ws", lambda w: F.xxhash64(w)).alias("wh"))
    window = lambda i: F.xxhash64(*[F.get(F.col("wh"), i + j) for j in range(WINDOW)])
    a = a.withColumn("h8", F.when(F.size("wh") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("wh") - WINDOW), window)))
    # starts of windows that occur again, in order: neighbours in the sorted windows of only those texts that have any
    a = a.withColumn("again", F.expr(
        "CASE WHEN size(array_distinct(h8)) < size(h8) THEN array_sort(transform(h8, (h, i) -> named_struct('h', h, 'i', i))) END"))
    a = a.withColumn("starts", F.expr(
        "array_sort(array_distinct(flatten(zip_with(again, slice(again, 2, size(again)), "
        "(a, b) -> CASE WHEN a.h = b.h THEN array(a.i, b.i) ELSE CAST(array() AS array<int>) END))))"))
    covered = F.expr(f"aggregate(zip_with(starts, slice(starts, 2, size(starts)), (a, b) -> least({WINDOW}, coalesce(b - a, {WINDOW}))), "
                     "0L, (x, y) -> x + y)")
    a = a.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PCT)
    return a.select(*keep, "ws", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


def quality(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Base metrics, ``log_ratio`` (sum in millionths), ``n_features`` and ``kept`` of every document.

    ``trusted(doc_id)`` names the documents of the target.
    """
    ratios = log_ratios(corpus_counts(docs, trusted))
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<bigint>")     # folds to one constant
    m = base_metrics(docs, F.col("doc_id").cast("long").alias("doc_id")).withColumn("f", buckets(F.col("ws")))
    total = F.aggregate("f", F.lit(0).cast("long"), lambda x, b: x + F.get(table, b.cast("int")))
    m = m.withColumn("log_ratio", total).withColumn("n_features", F.size("f").cast("long"))
    kept = ~F.col("base_failed") & (F.col("log_ratio") >= F.col("n_features") * int(round(threshold * MICRO)))
    return m.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    kept.alias("kept"), "log_ratio", "n_features")
