r"""Line dedup by distinct-site spread.

A line (``\n``-split, with at least one word) that appears on ``min_sites`` or more distinct
sites is boilerplate.  Sites are counted by one HyperLogLog sketch per line
hash, merged by aggregation.  Lines whose estimate is clearly below the threshold are
done; lines near it (within ``Z`` standard errors) get an exact distinct count; lines clearly
above it are boilerplate.  Of a boilerplate line the first occurrence (smallest doc_id,
then position) stays, so no text is lost from the corpus; every other
occurrence is removed.

All of it runs on DataFrame functions.  Lines travel as 96 bits of hash, never as text; the only
join that carries texts is the last one, by doc_id.

Defined results: a null text stays null, with 0 lines; a null source is a site of its own; lines
without a word are never removed; a row without doc_id counts towards the
spread but keeps its lines; rows that repeat a doc_id each keep the first occurrences of that
id; an empty table gives no rows; columns of the input pass through (a column named like
an output is replaced).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortlens.session import materialize

MIN_SITES = 4                   # whole passages of a few documents reach it also when one source holds a third of all rows
CONTRACT_SITES = MIN_SITES      # of the registered query and the pipeline
LG_K = 12                       # HyperLogLog registers: 2^12, standard error 1.04 / 2^6
STANDARD_ERROR = 1.04 / 2 ** (LG_K / 2)
Z = 4
NULL_SITE = "\u0000"
WORD = r"[^\x20\x09-\x0D]"


def line_sites(docs: DataFrame) -> DataFrame:
    """``(id, th, site, pos, h, h2)``: one row per line with a word; ``th`` is a hash of the whole text."""
    lines = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("th"), F.coalesce(F.col("source"), F.lit(NULL_SITE)).alias("site"),
                        F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return (lines.where(F.col("line").rlike(WORD))
                 .select("id", "th", "site", "pos", F.xxhash64("line").alias("h"), F.crc32(F.col("line").cast("binary")).alias("h2")))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``(h, h2, id, pos)``: the lines of wide spread and the first occurrence of each."""
    lines = line_sites(docs)
    low = min(min_sites - 1, int(min_sites * (1 - Z * STANDARD_ERROR)))
    high = max(min_sites + 1, int(min_sites * (1 + Z * STANDARD_ERROR)) + 1)
    spread = lines.groupBy("h", "h2").agg(
        F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "pos"))).alias("first"))
    wide = materialize(spread.withColumn("sites", F.hll_sketch_estimate("sketch")).where(F.col("sites") >= low)
                             .select("h", "h2", "sites", "first"))
    near = wide.where(F.col("sites") <= high)
    exact = (lines.join(near.select("h", "h2"), ["h", "h2"], "left_semi")
                  .groupBy("h", "h2").agg(F.count_distinct("site").alias("exact")).where(F.col("exact") >= min_sites))
    sure = wide.where(F.col("sites") > high)
    return (sure.select("h", "h2", "first").union(near.join(exact, ["h", "h2"]).select("h", "h2", "first"))
                .select("h", "h2", "first.id", "first.pos"))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Every row of ``docs`` with its boilerplate lines removed, and ``n_lines``, ``n_removed``."""
    out = _cleaned(docs.drop("n_lines", "n_removed"), min_sites)
    return out.withColumnRenamed("_n_lines", "n_lines").withColumnRenamed("_n_removed", "n_removed")


def _cleaned(docs: DataFrame, min_sites: int) -> DataFrame:
    wide = boilerplate(docs, min_sites).select("h", "h2", F.col("id").alias("id0"), F.col("pos").alias("pos0"))
    drop = (line_sites(docs).join(wide, ["h", "h2"])
            .where(F.col("id").isNotNull() & ~((F.col("id") == F.col("id0")) & (F.col("pos") == F.col("pos0"))))
            .select("id", "th", "pos").distinct().groupBy(F.col("id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_list("pos").alias("_drop")))
    lines = F.split("text", "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_drop"))
    same = (F.col("_id0") == F.col("_id")) & (F.col("_th0") == F.col("_th"))     # a repeated doc_id with another text is another row
    out = (docs.withColumn("_id0", F.col("doc_id").cast("long")).withColumn("_th0", F.xxhash64("text")).join(drop, same, "left")
               .withColumn("_n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)))
               .withColumn("_n_removed", F.when(F.col("_drop").isNull() | F.col("text").isNull(), 0).otherwise(F.size("_drop"))))
    cleaned = F.when(F.col("_drop").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    return out.withColumn("text", cleaned).drop("_id", "_id0", "_th", "_th0", "_drop")


def without_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with cleaned texts (and their lengths); a row whose every word was boilerplate that
    stays elsewhere goes, all others stay."""
    out = _cleaned(docs, min_sites).where((F.col("_n_removed") == 0) | F.col("text").rlike(WORD))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
