"""Exact quantiles and modes per group without buffering a group in one task.

Spark's exact ``percentile`` and ``mode`` aggregates keep a map of every
distinct value of a group in one buffer; a group holding a third of all rows
then lands in one task's memory.  Here both are built from partial
aggregates, small broadcast tables and windows over bounded slices:

* values are first counted per (group, value) -- duplicates collapse;
* ``percentile_approx`` cuts each group's distinct values into buckets (the
  cut only balances the work, results stay exact);
* bucket totals (one row per group and bucket) give each bucket's first
  rank, so the bucket holding a target rank is known;
* only those buckets are ranked, with a running count window per
  (group, bucket).

Quantiles use linear interpolation between the two closest ranks (the
definition of Spark ``percentile``, DuckDB ``quantile_cont`` and pandas).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cohortlens.session import materialize

BUCKETS = 64


def value_counts(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return (df.where(F.col(value).isNotNull())
              .groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n")))


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs: list[float],
                    buckets: int = BUCKETS) -> DataFrame:
    """``(by..., p, quantile)`` for every group and probability (nulls ignored).

    The group columns travel as one struct key, so null group values form a
    group of their own (as in ``groupBy``) and every join is an equi-join.
    """
    grp = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("_all"))
    out = _quantiles(df.select(grp.alias("_grp"), F.col(value).alias("_val")), ["_grp"], "_val", probs, buckets)
    return out.select(*[F.col(f"_grp.{c}").alias(c) for c in by], "p", "quantile")


def _quantiles(df: DataFrame, by: list[str], value: str, probs: list[float], buckets: int) -> DataFrame:
    cv = materialize(value_counts(df, by, value))   # read by the cut, the totals and the ranking
    cuts = [i / buckets for i in range(1, buckets)]
    bounds = cv.groupBy(*by).agg(F.percentile_approx(value, cuts, 10_000).alias("_bnd"))
    cb = (cv.join(F.broadcast(bounds), by)
            .withColumn("_bk", F.size(F.filter("_bnd", lambda b: b < F.col(value)))).drop("_bnd"))
    btot = cb.groupBy(*by, "_bk").agg(F.sum("_n").alias("_bt"))
    w = Window.partitionBy(*by).orderBy("_bk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bt = (btot.withColumn("_end", F.sum("_bt").over(w))
              .withColumn("_start", F.col("_end") - F.col("_bt"))
              .withColumn("_N", F.sum("_bt").over(Window.partitionBy(*by))))
    # target ranks (0-based) per group and probability: floor and ceil of (N - 1) p
    ps = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p")
    tgt = (bt.select(*by, "_N").distinct().select(*by, "_N", ps)
             .withColumn("_h", (F.col("_N") - 1) * F.col("p"))
             .select(*by, "p", "_h", F.explode(F.array(F.floor("_h").cast("long"), F.ceil("_h").cast("long"))).alias("_r")))
    # the bucket that holds each target rank (small tables: groups x buckets, groups x probs)
    tb = (tgt.join(bt.select(*by, "_bk", "_start", "_end"), by)
             .where((F.col("_start") <= F.col("_r")) & (F.col("_r") < F.col("_end")))
             .select(*by, "p", "_h", "_r", "_bk", "_start"))
    need = tb.select(*by, "_bk").distinct()
    wv = Window.partitionBy(*by, "_bk").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (cb.join(F.broadcast(need), by + ["_bk"], "left_semi")
                .withColumn("_cum", F.sum("_n").over(wv))
                .withColumn("_first", F.col("_cum") - F.col("_n")))
    # value at rank r: the row of its bucket with _first <= r - start < _cum
    at = (tb.join(ranked.select(*by, "_bk", value, "_first", "_cum"), by + ["_bk"])
            .where((F.col("_first") <= F.col("_r") - F.col("_start")) & (F.col("_r") - F.col("_start") < F.col("_cum")))
            .select(*by, "p", "_h", "_r", F.col(value).cast("double").alias("_v")))
    agg = at.groupBy(*by, "p", "_h").agg(
        F.min_by("_v", "_r").alias("_lo"), F.max_by("_v", "_r").alias("_hi"), F.min("_r").alias("_rl"))
    q = F.col("_lo") + (F.col("_h") - F.col("_rl")) * (F.col("_hi") - F.col("_lo"))
    return agg.select(*by, "p", q.alias("quantile"))


def exact_mode(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """``(by..., mode)``: most frequent non-null value, smallest on ties.

    Two hash aggregations (counts, then the maximum count) and one join; no
    group's values are ever buffered together.
    """
    grp = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("_all"))
    cv = materialize(value_counts(df.select(grp.alias("_grp"), F.col(value).alias("_val")), ["_grp"], "_val"))
    top = cv.groupBy("_grp").agg(F.max("_n").alias("_m"))
    out = (cv.join(top, "_grp").where(F.col("_n") == F.col("_m"))
             .groupBy("_grp").agg(F.min("_val").alias("mode")))
    return out.select(*[F.col(f"_grp.{c}").alias(c) for c in by], "mode")


def quantile_columns(df: DataFrame, by: list[str], value: str, named: dict[str, float],
                     buckets: int = BUCKETS) -> DataFrame:
    """``(by..., name...)``: one column per named probability."""
    qs = exact_quantiles(df, by, value, list(named.values()), buckets)
    grp = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("_all"))
    out = qs.select(grp.alias("_grp"), "p", "quantile").groupBy("_grp").agg(
        *[F.max(F.when(F.col("p") == F.lit(float(p)), F.col("quantile"))).alias(n) for n, p in named.items()])
    return out.select(*[F.col(f"_grp.{c}").alias(c) for c in by], *named)
