"""Cluster profiles and descriptive statistics.

Inputs are a *labelled* frame: one row per entity with a ``cluster`` column
and numeric feature columns (``align_labels(data, labels, key)``).  Wide
aggregations run once per cluster (partial aggregation map-side, one row per
cluster shuffled); results are stacked to long ``(cluster, feature, ...)``.
Quantiles and modes are exact and distributed
(:mod:`cohortlens.functions.quantiles`: no group is ever buffered in one
task); ``approx=True`` switches to ``percentile_approx`` in the wide pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType

from cohortlens.functions.frames import melt, numeric_columns, q, stack_stats, value_width
from cohortlens.functions.quantiles import exact_mode, quantile_columns
from cohortlens.functions.timefn import days_between

MAX_CLUSTERS = 100_000


def _left_join(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys where null keys match (group keys may be null)."""
    from cohortlens.operators.joins import merge_two
    return merge_two(a, b, keys, "left", null_keys_match=True)


def _long_quantiles(wide: DataFrame, by: list[str], feats: list[str], named: dict[str, float]) -> DataFrame:
    """Exact named quantiles of every feature per group: (by..., feature, name...)."""
    long = melt(wide, by, feats)
    return quantile_columns(long, by + ["feature"], "value", named)


def _share(n: str, scale: float = 100.0) -> Column:
    # Applied only to per-cluster results (one row per cluster), so the
    # un-partitioned window spans a bounded number of rows.
    return F.col(n) * F.lit(scale) / F.sum(n).over(Window.partitionBy())


def _features(df: DataFrame, features, cluster: str, key: str | None) -> list[str]:
    return list(features) if features else numeric_columns(df, exclude={cluster, key})


# ------------------------------------------------------------------------ A9
def cluster_summary(labelled: DataFrame, cluster: str = "cluster", key: str | None = "key",
                    features=None) -> DataFrame:
    """Per cluster: size, % of rows, and per feature mean/std(sample)/min/max."""
    feats = _features(labelled, features, cluster, key)
    aggs = [F.count(F.lit(1)).alias("n")]
    for f in feats:
        aggs += [F.avg(q(f)).alias(f"{f}__mean"), F.stddev_samp(q(f)).alias(f"{f}__std"),
                 F.min(q(f)).alias(f"{f}__min"), F.max(q(f)).alias(f"{f}__max")]
    g = labelled.groupBy(cluster).agg(*aggs).withColumn("percentage", _share("n"))
    return stack_stats(g, [cluster, "n", "percentage"], feats, ["mean", "std", "min", "max"])


def cluster_summary_wide(labelled: DataFrame, cluster: str = "cluster", key: str | None = "key",
                         features=None) -> DataFrame:
    """The summary as one row per cluster: count, percentage and
    ``{feature}_mean/_std/_min/_max`` columns (one wide aggregate)."""
    feats = _features(labelled, features, cluster, key)
    aggs = [F.count(F.lit(1)).alias("count")]
    for f in feats:
        aggs += [F.avg(q(f)).alias(f"{f}_mean"), F.stddev_samp(q(f)).alias(f"{f}_std"),
                 F.min(q(f)).alias(f"{f}_min"), F.max(q(f)).alias(f"{f}_max")]
    g = labelled.groupBy(cluster).agg(*aggs)
    return g.withColumn("percentage", _share("count"))


# ----------------------------------------------------------------------- A10
def cluster_profile(labelled: DataFrame, cluster: str = "cluster", key: str | None = "key",
                    features=None, approx: bool = False) -> DataFrame:
    """Per cluster and feature: mean, median, std (sample), count (non-null)."""
    feats = _features(labelled, features, cluster, key)
    aggs = []
    for f in feats:
        aggs += [F.avg(q(f)).alias(f"{f}__mean"), F.stddev_samp(q(f)).alias(f"{f}__std"),
                 F.count(q(f)).alias(f"{f}__count")]
        if approx:
            aggs.append(F.percentile_approx(q(f), 0.5, 10_000).alias(f"{f}__median"))
    g = labelled.groupBy(cluster).agg(*aggs)
    if approx:
        return stack_stats(g, [cluster], feats, ["mean", "median", "std", "count"])
    base = stack_stats(g, [cluster], feats, ["mean", "std", "count"])
    med = _long_quantiles(labelled, [cluster], feats, {"median": 0.5})
    return _left_join(base, med, [cluster, "feature"]).select(cluster, "feature", "mean", "median", "std", "count")


# ----------------------------------------------------------------------- A11
def cluster_radar(labelled: DataFrame, cluster: str = "cluster", key: str | None = "key",
                  features=None, approx: bool = False) -> DataFrame:
    """Median-impute, min-max scale over all rows, then mean per cluster.

    The global medians/min/max are one aggregate row (bounded by the number of
    features) applied as literals; constant features scale to 0.
    """
    feats = _features(labelled, features, cluster, key)
    stats = labelled.agg(*[x for f in feats for x in (
        F.min(q(f)).alias(f"{f}__min"), F.max(q(f)).alias(f"{f}__max"))]
        + ([F.percentile_approx(q(f), 0.5, 10_000).alias(f"{f}__med") for f in feats] if approx else [])).first()
    if approx:
        meds = {f: stats[f"{f}__med"] for f in feats}
    else:   # one row per feature
        meds = {r["feature"]: r["median"] for r in _long_quantiles(labelled, [], feats, {"median": 0.5}).collect()}
    cols = []
    for f in feats:
        med, lo, hi = meds.get(f), stats[f"{f}__min"], stats[f"{f}__max"]
        v = F.coalesce(q(f).cast("double"), F.lit(med))
        span = (hi - lo) if (hi is not None and lo is not None) else None
        scaled = (v - F.lit(lo)) / F.lit(span) if span else F.lit(0.0)
        cols.append(F.avg(scaled).alias(f"{f}__value"))
    g = labelled.groupBy(cluster).agg(*cols)
    return stack_stats(g, [cluster], feats, ["value"])


# ----------------------------------------------------------------------- A12
def cluster_characterization(labelled: DataFrame, cluster: str = "cluster", key: str | None = "key",
                             features=None, noise=-1, approx: bool = False) -> DataFrame:
    """Size, % of all rows, and per numeric feature mean/std/min/max/median/
    quartiles plus ``diff_from_mean`` (% from the overall mean; 0 when that
    mean is 0).  The noise label is skipped (but counts in the % base)."""
    feats = _features(labelled, features, cluster, key)
    overall = labelled.agg(F.count(F.lit(1)).alias("_n"),
                           *[F.avg(q(f)).alias(f) for f in feats]).first()
    total = overall["_n"]
    named = {"median": 0.5, "p25": 0.25, "p75": 0.75}
    aggs = [F.count(F.lit(1)).alias("size")]
    for f in feats:
        aggs += [F.avg(q(f)).alias(f"{f}__mean"), F.stddev_samp(q(f)).alias(f"{f}__std"),
                 F.min(q(f)).alias(f"{f}__min"), F.max(q(f)).alias(f"{f}__max")]
        if approx:
            aggs += [F.percentile_approx(q(f), p, 10_000).alias(f"{f}__{n}") for n, p in named.items()]
    kept = labelled.where(F.col(cluster).isNull() | (F.col(cluster) != F.lit(noise)))
    g = (kept.groupBy(cluster).agg(*aggs)
             .withColumn("percentage", F.col("size") * F.lit(100.0) / F.lit(float(total or 1))))
    stats_ = ["mean", "std", "min", "max"] + (list(named) if approx else [])
    long = stack_stats(g, [cluster, "size", "percentage"], feats, stats_)
    if not approx:
        long = _left_join(long, _long_quantiles(kept, [cluster], feats, named), [cluster, "feature"])
    om = F.create_map(*[x for f in feats for x in (F.lit(f), F.lit(overall[f]).cast("double"))])
    overall_mean = om[F.col("feature")]
    diff = F.when(overall_mean == 0, F.lit(0.0)).otherwise(
        (F.col("mean") - overall_mean) / overall_mean * F.lit(100.0))
    return long.withColumn("diff_from_mean", diff)


# ------------------------------------------------------------- A13 / A14
def length_of_stay(df: DataFrame, admit: str, disch: str, key: str | None = None) -> DataFrame:
    """Length of stay in days (seconds / 86400) per row."""
    cols = [F.col(key)] if key else []
    return df.select(*cols, days_between(admit, disch).alias("length_of_stay"))


def los_by_cluster(los: DataFrame, cluster: str = "cluster", value: str = "length_of_stay",
                   approx: bool = False) -> DataFrame:
    """Count, mean, std, min, max and quartiles (rounded to 2) of LOS per cluster."""
    v = F.col(value)
    named = {"p25": 0.25, "median": 0.5, "p75": 0.75}
    aggs = [F.count(v).alias("count"), F.avg(v).alias("mean_los"), F.stddev_samp(v).alias("std_los"),
            F.min(v).alias("min_los"), F.max(v).alias("max_los")]
    if approx:
        return los.groupBy(cluster).agg(*aggs, *[F.round(F.percentile_approx(v, p, 10_000), 2).alias(n)
                                                 for n, p in named.items()])
    qs = quantile_columns(los, [cluster], value, named)
    qs = qs.select(cluster, *[F.round(n, 2).alias(n) for n in named])
    return _left_join(los.groupBy(cluster).agg(*aggs), qs, [cluster])


# ------------------------------------------------------------- A15 / A16
def outcome_rate(df: DataFrame, cluster: str, outcome: str) -> DataFrame:
    """Mean and count of a 0/1 outcome per cluster (non-numeric values -> null)."""
    y = F.col(outcome).cast("string").try_cast("double")
    return df.groupBy(cluster).agg(F.avg(y).alias("rate"), F.count(y).alias("count"))


def contingency(df: DataFrame, row: str, col: str) -> DataFrame:
    """Cluster x outcome counts in long form ``(row, col, n)`` (non-zero cells)."""
    return df.groupBy(row, col).agg(F.count(F.lit(1)).alias("n"))


def contingency_wide(df: DataFrame, row: str, col: str, max_columns: int = 1000) -> DataFrame:
    """The crosstab itself: one row per ``row`` value, one zero-filled count
    column per ``col`` value (explicit, checked pivot list)."""
    vals = [r[0] for r in df.where(F.col(col).isNotNull()).select(col).distinct().limit(max_columns + 1).collect()]
    if len(vals) > max_columns:
        raise ValueError(f"more than {max_columns} crosstab columns")
    return df.where(F.col(col).isNotNull()).groupBy(row).pivot(col, sorted(vals)).count().na.fill(0)


# ----------------------------------------------------------------------- A17
def column_profile(df: DataFrame) -> DataFrame:
    """Per column: type, non-null count, missing % (2 dp); one aggregation."""
    total_col = "__rows"
    agg = df.agg(F.count(F.lit(1)).alias(total_col),
                 *[F.count(q(c)).alias(c) for c in df.columns])
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(types[c]).alias("dtype"),
                             q(c).alias("non_null")) for c in df.columns])
    return (agg.select(F.col(total_col).alias("rows"), F.explode(arr).alias("_c"))
               .select("_c.column_name", "_c.dtype", "_c.non_null",
                       F.round((F.col("rows") - F.col("_c.non_null")) * 100.0
                               / F.greatest(F.col("rows"), F.lit(1)), 2).alias("missing_pct")))


def column_memory(df: DataFrame) -> DataFrame:
    """Per column: type, and the bytes its values take in memory: the width of a fixed-width value, eight bytes and
    the text's own for text and binary values, the elements' for arrays; nulls take none.  One aggregation."""
    def size(f):
        c, t = q(f.name), f.dataType
        if value_width(t):
            return F.count(c) * F.lit(value_width(t))
        if isinstance(t, (StringType, BinaryType)):
            return F.coalesce(F.sum(F.octet_length(c) + F.lit(8).cast("long")), F.lit(0))
        if isinstance(t, ArrayType) and value_width(t.elementType):
            return F.coalesce(F.sum(F.when(c.isNotNull(), F.size(c) * F.lit(value_width(t.elementType)) + F.lit(8).cast("long"))), F.lit(0))
        return F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(c))) + F.lit(8).cast("long")), F.lit(0))

    agg = df.agg(*[size(f).cast("long").alias(f"_m{i}") for i, f in enumerate(df.schema.fields)])
    rows = F.array(*[F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("dtype"), F.col(f"_m{i}").alias("memory_bytes"))
                     for i, f in enumerate(df.schema.fields)])
    return agg.select(F.explode(rows).alias("c")).select("c.*")


def table_shape(df: DataFrame) -> DataFrame:
    """Total rows, columns and missing cells."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
                  reduce(lambda a, b: a + b, [F.sum(q(c).isNull().cast("bigint")) for c in df.columns])
                  .alias("n_missing"))


# ----------------------------------------------------------------------- A18
def avg_orders_by_period(timing: DataFrame) -> DataFrame:
    cols = [c for c in ("orders_in_first_24h", "orders_in_first_48h", "orders_in_first_72h") if c in timing.columns]
    return timing.agg(*[F.avg(c).alias(f"avg_{c}") for c in cols])


# ----------------------------------------------------------------------- A19
def cluster_sizes(labels: DataFrame, cluster: str = "cluster") -> DataFrame:
    return (labels.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
                  .withColumn("percentage", _share("n")))


# ----------------------------------------------------------------------- A20
def impute_stats(df: DataFrame, columns=None, approx: bool = False) -> DataFrame:
    """Mean, median and mode (smallest on ties) of every numeric column."""
    cols = list(columns) if columns else numeric_columns(df)
    means = stack_stats(df.agg(*[F.avg(q(c)).alias(f"{c}__mean") for c in cols]), [], cols, ["mean"],
                        feature_col="column_name")
    long = melt(df, [], cols, "column_name")
    if approx:
        med = long.groupBy("column_name").agg(F.percentile_approx("value", 0.5, 10_000).alias("median"))
    else:
        med = quantile_columns(long, ["column_name"], "value", {"median": 0.5})
    mode = exact_mode(long, ["column_name"], "value")
    return (means.join(med, "column_name", "left").join(mode, "column_name", "left")
                 .select("column_name", "mean", "median", "mode"))


# ----------------------------------------------------------------------- A22
def histogram(df: DataFrame, col: str, bins: int = 30, by: str | None = None) -> DataFrame:
    """Equal-width histogram over [min, max]; the maximum falls in the last bin.

    Bin ``i`` covers ``[min + i*w, min + (i+1)*w)`` with ``w = (max-min)/bins``;
    a constant column puts every value in bin 0.  Min/max come from one
    aggregate; counting is one partial+final aggregate.
    """
    mm = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    lo, hi = mm["lo"], mm["hi"]
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, bin_start double, bin_end double, n bigint")
    span = float(hi - lo)
    v = F.col(col).cast("double")
    b = F.lit(0) if span == 0 else F.least(F.floor((v - F.lit(float(lo))) / F.lit(span) * F.lit(bins)),
                                           F.lit(bins - 1)).cast("int")
    keys = ([by] if by else []) + ["bin"]
    g = df.where(F.col(col).isNotNull()).select(*([by] if by else []), b.alias("bin")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"))
    w = span / bins
    return g.select(*keys, (F.lit(float(lo)) + F.col("bin") * F.lit(w)).alias("bin_start"),
                    (F.lit(float(lo)) + (F.col("bin") + 1) * F.lit(w)).alias("bin_end"), "n")


def top_categories(df: DataFrame, col: str, n: int = 20) -> DataFrame:
    """Top-``n`` values by count with their share of non-null rows."""
    from cohortlens.operators.features import top_values
    total = df.where(F.col(col).isNotNull()).count()
    return top_values(df, col, n).withColumn("share", F.col("n") / F.lit(float(total or 1)))


def box_stats(df: DataFrame, value: str, by: str | None = None, approx: bool = False) -> DataFrame:
    """Five-number summary per group (exact linear-interpolated quartiles)."""
    v = F.col(value)
    named = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    keys = [by] if by else []
    base = [F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n")]
    if approx:
        aggs = base + [F.percentile_approx(v, p, 10_000).alias(n) for n, p in named.items()]
        out = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    else:
        agg = df.groupBy(*keys).agg(*base) if keys else df.agg(*base)
        qs = quantile_columns(df, keys, value, named)
        if keys:
            out = _left_join(agg, qs, keys)
        else:
            row = qs.first()
            out = agg.select(*agg.columns, *[F.lit(row[n] if row else None).cast("double").alias(n) for n in named])
    return out.select(*keys, "min", "q1", "median", "q3", "max", "n")


def neg_log10_p(p: Column) -> Column:
    return -F.log10(p + F.lit(1e-10))


# ------------------------------------------------------------------------ U3
def metrics_long(wide: DataFrame, id_cols: list[str], metric_cols: list[str]) -> DataFrame:
    """Wide metrics table -> (id..., metric, value) with null values dropped."""
    return melt(wide, id_cols, metric_cols, "metric", "value").where(F.col("value").isNotNull())


# ------------------------------------------------------------------------ O3
def preview(df: DataFrame, key: str, n: int = 100) -> DataFrame:
    """First ``n`` rows by ``key`` (top-k; the limit is the feature)."""
    return df.orderBy(key).limit(int(n))
