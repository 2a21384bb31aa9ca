"""Statistical tests across clusters.

Inputs are long frames ``(feature, group, value)`` (see
:func:`cohortlens.functions.frames.melt`).  Every test reduces the data
with partial aggregates to one row per (feature, group[, value]); p-values
are computed on the final per-feature rows only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cohortlens.functions.distributions import chi2_pvalue, f_pvalue, norm_two_sided_pvalue, t_pvalue
from cohortlens.session import materialize

RANK_BUCKETS = 64


def _clean(long: DataFrame, group: str, value: str, noise) -> DataFrame:
    out = long.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    if noise is not None:
        out = out.where(F.col(group) != F.lit(noise))
    return out


# ------------------------------------------------------------------------ W6
def ranked_counts(cgv: DataFrame, by: list[str], group: str, value: str, n: str = "n",
                  buckets: int = RANK_BUCKETS) -> DataFrame:
    """Pooled average (mid) ranks for grouped value counts.

    ``cgv`` has one row per (by..., group, value) with multiplicity ``n``.
    Adds ``t`` (multiplicity of the value over all groups), ``avg_rank``
    (= #values below + (t + 1) / 2) and ``first`` (true on exactly one row
    per distinct value, for tie sums).

    A global ordered window would put a whole ``by`` group into one task.
    Instead each value falls into one of ``buckets`` ranges (boundaries from
    ``percentile_approx``: they only choose the cut, ranks stay exact); the
    bucket totals -- a table of (by, bucket) rows, bounded and broadcast --
    give each bucket's offset, and the running counts are windows over
    (by, bucket), which the data is partitioned by once.
    """
    probs = [i / buckets for i in range(1, buckets)]
    bounds = cgv.groupBy(*by).agg(F.percentile_approx(value, probs, 10_000).alias("_bnd"))
    cb = (cgv.join(F.broadcast(bounds), by)
             .withColumn("_bk", F.size(F.filter("_bnd", lambda b: b < F.col(value)))).drop("_bnd"))
    btot = cb.groupBy(*by, "_bk").agg(F.sum(n).alias("_bt"))
    w_b = Window.partitionBy(*by).orderBy("_bk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    boff = btot.withColumn("_boff", F.sum("_bt").over(w_b) - F.col("_bt")).drop("_bt")
    part = [*by, "_bk"]
    w_le = Window.partitionBy(*part).orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    w_v = Window.partitionBy(*part, value)
    out = (cb.join(F.broadcast(boff), part)
             .withColumn("t", F.sum(n).over(w_v))
             .withColumn("avg_rank", F.col("_boff") + F.sum(n).over(w_le) - F.col("t") + (F.col("t") + 1) / 2.0)
             .withColumn("first", F.col(group) == F.min(group).over(w_v)))
    return out.drop("_bk", "_boff")


def _rank_sums(d: DataFrame, feature: str, group: str, value: str, buckets: int) -> DataFrame:
    """(feature, group, n, R, tie) with R the rank sum of the group and tie the
    group's share of sum(t^3 - t) over the feature's distinct values."""
    # the grouped counts feed the bucket cut, the bucket totals and the ranking: computed once
    cgv = materialize(d.groupBy(feature, group, value).agg(F.count(F.lit(1)).alias("n")))
    r = ranked_counts(cgv, [feature], group, value, "n", buckets)
    tie = F.when(F.col("first"), F.pow(F.col("t"), 3) - F.col("t")).otherwise(F.lit(0.0))
    return r.groupBy(feature, group).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("avg_rank")).alias("R"),
                                         F.sum(tie).alias("tie"))


def _n_groups(long: DataFrame, group: str, noise) -> int:
    """Groups present in the data (non-null, non-noise), whatever their values."""
    g = long.where(F.col(group).isNotNull())
    if noise is not None:
        g = g.where(F.col(group) != F.lit(noise))
    return g.agg(F.countDistinct(group)).first()[0] or 0


# ------------------------------------------------------------------------ M5
def anova(long: DataFrame, feature: str = "feature", group: str = "cluster", value: str = "value",
          noise=-1) -> DataFrame:
    """One-way ANOVA F per feature (noise group and nulls excluded).

    Per (feature, group): n, mean and population variance (Spark's central
    moment aggregates are numerically stable); F = (SSB/(k-1)) / (SSW/(N-k)).
    A feature gets a row only when every group has at least one value and
    there are at least 2 groups.
    """
    k_all = _n_groups(long, group, noise)
    g = (_clean(long, group, value, noise).groupBy(feature, group)
         .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v")))
    tot = (g.groupBy(feature).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("_total"),
                                  (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("_gm"))
            .where((F.col("k") >= 2) & (F.col("k") == k_all)))
    dev = F.col("m") - F.col("_gm")
    per = (g.join(tot, feature).groupBy(feature, "k", F.col("_total").alias("N"))
            .agg(F.sum(F.col("n") * dev * dev).alias("ssb"), F.sum(F.col("n") * F.col("v")).alias("ssw")))
    # no statistic when every group has one row (N = k) or no group varies
    fstat = F.try_divide(F.col("ssb") / (F.col("k") - 1), F.try_divide(F.col("ssw"), F.col("N") - F.col("k")))
    return per.select(feature, "k", "N", fstat.alias("statistic"))


def with_f_pvalue(res: DataFrame) -> DataFrame:
    return res.withColumn("p_value", f_pvalue(F.col("statistic"), F.col("k") - 1, F.col("N") - F.col("k")))


# ------------------------------------------------------------------------ M6
def kruskal(long: DataFrame, feature: str = "feature", group: str = "cluster", value: str = "value",
            noise=-1, buckets: int = RANK_BUCKETS) -> DataFrame:
    """Kruskal-Wallis H per feature, tie-corrected, over pooled average ranks
    (same row rule as :func:`anova`)."""
    k_all = _n_groups(long, group, noise)
    rg = _rank_sums(_clean(long, group, value, noise), feature, group, value, buckets)
    per = (rg.groupBy(feature).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("N"),
                                   F.sum(F.col("R") * F.col("R") / F.col("n")).alias("_s"),
                                   F.sum("tie").alias("tie"))
             .where((F.col("k") >= 2) & (F.col("k") == k_all)))
    n = F.col("N").cast("double")
    h = F.lit(12.0) / (n * (n + 1)) * F.col("_s") - 3 * (n + 1)
    corr = F.lit(1.0) - F.col("tie") / (n * n * n - n)
    return per.select(feature, "k", "N", F.try_divide(h, corr).alias("statistic"))


def with_chi2_pvalue(res: DataFrame) -> DataFrame:
    return res.withColumn("p_value", chi2_pvalue(F.col("statistic"), F.col("k") - 1))


# ------------------------------------------------------------------------ M7
def mann_whitney(long: DataFrame, group_a, group_b, feature: str = "feature", group: str = "cluster",
                 value: str = "value", buckets: int = RANK_BUCKETS) -> DataFrame:
    """Two-sided Mann-Whitney U of group_a vs group_b per feature.

    ``statistic`` is U of group_a; the p-value is the normal approximation
    with tie and continuity correction.
    """
    d = _clean(long, group, value, None).where(F.col(group).isin([group_a, group_b]))
    rg = _rank_sums(d, feature, group, value, buckets)
    is_a = F.col(group) == F.lit(group_a)
    per = (rg.groupBy(feature).agg(
               F.sum(F.when(is_a, F.col("n")).otherwise(0)).alias("n1"),
               F.sum(F.when(~is_a, F.col("n")).otherwise(0)).alias("n2"),
               F.sum(F.when(is_a, F.col("R")).otherwise(0.0)).alias("R1"),
               F.sum("tie").alias("tie"))
             .where((F.col("n1") > 0) & (F.col("n2") > 0)))
    n1 = F.col("n1").cast("double")
    u1 = F.col("R1") - n1 * (n1 + 1) / 2
    return per.select(feature, "n1", "n2", u1.alias("statistic"), "tie")


def with_mw_pvalue(res: DataFrame) -> DataFrame:
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    mu = n1 * n2 / 2
    u = F.greatest(F.col("statistic"), n1 * n2 - F.col("statistic"))
    sigma = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("tie") / (n * (n - 1))))
    z = F.try_divide(u - mu - 0.5, sigma)
    # a feature that is constant over both groups separates nothing
    p = F.when(sigma == 0, F.lit(1.0)).otherwise(norm_two_sided_pvalue(z))
    return res.withColumn("p_value", p).drop("tie")


# ------------------------------------------------------------------------ M8
def t_test(long: DataFrame, group_a, group_b, feature: str = "feature", group: str = "cluster",
           value: str = "value", equal_var: bool = False) -> DataFrame:
    """Welch (default) or Student t statistic of group_a vs group_b per feature."""
    d = _clean(long, group, value, None).where(F.col(group).isin([group_a, group_b]))
    is_a = F.col(group) == F.lit(group_a)
    g = d.groupBy(feature, is_a.alias("_a")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"),
                                                F.var_samp(value).alias("v"))
    a, b = g.where("_a").alias("a"), g.where("NOT _a").alias("b")
    j = a.join(b, feature).select(feature, F.col("a.n").alias("n1"), F.col("b.n").alias("n2"),
                                  F.col("a.m").alias("m1"), F.col("b.m").alias("m2"),
                                  F.col("a.v").alias("v1"), F.col("b.v").alias("v2"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    if equal_var:
        df_ = n1 + n2 - 2
        sp = F.try_divide((n1 - 1) * F.col("v1") + (n2 - 1) * F.col("v2"), df_)
        se = F.sqrt(sp * (1 / n1 + 1 / n2))
    else:
        a1, a2 = F.col("v1") / n1, F.col("v2") / n2
        se = F.sqrt(a1 + a2)
        df_ = F.try_divide((a1 + a2) * (a1 + a2), F.try_divide(a1 * a1, n1 - 1) + F.try_divide(a2 * a2, n2 - 1))
    return j.select(feature, "n1", "n2", F.try_divide(F.col("m1") - F.col("m2"), se).alias("statistic"),
                    df_.alias("df"))


def with_t_pvalue(res: DataFrame) -> DataFrame:
    return res.withColumn("p_value", t_pvalue(F.col("statistic"), F.col("df")))


# ------------------------------------------------------------------------ M9
def chi2_contingency(df: DataFrame, row: str, col: str, correction: bool = True) -> DataFrame:
    """Pearson chi-squared of the row x col table, Yates-corrected when dof = 1.

    Works on the long counts of the cells that occur: an empty cell adds its
    expected count, and all empty cells together add ``N`` less the expected
    counts of the others, so no dense table is built for any number of rows
    or columns.  In a 2 x 2 table ``|n - e|`` is the same in all four cells.
    """
    base = df.where(F.col(row).isNotNull() & F.col(col).isNotNull()).select(F.col(row).alias("_r"), F.col(col).alias("_c"))
    cell = materialize(base.groupBy("_r", "_c").agg(F.count(F.lit(1)).cast("double").alias("n")))
    rows = cell.groupBy("_r").agg(F.sum("n").alias("rt"))
    cols = cell.groupBy("_c").agg(F.sum("n").alias("ct"))
    t = rows.agg(F.count(F.lit(1)).alias("R"), F.sum("rt").alias("N"), F.sum(1 / F.col("rt")).alias("ir")).first()
    u = cols.agg(F.count(F.lit(1)).alias("C"), F.sum(1 / F.col("ct")).alias("ic")).first()
    n, dof = t["N"], max((t["R"] - 1) * (u["C"] - 1), 0)
    if not n:   # empty table: no statistic
        return df.sparkSession.createDataFrame([(None, 0)], "statistic double, dof bigint")
    e = F.col("rt") * F.col("ct") / F.lit(n)
    dev = F.col("n") - e
    joined = cell.join(rows, "_r").join(cols, "_c")
    if correction and dof == 1:
        diff = F.max(F.abs(dev))
        diff = diff - F.least(F.lit(0.5), diff)
        stat = diff * diff * F.lit(n * t["ir"] * u["ic"])
    else:
        stat = F.sum(dev * dev / e) + (F.lit(n) - F.sum(e))
    return joined.agg(stat.alias("statistic")).select("statistic", F.lit(dof).cast("bigint").alias("dof"))


# ----------------------------------------------------------------------- M10
def bonferroni(tests: DataFrame, p: str = "p_value", alpha: float = 0.05) -> DataFrame:
    """p x (number of tests), clipped at 1, and significance flags.

    ``tests`` is the per-feature result table (one row per test), so the
    window over it spans a bounded number of rows.
    """
    m = F.count(F.lit(1)).over(Window.partitionBy())
    adj = F.least(F.col(p) * m, F.lit(1.0))
    return (tests.withColumn("significant", F.col(p) < alpha)
                 .withColumn("adjusted_p_value", adj)
                 .withColumn("significant_adjusted", F.col("adjusted_p_value") < alpha)
                 .withColumn("neg_log10_p", -F.log10(F.col(p) + F.lit(1e-10))))


# ------------------------------------------------------------ M6/M7 by group count
def group_difference_test(df: DataFrame, group: str, value: str, noise=None, with_p: bool = True) -> DataFrame:
    """One test of ``value`` across the groups of ``group`` (noise excluded):
    Mann-Whitney U when there are exactly two groups, Kruskal-Wallis H when
    there are more, no row with fewer.  One row (test, statistic[, p_value])."""
    d = df.where(F.col(group).isNotNull() & F.col(value).isNotNull())
    if noise is not None:
        d = d.where(F.col(group) != F.lit(noise))
    groups = [r[0] for r in d.select(group).distinct().limit(3).collect()]
    long = d.select(F.lit("_").alias("feature"), F.col(group).alias("_g"), F.col(value).cast("double").alias("value"))
    spark = df.sparkSession
    if len(groups) < 2:
        return spark.createDataFrame([], "test string, statistic double" + (", p_value double" if with_p else ""))
    if len(groups) == 2:
        a, b = sorted(groups)
        res = mann_whitney(long, a, b, group="_g")
        res = with_mw_pvalue(res) if with_p else res.drop("tie")
        return res.select(F.lit("mann_whitney").alias("test"), "statistic", *(["p_value"] if with_p else []))
    res = kruskal(long, group="_g", noise=None)
    res = with_chi2_pvalue(res) if with_p else res
    return res.select(F.lit("kruskal").alias("test"), "statistic", *(["p_value"] if with_p else []))
