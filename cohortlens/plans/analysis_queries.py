"""Profile, statistics and clustering-metric queries.

Numeric features are the 64 embedding dimensions; the given ``label`` is
the clustering (``cluster_labels``), a folded copy with a noise group is
the second clustering (``cluster_labels_b``); two-class outcomes come from
``labels`` joined to ``documents``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions.frames import melt
from cohortlens.operators import evaluate, features as feats, joins, profile, stats
from cohortlens.plans.feature_queries import ORDER_TIMING_SQL
from cohortlens.plans.registry import query, r6
from cohortlens.plans.roles import FEATURE_COLS, role, roles


def _labelled(spark, sf, labels="cluster_labels"):
    f, l = roles(spark, sf, "features", labels)
    return joins.align_labels(f, l, "key")


def _long(spark, sf, labels="cluster_labels"):
    return melt(_labelled(spark, sf, labels), ["key", "cluster"], FEATURE_COLS)


def _round(df, cols):
    return df.select(*[r6(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


_LAB = "lab AS (SELECT f.key, l.cluster, f.feature, f.value FROM feature_long f JOIN {labels} l USING (key))"


# ------------------------------------------------------------------------ A9
@query("cluster_summary", f"""WITH {_LAB.format(labels='cluster_labels')},
sz AS (SELECT cluster, count(*) AS n FROM cluster_labels GROUP BY cluster)
SELECT cluster, s.n, round(s.n * 100.0 / (SELECT count(*) FROM cluster_labels), 6) AS percentage, feature,
       round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, max(value) AS max
FROM lab JOIN sz s USING (cluster) GROUP BY cluster, s.n, feature
""")
def q_cluster_summary(spark, sf):
    return _round(profile.cluster_summary(_labelled(spark, sf)), {"percentage", "mean", "std"})


@query("cluster_summary_wide", "SELECT cluster, count(*) AS count, "
       "round(count(*) * 100.0 / (SELECT count(*) FROM cluster_labels), 6) AS percentage, "
       + ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(stddev_samp({c}), 6) AS {c}_std, "
                        f"min({c}) AS {c}_min, max({c}) AS {c}_max" for c in FEATURE_COLS)
       + " FROM features JOIN cluster_labels USING (key) GROUP BY cluster")
def q_cluster_summary_wide(spark, sf):
    out = profile.cluster_summary_wide(_labelled(spark, sf))
    return _round(out, {"percentage"} | {f"{c}_{s}" for c in FEATURE_COLS for s in ("mean", "std")})


# ----------------------------------------------------------------------- A10
@query("cluster_profile", f"""WITH {_LAB.format(labels='cluster_labels')}
SELECT cluster, feature, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median,
       round(stddev_samp(value), 6) AS std, CAST(count(value) AS DOUBLE) AS count
FROM lab GROUP BY cluster, feature
""")
def q_cluster_profile(spark, sf):
    return _round(profile.cluster_profile(_labelled(spark, sf)), {"mean", "median", "std"})


# ----------------------------------------------------------------------- A11
@query("cluster_radar", f"""WITH {_LAB.format(labels='cluster_labels')},
g AS (SELECT feature, quantile_cont(value, 0.5) AS med, min(value) AS lo, max(value) AS hi
      FROM feature_long GROUP BY feature)
SELECT cluster, feature,
       round(avg(CASE WHEN g.hi > g.lo THEN (coalesce(value, g.med) - g.lo) / (g.hi - g.lo) ELSE 0.0 END), 6) AS value
FROM lab JOIN g USING (feature) GROUP BY cluster, feature
""")
def q_cluster_radar(spark, sf):
    return _round(profile.cluster_radar(_labelled(spark, sf)), {"value"})


# ----------------------------------------------------------------------- A12
@query("cluster_characterization", f"""WITH {_LAB.format(labels='cluster_labels_b')},
ov AS (SELECT feature, avg(value) AS om FROM lab GROUP BY feature),
sz AS (SELECT cluster, count(*) AS size FROM cluster_labels_b GROUP BY cluster),
st AS (SELECT cluster, feature, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min,
              max(value) AS max, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.25) AS p25,
              quantile_cont(value, 0.75) AS p75
       FROM lab WHERE cluster <> -1 GROUP BY cluster, feature)
SELECT st.cluster, sz.size, round(sz.size * 100.0 / (SELECT count(*) FROM cluster_labels_b), 6) AS percentage,
       st.feature, round(mean, 6) AS mean, round(std, 6) AS std, min, max, round(median, 6) AS median,
       round(p25, 6) AS p25, round(p75, 6) AS p75,
       round(CASE WHEN ov.om = 0 THEN 0.0 ELSE (mean - ov.om) / ov.om * 100.0 END, 6) AS diff_from_mean
FROM st JOIN sz USING (cluster) JOIN ov USING (feature)
""")
def q_cluster_characterization(spark, sf):
    out = profile.cluster_characterization(_labelled(spark, sf, "cluster_labels_b"))
    return _round(out, {"percentage", "mean", "std", "median", "p25", "p75", "diff_from_mean"})


# ------------------------------------------------------------- A13 / A14
@query("length_of_stay", """
SELECT hadm_id, date_diff('microsecond', admittime, dischtime) / CAST(86400000000 AS DOUBLE) AS length_of_stay
FROM admissions
""")
def q_length_of_stay(spark, sf):
    return profile.length_of_stay(role(spark, sf, "admissions"), "admittime", "dischtime", "hadm_id")


@query("los_by_cluster", """
WITH los AS (SELECT admission_type AS cluster,
                    date_diff('microsecond', admittime, dischtime) / CAST(86400000000 AS DOUBLE) AS v
             FROM admissions)
SELECT cluster, count(v) AS count, round(avg(v), 6) AS mean_los, round(stddev_samp(v), 6) AS std_los,
       min(v) AS min_los, max(v) AS max_los, round(quantile_cont(v, 0.25), 2) AS p25,
       round(quantile_cont(v, 0.5), 2) AS median, round(quantile_cont(v, 0.75), 2) AS p75
FROM los GROUP BY cluster
""")
def q_los_by_cluster(spark, sf):
    adm = role(spark, sf, "admissions")
    los = profile.length_of_stay(adm.withColumnRenamed("admission_type", "cluster"), "admittime",
                                 "dischtime", "cluster")
    return _round(profile.los_by_cluster(los), {"mean_los", "std_los"})


# ------------------------------------------------------------- A15 / A16
@query("outcome_rate", """
SELECT cluster_name, round(avg(CAST(quality AS DOUBLE)), 6) AS rate, count(quality) AS count
FROM doc_outcomes GROUP BY cluster_name
""")
def q_outcome_rate(spark, sf):
    return _round(profile.outcome_rate(role(spark, sf, "doc_outcomes"), "cluster_name", "quality"), {"rate"})


@query("contingency", "SELECT cluster_name, toxic, count(*) AS n FROM doc_outcomes GROUP BY cluster_name, toxic")
def q_contingency(spark, sf):
    return profile.contingency(role(spark, sf, "doc_outcomes"), "cluster_name", "toxic")


@query("contingency_wide", """
SELECT cluster_name, count(*) FILTER (toxic = 0) AS "0", count(*) FILTER (toxic = 1) AS "1"
FROM doc_outcomes WHERE toxic IS NOT NULL GROUP BY cluster_name
""")
def q_contingency_wide(spark, sf):
    return profile.contingency_wide(role(spark, sf, "doc_outcomes"), "cluster_name", "toxic")


# ----------------------------------------------------------------------- A17
_ADM_COLS = ["subject_id", "hadm_id", "admittime", "dischtime", "deathtime", "admission_type",
             "admit_provider_id", "admission_location", "discharge_location", "insurance", "language",
             "marital_status", "race", "edregtime", "edouttime", "hospital_expire_flag"]


@query("column_profile", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, count({c}) AS non_null, "
    f"round(CAST(count(*) - count({c}) AS DOUBLE) * 100.0 / greatest(count(*), 1), 2) AS missing_pct FROM admissions"
    for c in _ADM_COLS))
def q_column_profile(spark, sf):
    return profile.column_profile(role(spark, sf, "admissions")).drop("dtype")


@query("table_shape", "SELECT count(*) AS n_rows, CAST(16 AS BIGINT) AS n_columns, CAST("
       + " + ".join(f"count(*) - count({c})" for c in _ADM_COLS) + " AS BIGINT) AS n_missing FROM admissions")
def q_table_shape(spark, sf):
    return profile.table_shape(role(spark, sf, "admissions"))


# ----------------------------------------------------------------------- A18
@query("avg_orders_by_period", f"""WITH t AS ({ORDER_TIMING_SQL})
SELECT round(avg(orders_in_first_24h), 6) AS avg_orders_in_first_24h,
       round(avg(orders_in_first_48h), 6) AS avg_orders_in_first_48h,
       round(avg(orders_in_first_72h), 6) AS avg_orders_in_first_72h FROM t
""")
def q_avg_orders_by_period(spark, sf):
    t = feats.order_timing(role(spark, sf, "order_events"), "patient", "order_type", "ordertime",
                           "admittime", "dischtime", tiebreak="event_id")
    out = profile.avg_orders_by_period(t)
    return _round(out, set(out.columns))


# ----------------------------------------------------------------------- A19
@query("cluster_sizes", """
SELECT cluster, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM cluster_labels_b), 6) AS percentage
FROM cluster_labels_b GROUP BY cluster
""")
def q_cluster_sizes(spark, sf):
    return _round(profile.cluster_sizes(role(spark, sf, "cluster_labels_b")), {"percentage"})


# ----------------------------------------------------------------------- A20
@query("impute_stats", """
WITH m AS (SELECT feature, avg(value) AS mean, quantile_cont(value, 0.5) AS median FROM feature_long GROUP BY feature),
c AS (SELECT feature, value, count(*) AS n FROM feature_long WHERE value IS NOT NULL GROUP BY feature, value),
mo AS (SELECT feature, value AS mode FROM
        (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) AS rn FROM c) x WHERE rn = 1)
SELECT feature AS column_name, round(mean, 6) AS mean, round(median, 6) AS median, mode
FROM m JOIN mo USING (feature)
""")
def q_impute_stats(spark, sf):
    return _round(profile.impute_stats(role(spark, sf, "features"), FEATURE_COLS), {"mean", "median"})


# ----------------------------------------------------------------------- A22
@query("histogram", """
WITH mm AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
b AS (SELECT CAST(least(floor((value - lo) / (hi - lo) * 30), 29) AS INTEGER) AS bin, lo, hi
      FROM events, mm WHERE value IS NOT NULL)
SELECT bin, round(lo + bin * ((hi - lo) / 30), 6) AS bin_start, round(lo + (bin + 1) * ((hi - lo) / 30), 6) AS bin_end,
       count(*) AS n
FROM b GROUP BY bin, lo, hi
""")
def q_histogram(spark, sf):
    return _round(profile.histogram(spark.read.parquet(f"{sf}/events.parquet"), "value", 30),
                  {"bin_start", "bin_end"})


@query("top_categories", """
SELECT order_type, count(*) AS n,
       count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM poe WHERE order_type IS NOT NULL) AS share
FROM poe WHERE order_type IS NOT NULL GROUP BY order_type ORDER BY n DESC, order_type LIMIT 20
""")
def q_top_categories(spark, sf):
    return profile.top_categories(role(spark, sf, "poe"), "order_type", 20)


@query("box_stats", """
SELECT event_type, min(value) AS min, round(quantile_cont(value, 0.25), 6) AS q1,
       round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3,
       max(value) AS max, count(value) AS n
FROM events GROUP BY event_type
""")
def q_box_stats(spark, sf):
    return _round(profile.box_stats(spark.read.parquet(f"{sf}/events.parquet"), "value", "event_type"),
                  {"q1", "median", "q3"})


# ------------------------------------------------------------------------ U3
@query("metrics_long", """
WITH los AS (SELECT admission_type AS cluster,
                    date_diff('microsecond', admittime, dischtime) / CAST(86400000000 AS DOUBLE) AS v
             FROM admissions),
w AS (SELECT cluster, CAST(count(v) AS DOUBLE) AS count, avg(v) AS mean_los, min(v) AS min_los, max(v) AS max_los
      FROM los GROUP BY cluster)
SELECT cluster, metric, round(value, 6) AS value FROM (
  SELECT cluster, 'count' AS metric, count AS value FROM w UNION ALL
  SELECT cluster, 'mean_los', mean_los FROM w UNION ALL
  SELECT cluster, 'min_los', min_los FROM w UNION ALL
  SELECT cluster, 'max_los', max_los FROM w) u
WHERE value IS NOT NULL
""")
def q_metrics_long(spark, sf):
    adm = role(spark, sf, "admissions")
    los = profile.length_of_stay(adm.withColumnRenamed("admission_type", "cluster"), "admittime",
                                 "dischtime", "cluster")
    wide = profile.los_by_cluster(los)
    return _round(profile.metrics_long(wide, ["cluster"], ["count", "mean_los", "min_los", "max_los"]),
                  {"value"})


# ======================================================= statistics M5 - M10
_CLEAN = ("d AS (SELECT f.feature, l.cluster, f.value FROM feature_long f JOIN cluster_labels l USING (key) "
          "WHERE f.value IS NOT NULL AND l.cluster IS NOT NULL AND l.cluster <> -1)")


@query("anova_f", f"""WITH {_CLEAN},
g AS (SELECT feature, cluster, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM d GROUP BY feature, cluster),
t AS (SELECT feature, count(*) AS k, sum(n) AS N, sum(n * m) / sum(n) AS gm, sum(n * v) AS ssw FROM g GROUP BY feature)
SELECT t.feature, t.k, CAST(t.N AS BIGINT) AS N,
       round((sum(g.n * (g.m - t.gm) * (g.m - t.gm)) / (t.k - 1)) / (t.ssw / (t.N - t.k)), 6) AS statistic
FROM g JOIN t USING (feature) GROUP BY t.feature, t.k, t.N, t.ssw, t.gm HAVING t.k >= 2
""")
def q_anova_f(spark, sf):
    return _round(stats.anova(_long(spark, sf)), {"statistic"})


# p-values by Simpson's rule on 4,000 intervals, the tail itself being integrated: the F tail as
# 2 / B(d2/2, d1/2) * integral of sin^(d2-1) cos^(d1-1) from 0 to atan(sqrt(d2 / (d1 F))), the chi-squared tail over the root of x
_SIMPSON = "CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
_P_ROUNDED = {"statistic", "df", "p_value", "adjusted_p_value", "neg_log10_p"}


def _f_tail(stat: str, d1: str, d2: str, source: str) -> str:
    """CTE ``pv(feature, p)`` of the F tail."""
    power = "exp((d2 - 1) * ln(sin(i * h)) + (d1 - 1) * ln(cos(i * h)) + lb)"
    return f"""th AS (SELECT feature, d1, d2, atan(sqrt(d2 / (d1 * s))) / 4000 AS h, ln(2) + lgamma((d1 + d2) / 2) - lgamma(d1 / 2) - lgamma(d2 / 2) AS lb
       FROM (SELECT feature, {stat} AS s, CAST({d1} AS DOUBLE) AS d1, CAST({d2} AS DOUBLE) AS d2 FROM {source})),
pv AS (SELECT feature, least(1.0, sum({_SIMPSON} * CASE WHEN i = 0 THEN CASE WHEN d2 = 1 THEN exp(lb) ELSE 0 END ELSE {power} END) * any_value(h) / 3) AS p
       FROM th CROSS JOIN (SELECT unnest(range(4001)) AS i) GROUP BY feature)"""


def _chi2_tail(stat: str, dof: str, source: str) -> str:
    """CTE ``pv(feature, p)`` of the chi-squared tail."""
    return f"""th AS (SELECT feature, k, sqrt(x) AS a, (greatest(sqrt(x), sqrt(k)) + 12 - sqrt(x)) / 4000 AS h, ln(2) * (1 - k / 2) - lgamma(k / 2) AS lb
       FROM (SELECT feature, CAST({stat} AS DOUBLE) AS x, CAST({dof} AS DOUBLE) AS k FROM {source})),
pv AS (SELECT feature, least(1.0, sum({_SIMPSON} * CASE WHEN a + i * h = 0 THEN CASE WHEN k = 1 THEN exp(lb) ELSE 0 END
              ELSE exp((k - 1) * ln(a + i * h) - (a + i * h) * (a + i * h) / 2 + lb) END) * any_value(h) / 3) AS p
       FROM th CROSS JOIN (SELECT unnest(range(4001)) AS i) GROUP BY feature)"""


def _bonferroni_cols(p: str = "pv.p") -> str:
    adjusted = f"least({p} * (SELECT count(*) FROM pv), 1.0)"
    return (f"round({p}, 6) AS p_value, {p} < 0.05 AS significant, round({adjusted}, 6) AS adjusted_p_value, "
            f"{adjusted} < 0.05 AS significant_adjusted, round(-log10({p} + 1e-10), 6) AS neg_log10_p")


@query("anova_test", f"""WITH {_CLEAN},
g AS (SELECT feature, cluster, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM d GROUP BY feature, cluster),
t AS (SELECT feature, count(*) AS k, sum(n) AS N, sum(n * m) / sum(n) AS gm, sum(n * v) AS ssw FROM g GROUP BY feature),
st AS (SELECT t.feature, t.k, CAST(t.N AS BIGINT) AS N, (sum(g.n * (g.m - t.gm) * (g.m - t.gm)) / (t.k - 1)) / (t.ssw / (t.N - t.k)) AS statistic
       FROM g JOIN t USING (feature) GROUP BY t.feature, t.k, t.N, t.ssw, t.gm HAVING t.k >= 2),
{_f_tail('statistic', 'k - 1', 'N - k', 'st')}
SELECT feature, k, N, round(statistic, 6) AS statistic, {_bonferroni_cols()} FROM st JOIN pv USING (feature)
""")
def q_anova_test(spark, sf):
    return _round(stats.bonferroni(stats.with_f_pvalue(stats.anova(_long(spark, sf)))), _P_ROUNDED)


_RANKS = """
cv AS (SELECT feature, value, count(*) AS t FROM d GROUP BY feature, value),
rk AS (SELECT feature, value, t,
              sum(t) OVER (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
              - t + (t + 1) / 2.0 AS r FROM cv),
ties AS (SELECT feature, sum(t * t * t - t) AS tie FROM cv GROUP BY feature)"""


@query("kruskal_h", f"""WITH {_CLEAN},{_RANKS},
rg AS (SELECT d.feature, d.cluster, count(*) AS n, sum(rk.r) AS R FROM d JOIN rk USING (feature, value)
       GROUP BY d.feature, d.cluster),
per AS (SELECT feature, count(*) AS k, sum(n) AS N, sum(R * R / n) AS s FROM rg GROUP BY feature HAVING count(*) >= 2)
SELECT per.feature, per.k, CAST(per.N AS BIGINT) AS N,
       round((12.0 / (per.N * (per.N + 1)) * per.s - 3 * (per.N + 1))
             / (1 - ties.tie / (CAST(per.N AS DOUBLE) * per.N * per.N - per.N)), 6) AS statistic
FROM per JOIN ties USING (feature)
""")
def q_kruskal_h(spark, sf):
    return _round(stats.kruskal(_long(spark, sf)), {"statistic"})


@query("kruskal_test", f"""WITH {_CLEAN},{_RANKS},
rg AS (SELECT d.feature, d.cluster, count(*) AS n, sum(rk.r) AS R FROM d JOIN rk USING (feature, value)
       GROUP BY d.feature, d.cluster),
per AS (SELECT feature, count(*) AS k, sum(n) AS N, sum(R * R / n) AS s FROM rg GROUP BY feature HAVING count(*) >= 2),
st AS (SELECT per.feature, per.k, CAST(per.N AS BIGINT) AS N, (12.0 / (per.N * (per.N + 1)) * per.s - 3 * (per.N + 1))
              / (1 - ties.tie / (CAST(per.N AS DOUBLE) * per.N * per.N - per.N)) AS statistic FROM per JOIN ties USING (feature)),
{_chi2_tail('statistic', 'k - 1', 'st')}
SELECT feature, k, N, round(statistic, 6) AS statistic, {_bonferroni_cols()} FROM st JOIN pv USING (feature)
""")
def q_kruskal_test(spark, sf):
    return _round(stats.bonferroni(stats.with_chi2_pvalue(stats.kruskal(_long(spark, sf)))), _P_ROUNDED)


_TWO = ("d AS (SELECT f.feature, l.cluster, f.value FROM feature_long f JOIN cluster_labels l USING (key) "
        "WHERE f.value IS NOT NULL AND l.cluster IN (0, 1))")


@query("mannwhitney_u", f"""WITH {_TWO},{_RANKS}
SELECT d.feature, CAST(sum(CASE WHEN d.cluster = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n1,
       CAST(sum(CASE WHEN d.cluster = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n2,
       round(sum(CASE WHEN d.cluster = 0 THEN rk.r ELSE 0 END)
             - sum(CASE WHEN d.cluster = 0 THEN 1 ELSE 0 END) * (sum(CASE WHEN d.cluster = 0 THEN 1 ELSE 0 END) + 1) / 2.0, 6)
             AS statistic
FROM d JOIN rk USING (feature, value) GROUP BY d.feature
""")
def q_mannwhitney_u(spark, sf):
    return _round(stats.mann_whitney(_long(spark, sf), 0, 1).drop("tie"), {"statistic"})


@query("mannwhitney_test", f"""WITH {_TWO},{_RANKS},
u0 AS (SELECT d.feature, CAST(sum(CASE WHEN d.cluster = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n1,
              CAST(sum(CASE WHEN d.cluster = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n2, sum(CASE WHEN d.cluster = 0 THEN rk.r ELSE 0 END) AS r1
       FROM d JOIN rk USING (feature, value) GROUP BY d.feature),
u1 AS (SELECT feature, n1, n2, r1 - n1 * (n1 + 1) / 2.0 AS statistic, CAST(n1 AS DOUBLE) * n2 AS nn, CAST(n1 + n2 AS DOUBLE) AS n, tie
       FROM u0 JOIN ties USING (feature)),
st AS (SELECT *, greatest(statistic, nn - statistic) - nn / 2 - 0.5 AS up, sqrt(nn / 12 * ((n + 1) - tie / (n * (n - 1)))) AS sigma FROM u1),
{_chi2_tail('(up / sigma) * (up / sigma)', '1', 'st')}
SELECT feature, n1, n2, round(statistic, 6) AS statistic, {_bonferroni_cols()} FROM st JOIN pv USING (feature)
""")
def q_mannwhitney_test(spark, sf):
    return _round(stats.bonferroni(stats.with_mw_pvalue(stats.mann_whitney(_long(spark, sf), 0, 1))), _P_ROUNDED)


@query("ttest", f"""WITH {_TWO},
a AS (SELECT feature, count(*) AS n1, avg(value) AS m1, var_samp(value) AS v1 FROM d WHERE cluster = 0 GROUP BY feature),
b AS (SELECT feature, count(*) AS n2, avg(value) AS m2, var_samp(value) AS v2 FROM d WHERE cluster = 1 GROUP BY feature)
SELECT feature, n1, n2, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS statistic,
       round((v1 / n1 + v2 / n2) * (v1 / n1 + v2 / n2)
             / ((v1 / n1) * (v1 / n1) / (n1 - 1) + (v2 / n2) * (v2 / n2) / (n2 - 1)), 6) AS df
FROM a JOIN b USING (feature)
""")
def q_ttest(spark, sf):
    return _round(stats.t_test(_long(spark, sf), 0, 1), {"statistic", "df"})


@query("ttest_test", f"""WITH {_TWO},
a AS (SELECT feature, count(*) AS n1, avg(value) AS m1, var_samp(value) AS v1 FROM d WHERE cluster = 0 GROUP BY feature),
b AS (SELECT feature, count(*) AS n2, avg(value) AS m2, var_samp(value) AS v2 FROM d WHERE cluster = 1 GROUP BY feature),
st AS (SELECT feature, n1, n2, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS statistic, (v1 / n1 + v2 / n2) * (v1 / n1 + v2 / n2)
              / ((v1 / n1) * (v1 / n1) / (n1 - 1) + (v2 / n2) * (v2 / n2) / (n2 - 1)) AS df FROM a JOIN b USING (feature)),
{_f_tail('statistic * statistic', '1', 'df', 'st')}
SELECT feature, n1, n2, round(statistic, 6) AS statistic, round(df, 6) AS df, {_bonferroni_cols()} FROM st JOIN pv USING (feature)
""")
def q_ttest_test(spark, sf):
    return _round(stats.bonferroni(stats.with_t_pvalue(stats.t_test(_long(spark, sf), 0, 1))), _P_ROUNDED)


def _chi2_sql(row: str, col: str, yates: bool) -> str:
    diff = "abs(obs - e)"
    if yates:
        diff = f"({diff} - least(0.5, {diff}))"
    return f"""WITH o AS (SELECT {row} AS r, {col} AS c, count(*) AS n FROM doc_outcomes
                   WHERE {row} IS NOT NULL AND {col} IS NOT NULL GROUP BY 1, 2),
rt AS (SELECT r, sum(n) AS rt FROM o GROUP BY r), ct AS (SELECT c, sum(n) AS ct FROM o GROUP BY c),
tot AS (SELECT sum(n) AS N FROM o),
grid AS (SELECT rt.r, ct.c, rt.rt * ct.ct / tot.N AS e, coalesce(o.n, 0) AS obs
         FROM rt CROSS JOIN ct CROSS JOIN tot LEFT JOIN o ON o.r = rt.r AND o.c = ct.c)
SELECT round(sum({diff} * {diff} / e), 6) AS statistic,
       CAST(((SELECT count(*) FROM rt) - 1) * ((SELECT count(*) FROM ct) - 1) AS BIGINT) AS dof FROM grid"""


@query("chi2_contingency", _chi2_sql("cluster_name", "toxic", False))
def q_chi2_contingency(spark, sf):
    return _round(stats.chi2_contingency(role(spark, sf, "doc_outcomes"), "cluster_name", "toxic"), {"statistic"})


@query("chi2_yates", _chi2_sql("quality", "toxic", True))
def q_chi2_yates(spark, sf):
    return _round(stats.chi2_contingency(role(spark, sf, "doc_outcomes"), "quality", "toxic"), {"statistic"})


@query("chi2_test", f"""WITH st AS (SELECT 'all' AS feature, statistic, dof FROM ({_chi2_sql("cluster_name", "toxic", False).replace("round(sum(", "(sum(").replace(", 6)", ")")})),
{_chi2_tail('statistic', 'dof', 'st')}
SELECT round(statistic, 6) AS statistic, dof, round(p, 6) AS p_value FROM st JOIN pv USING (feature)
""")
def q_chi2_test(spark, sf):
    from cohortlens.functions.distributions import chi2_pvalue
    r = stats.chi2_contingency(role(spark, sf, "doc_outcomes"), "cluster_name", "toxic")
    return _round(r.withColumn("p_value", chi2_pvalue(F.col("statistic"), F.col("dof"))), {"statistic", "p_value"})


@query("bonferroni", """
WITH t AS (SELECT l_returnflag || l_linestatus || l_linenumber AS feature, avg(l_discount) * min(l_tax + 0.01) * 4 AS p_value FROM lineitem GROUP BY 1),
a AS (SELECT feature, p_value, least(p_value * (SELECT count(*) FROM t), 1.0) AS adjusted FROM t)
SELECT feature, round(p_value, 6) AS p_value, p_value < 0.05 AS significant, round(adjusted, 6) AS adjusted_p_value,
       adjusted < 0.05 AS significant_adjusted, round(-log10(p_value + 1e-10), 6) AS neg_log10_p FROM a
""")
def q_bonferroni(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    tests = li.groupBy(F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("feature")).agg(
        (F.avg("l_discount") * F.min(F.col("l_tax") + F.lit(0.01)) * 4).alias("p_value"))
    return _round(stats.bonferroni(tests), {"p_value", "adjusted_p_value", "neg_log10_p"})


# ============================================================ metrics M1-M12
_CENT = """cen AS (SELECT cluster, feature, avg(value) AS mu, count(*) AS n FROM lab GROUP BY cluster, feature)"""


@query("inertia", f"""WITH {_LAB.format(labels='cluster_labels')}, {_CENT}
SELECT round(sum((value - mu) * (value - mu)), 6) AS inertia FROM lab JOIN cen USING (cluster, feature)
""")
def q_inertia(spark, sf):
    return _round(evaluate.inertia(_labelled(spark, sf), FEATURE_COLS), {"inertia"})


def _ch_sql(labels: str, where: str = "") -> str:
    return f"""WITH {_LAB.format(labels=labels)}{where}, {_CENT},
gm AS (SELECT feature, avg(value) AS g FROM lab GROUP BY feature),
k AS (SELECT count(DISTINCT cluster) AS k, count(DISTINCT key) AS n FROM lab),
b AS (SELECT sum(n * (mu - g) * (mu - g)) AS b FROM cen JOIN gm USING (feature)),
w AS (SELECT sum((value - mu) * (value - mu)) AS w FROM lab JOIN cen USING (cluster, feature))
SELECT round((b / (k - 1)) / (w / (n - k)), 6) AS calinski_harabasz FROM b, w, k"""


@query("calinski_harabasz", _ch_sql("cluster_labels"))
def q_calinski_harabasz(spark, sf):
    return _round(evaluate.calinski_harabasz(_labelled(spark, sf), FEATURE_COLS), {"calinski_harabasz"})


def _db_sql(labels: str, where: str = "") -> str:
    return f"""WITH {_LAB.format(labels=labels)}{where}, {_CENT},
pd AS (SELECT lab.key, lab.cluster, sqrt(sum((value - mu) * (value - mu))) AS d
       FROM lab JOIN cen USING (cluster, feature) GROUP BY lab.key, lab.cluster),
s AS (SELECT cluster, avg(d) AS s FROM pd GROUP BY cluster),
cd AS (SELECT a.cluster AS i, b.cluster AS j, sqrt(sum((a.mu - b.mu) * (a.mu - b.mu))) AS dij
       FROM cen a JOIN cen b ON a.feature = b.feature AND a.cluster <> b.cluster GROUP BY a.cluster, b.cluster),
r AS (SELECT cd.i, max((si.s + sj.s) / cd.dij) AS m FROM cd JOIN s si ON si.cluster = cd.i JOIN s sj ON sj.cluster = cd.j
      GROUP BY cd.i)
SELECT round(avg(m), 6) AS davies_bouldin FROM r"""


@query("davies_bouldin", _db_sql("cluster_labels"))
def q_davies_bouldin(spark, sf):
    return _round(evaluate.davies_bouldin(_labelled(spark, sf), FEATURE_COLS), {"davies_bouldin"})


def _sil_sql(labels: str, where: str = "") -> str:
    return f"""WITH {_LAB.format(labels=labels)}{where},
agg AS (SELECT cluster, feature, sum(value) AS s, sum(value * value) AS q FROM lab GROUP BY cluster, feature),
sz AS (SELECT cluster, count(DISTINCT key) AS n FROM lab GROUP BY cluster),
dd AS (SELECT p.key, p.cluster AS own, a.cluster AS c,
              sum(sz.n * p.value * p.value - 2 * p.value * a.s + a.q) AS dsum
       FROM lab p JOIN agg a ON a.feature = p.feature JOIN sz ON sz.cluster = a.cluster
       GROUP BY p.key, p.cluster, a.cluster),
pt AS (SELECT dd.key,
              max(CASE WHEN dd.c = dd.own THEN sz.n END) AS n_own,
              max(CASE WHEN dd.c = dd.own AND sz.n > 1 THEN dd.dsum / (sz.n - 1) END) AS a,
              min(CASE WHEN dd.c <> dd.own THEN dd.dsum / sz.n END) AS b
       FROM dd JOIN sz ON sz.cluster = dd.c GROUP BY dd.key)
SELECT round(avg(CASE WHEN n_own = 1 THEN 0.0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0.0 END), 6)
       AS silhouette_sq FROM pt"""


@query("silhouette_sq", _sil_sql("cluster_labels"))
def q_silhouette_sq(spark, sf):
    return _round(evaluate.silhouette_sq(_labelled(spark, sf), FEATURE_COLS), {"silhouette_sq"})


_DIST = "sqrt(" + " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in FEATURE_COLS) + ")"


@query("silhouette_exact", f"""
WITH p AS (SELECT f.*, l.cluster FROM features f JOIN cluster_labels l USING (key)),
sz AS (SELECT cluster, count(*) AS m FROM p GROUP BY cluster),
s AS (SELECT a.key, a.cluster AS own, b.cluster AS c, sum({_DIST}) AS s FROM p a, p b WHERE a.key % 50 = 0 GROUP BY a.key, a.cluster, b.cluster),
ab AS (SELECT s.key, s.own, max(sz.m) FILTER (WHERE s.c = s.own) AS m, max(s.s / nullif(sz.m - 1, 0)) FILTER (WHERE s.c = s.own) AS a,
              min(s.s / sz.m) FILTER (WHERE s.c <> s.own) AS b FROM s JOIN sz ON sz.cluster = s.c GROUP BY s.key, s.own)
SELECT key, CAST(own AS BIGINT) AS cluster, round(CASE WHEN m = 1 OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM ab
""")
def q_silhouette_exact(spark, sf):
    out = evaluate.silhouette_samples(_labelled(spark, sf), FEATURE_COLS, queries=F.col("key") % 50 == 0)
    return _round(out, {"silhouette"})


@query("adjusted_rand", """
WITH j AS (SELECT a.cluster AS a, b.cluster AS b FROM cluster_labels a JOIN cluster_labels_b b USING (key)
           WHERE a.cluster <> -1 AND b.cluster <> -1),
c AS (SELECT a, b, count(*) AS nij FROM j GROUP BY a, b),
ra AS (SELECT sum(ai * (ai - 1) / 2.0) AS sa FROM (SELECT a, sum(nij) AS ai FROM c GROUP BY a) x),
rb AS (SELECT sum(bj * (bj - 1) / 2.0) AS sb FROM (SELECT b, sum(nij) AS bj FROM c GROUP BY b) y),
ix AS (SELECT sum(nij * (nij - 1) / 2.0) AS idx, sum(nij) AS n FROM c)
SELECT round(CASE WHEN (sa + sb) / 2.0 = sa * sb / (n * (n - 1) / 2.0) THEN 1.0
            ELSE (idx - sa * sb / (n * (n - 1) / 2.0)) / ((sa + sb) / 2.0 - sa * sb / (n * (n - 1) / 2.0)) END, 6)
       AS adjusted_rand
FROM ix, ra, rb
""")
def q_adjusted_rand(spark, sf):
    a, b = roles(spark, sf, "cluster_labels", "cluster_labels_b")
    return _round(evaluate.adjusted_rand(a, b), {"adjusted_rand"})




def _summary_sql(view: str, name: str) -> str:
    def clean(sql: str) -> str:
        return sql.replace(f"JOIN {view} l USING (key))", f"JOIN {view} l USING (key) WHERE l.cluster <> -1)")
    return f"""SELECT * FROM (
WITH sil AS ({clean(_sil_sql(view, ''))}),
db AS ({clean(_db_sql(view, ''))}),
ch AS ({clean(_ch_sql(view, ''))}),
st AS (SELECT count(*) AS n, sum(CASE WHEN cluster = -1 THEN 1 ELSE 0 END) AS noise,
              count(DISTINCT CASE WHEN cluster <> -1 THEN cluster END) AS k FROM {view})
SELECT '{name}' AS algorithm, CAST(k AS BIGINT) AS n_clusters, round(noise * 100.0 / n, 6) AS noise_pct,
       sil.silhouette_sq, db.davies_bouldin, ch.calinski_harabasz
FROM st, sil, db, ch) x"""


@query("metrics_summary", _summary_sql("cluster_labels", "given") + "\nUNION ALL\n"
       + _summary_sql("cluster_labels_b", "given_b"))
def q_metrics_summary(spark, sf):
    out = evaluate.metrics_summary(_labelled(spark, sf, "cluster_labels"), FEATURE_COLS, "given").unionByName(
        evaluate.metrics_summary(_labelled(spark, sf, "cluster_labels_b"), FEATURE_COLS, "given_b"))
    return _round(out, {"noise_pct", "silhouette_sq", "davies_bouldin", "calinski_harabasz"})


_LOS = ("los AS (SELECT admission_type AS cluster, "
        "date_diff('microsecond', admittime, dischtime) / CAST(86400000000 AS DOUBLE) AS v FROM admissions "
        "WHERE admission_type IS NOT NULL AND dischtime IS NOT NULL)")


@query("los_group_test", f"""WITH {_LOS},
d AS (SELECT '_' AS feature, cluster, v AS value FROM los),
cv AS (SELECT value, count(*) AS t FROM d GROUP BY value),
rk AS (SELECT value, t, sum(t) OVER (ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
              - t + (t + 1) / 2.0 AS r FROM cv),
rg AS (SELECT d.cluster, count(*) AS n, sum(rk.r) AS R FROM d JOIN rk USING (value) GROUP BY d.cluster),
tot AS (SELECT sum(n) AS N, sum(R * R / n) AS s FROM rg),
ties AS (SELECT sum(t * t * t - t) AS tie FROM cv)
SELECT 'kruskal' AS test,
       round((12.0 / (N * (N + 1)) * s - 3 * (N + 1)) / (1 - tie / (CAST(N AS DOUBLE) * N * N - N)), 6) AS statistic
FROM tot, ties
""")
def q_los_group_test(spark, sf):
    adm = role(spark, sf, "admissions")
    los = profile.length_of_stay(adm.withColumnRenamed("admission_type", "cluster"), "admittime", "dischtime",
                                 "cluster")
    return _round(stats.group_difference_test(los, "cluster", "length_of_stay", with_p=False), {"statistic"})
