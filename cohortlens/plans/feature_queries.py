"""Order-pattern feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import features
from cohortlens.plans.registry import query, r6
from cohortlens.plans.roles import role

# =========================================================== A5 order timing
ORDER_TIMING_SQL = """
SELECT patient,
       min(ordertime) AS first_order_time,
       max(ordertime) AS last_order_time,
       count(order_type) AS total_orders,
       count(DISTINCT order_type) AS unique_order_types,
       CAST(sum(CASE WHEN ordertime <= admittime + INTERVAL 24 HOURS THEN 1 ELSE 0 END) AS BIGINT) AS orders_in_first_24h,
       CAST(sum(CASE WHEN ordertime <= admittime + INTERVAL 48 HOURS THEN 1 ELSE 0 END) AS BIGINT) AS orders_in_first_48h,
       CAST(sum(CASE WHEN ordertime <= admittime + INTERVAL 72 HOURS THEN 1 ELSE 0 END) AS BIGINT) AS orders_in_first_72h,
       CAST(sum(CASE WHEN ordertime >= dischtime - INTERVAL 24 HOURS THEN 1 ELSE 0 END) AS BIGINT) AS orders_in_last_24h,
       CAST(sum(CASE WHEN ordertime >= dischtime - INTERVAL 48 HOURS THEN 1 ELSE 0 END) AS BIGINT) AS orders_in_last_48h,
       date_diff('microsecond', min(ordertime), max(ordertime)) / CAST(3600000000 AS DOUBLE) AS order_span_hours,
       date_diff('microsecond', min(admittime), min(ordertime)) / CAST(3600000000 AS DOUBLE)
           AS time_to_first_order_hours,
       date_diff('microsecond', max(ordertime), min(dischtime)) / CAST(3600000000 AS DOUBLE)
           AS time_from_last_order_to_discharge_hours
FROM order_events WHERE patient IS NOT NULL GROUP BY patient
"""


@query("order_timing", ORDER_TIMING_SQL)
def q_order_timing(spark, sf):
    ev = role(spark, sf, "order_events")
    return features.order_timing(ev, "patient", "order_type", "ordertime", "admittime", "dischtime")


# ===================================================== A2 / A3 frequency matrix
_TOP_POE = """top AS (SELECT order_type, count(*) AS n FROM poe WHERE order_type IS NOT NULL
                GROUP BY order_type ORDER BY n DESC, order_type LIMIT 20)"""
ORDER_FREQ_SQL = f"""
WITH {_TOP_POE},
cnt AS (SELECT p.subject_id, p.order_type, count(*) AS n FROM poe p JOIN top t ON p.order_type = t.order_type
        WHERE p.subject_id IS NOT NULL GROUP BY p.subject_id, p.order_type),
pats AS (SELECT DISTINCT subject_id FROM cnt)
SELECT pa.subject_id, t.order_type, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM pats pa CROSS JOIN top t
LEFT JOIN cnt c ON c.subject_id = pa.subject_id AND c.order_type = t.order_type
"""
ORDER_FREQ_NORM_SQL = f"""
WITH {_TOP_POE},
cnt AS (SELECT p.subject_id, p.order_type, count(*) AS n FROM poe p JOIN top t ON p.order_type = t.order_type
        WHERE p.subject_id IS NOT NULL GROUP BY p.subject_id, p.order_type),
tot AS (SELECT subject_id, sum(n) AS s FROM cnt GROUP BY subject_id)
SELECT pa.subject_id, t.order_type, coalesce(c.n, 0) / pa.s AS proportion
FROM tot pa CROSS JOIN top t
LEFT JOIN cnt c ON c.subject_id = pa.subject_id AND c.order_type = t.order_type
"""


@query("order_frequency", ORDER_FREQ_SQL)
def q_order_frequency(spark, sf):
    return features.order_frequency(role(spark, sf, "poe"), "subject_id", "order_type", top_n=20)


def _numbered(df, prefix):
    """A matrix with its value columns named by their place."""
    return df.toDF(df.columns[0], *[f"{prefix}{i:02d}" for i in range(1, len(df.columns))])


@query("order_frequency_wide", f"""
WITH {_TOP_POE},
kept AS (SELECT p.subject_id, t.r FROM poe p JOIN (SELECT order_type, row_number() OVER (ORDER BY n DESC, order_type) AS r FROM top) t
         USING (order_type) WHERE p.subject_id IS NOT NULL)
SELECT subject_id, """ + ", ".join(f"count(*) FILTER (r = {i}) AS o{i:02d}" for i in range(1, 21)) + """
FROM kept GROUP BY subject_id
""")
def q_order_frequency_wide(spark, sf):
    return _numbered(features.order_frequency_wide(role(spark, sf, "poe"), "subject_id", "order_type", top_n=20), "o")


@query("order_frequency_norm", ORDER_FREQ_NORM_SQL)
def q_order_frequency_norm(spark, sf):
    return features.order_frequency(role(spark, sf, "poe"), "subject_id", "order_type", top_n=20,
                                    normalize=True)


# ================================================================ A4 / A6
@query("order_dist_overall", """
SELECT order_type, count(*) AS n, count(*) / (SELECT count(*) FROM poe WHERE order_type IS NOT NULL) AS proportion
FROM poe WHERE order_type IS NOT NULL GROUP BY order_type
""")
def q_order_dist_overall(spark, sf):
    return features.order_distribution_overall(role(spark, sf, "poe"), "order_type")


@query("order_dist_patient", """
SELECT subject_id, order_type, count(*) AS n,
       count(*) / sum(count(*)) OVER (PARTITION BY subject_id) AS proportion
FROM poe WHERE order_type IS NOT NULL AND subject_id IS NOT NULL GROUP BY subject_id, order_type
""")
def q_order_dist_patient(spark, sf):
    return features.order_distribution_patient(role(spark, sf, "poe"), "subject_id", "order_type")


@query("order_dist_patient_wide", """
WITH dist AS (SELECT subject_id, order_type, count(*) / sum(count(*)) OVER (PARTITION BY subject_id) AS proportion
              FROM poe WHERE order_type IS NOT NULL AND subject_id IS NOT NULL GROUP BY subject_id, order_type),
types AS (SELECT order_type, row_number() OVER (ORDER BY order_type) AS r FROM (SELECT DISTINCT order_type FROM dist) s)
SELECT subject_id, """ + ", ".join(f"coalesce(max(proportion) FILTER (r = {i}), 0.0) AS t{i:02d}" for i in range(1, 26)) + """
FROM dist JOIN types USING (order_type) GROUP BY subject_id
""")
def q_order_dist_patient_wide(spark, sf):
    long = features.order_distribution_patient(role(spark, sf, "poe"), "subject_id", "order_type")
    return _numbered(features.to_wide(long.drop("n"), "subject_id", "order_type", "proportion"), "t")


# ======================================================== W1 / A8 sequences
@query("order_sequences", """
SELECT patient, list(order_type ORDER BY ordertime NULLS LAST, event_id) AS sequence
FROM (SELECT *, row_number() OVER (PARTITION BY patient ORDER BY ordertime NULLS LAST, event_id) AS rn
      FROM order_events WHERE patient IS NOT NULL) s
WHERE rn <= 20 GROUP BY patient
""")
def q_order_sequences(spark, sf):
    return features.order_sequences(role(spark, sf, "order_events"), "patient", "order_type",
                                    "ordertime", 20, tiebreak="event_id")


def _poe_sequences(spark, sf):
    return features.order_sequences(role(spark, sf, "poe"), "subject_id", "order_type", "ordertime",
                                    20, tiebreak=["poe_id", "order_type"])


_POE_SEQ_ITEMS = """
ranked AS (SELECT subject_id AS patient, order_type AS item,
                  row_number() OVER (PARTITION BY subject_id ORDER BY ordertime NULLS LAST, poe_id, order_type) AS rn
           FROM poe WHERE subject_id IS NOT NULL),
seqitems AS (SELECT * FROM ranked WHERE rn <= 20)"""


@query("order_sequences_poe", f"""
WITH {_POE_SEQ_ITEMS}
SELECT patient AS subject_id, list(item ORDER BY rn) AS sequence FROM seqitems GROUP BY patient
""")
def q_order_sequences_poe(spark, sf):
    return _poe_sequences(spark, sf)


@query("sequence_stats", """
SELECT count(*) AS n_patients, round(avg(CAST(len AS DOUBLE)), 6) AS mean_length
FROM (SELECT subject_id, count(*) AS len FROM poe WHERE subject_id IS NOT NULL GROUP BY subject_id) s
""")
def q_sequence_stats(spark, sf):
    st = features.history_stats(role(spark, sf, "poe"), "subject_id")
    return st.select("n_patients", r6(F.col("mean_length")).alias("mean_length"))


# =============================================================== A7 / W2
_TRANSITIONS_TAIL = """
top AS (SELECT item, count(*) AS n FROM seqitems WHERE item IS NOT NULL
        GROUP BY item ORDER BY n DESC, item LIMIT 20),
kept AS (SELECT s.patient, s.item, row_number() OVER (PARTITION BY s.patient ORDER BY s.rn) AS k
         FROM seqitems s JOIN top t ON s.item = t.item),
pairs AS (SELECT a.item AS from_order, b.item AS to_order, count(*) AS n
          FROM kept a JOIN kept b ON a.patient = b.patient AND b.k = a.k + 1 GROUP BY a.item, b.item),
grid AS (SELECT f.item AS from_order, t.item AS to_order, coalesce(p.n, 0) AS n
         FROM top f CROSS JOIN top t LEFT JOIN pairs p ON p.from_order = f.item AND p.to_order = t.item)
SELECT from_order, to_order, CAST(n AS BIGINT) AS n,
       CASE WHEN sum(n) OVER (PARTITION BY from_order) > 0
            THEN n / sum(n) OVER (PARTITION BY from_order) ELSE 0.0 END AS probability
FROM grid
"""


_POE_HISTORY = """
seqitems AS (SELECT subject_id AS patient, order_type AS item,
                    row_number() OVER (PARTITION BY subject_id ORDER BY ordertime NULLS LAST, poe_id, order_type) AS rn
             FROM poe WHERE subject_id IS NOT NULL)"""


def _poe_transitions(spark, sf):
    return features.history_transitions(role(spark, sf, "poe"), "subject_id", "order_type", "ordertime", 20,
                                        tiebreak=["poe_id", "order_type"])


@query("order_transitions", f"WITH {_POE_HISTORY},{_TRANSITIONS_TAIL}")
def q_order_transitions(spark, sf):
    return _poe_transitions(spark, sf)


@query("order_transitions_wide", f"WITH {_POE_HISTORY},{_TRANSITIONS_TAIL}".replace("SELECT from_order, to_order, CAST(n AS BIGINT)", """, prob AS (
SELECT from_order, to_order, CAST(n AS BIGINT)""").rstrip() + """),
place AS (SELECT item AS to_order, row_number() OVER (ORDER BY n DESC, item) AS r FROM top)
SELECT from_order, """ + ", ".join(f"max(probability) FILTER (r = {i}) AS t{i:02d}" for i in range(1, 21)) + """
FROM prob JOIN place USING (to_order) GROUP BY from_order
""")
def q_order_transitions_wide(spark, sf):
    poe = role(spark, sf, "poe")
    top = features.top_value_list(poe.where(F.col("subject_id").isNotNull()), "order_type", 20)
    return _numbered(features.to_wide(_poe_transitions(spark, sf).drop("n"), "from_order", "to_order", "probability", values=top), "t")


@query("order_transitions_events", """
WITH seqitems AS (SELECT patient, order_type AS item,
                         row_number() OVER (PARTITION BY patient ORDER BY ordertime NULLS LAST, event_id) AS rn
                  FROM order_events WHERE patient IS NOT NULL),""" + _TRANSITIONS_TAIL)
def q_order_transitions_events(spark, sf):
    return features.history_transitions(role(spark, sf, "order_events"), "patient", "order_type", "ordertime", 20, tiebreak="event_id")


# ===================================================================== O2
@query("top_orders", """
SELECT order_type, count(*) AS n FROM poe WHERE order_type IS NOT NULL
GROUP BY order_type ORDER BY n DESC, order_type LIMIT 20
""")
def q_top_orders(spark, sf):
    return features.top_values(role(spark, sf, "poe"), "order_type", 20)
