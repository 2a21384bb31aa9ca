"""Clinical roles over the driver tables.

The engine's operators work on the clinical schema (patients, admissions,
orders, labs ...).  The test and benchmark tables are a TPC-H-like star
schema, so each clinical table is defined here as a view over them.  The
same SQL text is registered in Spark and prefixed as a CTE to every DuckDB
oracle query, so the mapping itself is never what a check compares -- only
the operator applied on top of it.

Views are written in the SQL subset both engines share.  Where the dialects
differ (array indexing) a view carries one text per engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from cohortlens.session import apply_runtime_defaults, checkpoint_dir

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)

N_EMBED = 64

_POE_ID = "CAST(l.l_orderkey AS STRING) || '-' || CAST(l.l_linenumber AS STRING)"
_PROVIDER = "CASE WHEN l.l_suppkey % 7 = 0 THEN NULL ELSE 'S' || CAST(l.l_suppkey AS STRING) END"

# name -> SQL (shared) or {"spark": ..., "duckdb": ...}; order = dependency order.
ROLE_SQL: dict[str, str | dict[str, str]] = {
    # patients: customers; age from the account balance, year group from the segment.
    "patients": """
SELECT c_custkey AS subject_id,
       CASE WHEN c_nationkey < 13 THEN 'F' ELSE 'M' END AS gender,
       CAST(floor(c_acctbal / 100) AS BIGINT) AS anchor_age,
       CAST(2000 + c_nationkey AS BIGINT) AS anchor_year,
       CASE c_mktsegment WHEN 'BUILDING' THEN '2017 - 2019'
                         WHEN 'AUTOMOBILE' THEN '2014 - 2016'
                         WHEN 'MACHINERY' THEN '2011 - 2013'
                         WHEN 'HOUSEHOLD' THEN '2008 - 2010' END AS anchor_year_group,
       CASE WHEN c_nationkey IN (3, 7) THEN TIMESTAMP '2020-06-30 00:00:00' END AS dod
FROM customer""",
    # admissions: one per order; discharge = last ship date of its lines.
    "admissions": """
SELECT o.o_custkey AS subject_id, o.o_orderkey AS hadm_id,
       o.o_orderdate AS admittime, d.dischtime AS dischtime,
       CASE WHEN o.o_totalprice > 250000 THEN d.dischtime END AS deathtime,
       CASE o.o_orderpriority WHEN '1-URGENT' THEN 'URGENT'
                              WHEN '2-HIGH' THEN 'EW EMER.'
                              WHEN '3-MEDIUM' THEN 'OBSERVATION ADMIT'
                              WHEN '4-NOT SPECIFIED' THEN NULL
                              ELSE 'SURGICAL SAME DAY ADMISSION' END AS admission_type,
       'P' || CAST(o.o_custkey % 97 AS STRING) AS admit_provider_id,
       CASE o.o_orderstatus WHEN 'F' THEN 'EMERGENCY ROOM' ELSE 'PHYSICIAN REFERRAL' END AS admission_location,
       CASE o.o_orderstatus WHEN 'F' THEN 'HOME' ELSE 'SKILLED NURSING FACILITY' END AS discharge_location,
       'Medicare' AS insurance, 'ENGLISH' AS language, 'SINGLE' AS marital_status, 'WHITE' AS race,
       o.o_orderdate - INTERVAL 2 HOURS AS edregtime, o.o_orderdate AS edouttime,
       CAST(CASE o.o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS SMALLINT) AS hospital_expire_flag
FROM orders o
LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS dischtime FROM lineitem GROUP BY l_orderkey) d
  ON o.o_orderkey = d.l_orderkey""",
    "transfers": """
SELECT o.o_custkey AS subject_id,
       CASE WHEN l.l_linenumber = 7 THEN NULL ELSE l.l_orderkey END AS hadm_id,
       l.l_orderkey * 8 + l.l_linenumber AS transfer_id,
       CASE l.l_linestatus WHEN 'O' THEN 'admit' ELSE 'transfer' END AS eventtype,
       CASE l.l_returnflag WHEN 'A' THEN 'Medicine' WHEN 'N' THEN 'Surgery' ELSE 'Cardiology' END AS careunit,
       l.l_shipdate AS intime, l.l_shipdate + INTERVAL 1 DAYS AS outtime
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    "diagnoses_icd": """
SELECT o.o_custkey AS subject_id, l.l_orderkey AS hadm_id,
       CAST(l.l_linenumber AS BIGINT) AS seq_num,
       'E' || CAST(l.l_partkey AS STRING) AS icd_code,
       CAST(CASE WHEN l.l_partkey % 3 = 0 THEN 9 ELSE 10 END AS BIGINT) AS icd_version
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    "d_icd_diagnoses": """
SELECT 'E' || CAST(p_partkey AS STRING) AS icd_code,
       CAST(CASE WHEN p_partkey % 3 = 0 THEN 9 ELSE 10 END AS BIGINT) AS icd_version,
       p_name AS long_title
FROM part""",
    # provider orders: one per line item, order type = brand of the part.
    "poe": f"""
SELECT {_POE_ID} AS poe_id, CAST(l.l_linenumber AS BIGINT) AS poe_seq,
       o.o_custkey AS subject_id, l.l_orderkey AS hadm_id, l.l_shipdate AS ordertime,
       p.p_brand AS order_type, p.p_type AS order_subtype,
       CASE l.l_linestatus WHEN 'O' THEN 'New' ELSE 'Change' END AS transaction_type,
       CAST(NULL AS STRING) AS discontinue_of_poe_id, CAST(NULL AS STRING) AS discontinued_by_poe_id,
       {_PROVIDER} AS order_provider_id,
       CASE l.l_returnflag WHEN 'R' THEN 'Inactive' ELSE 'Active' END AS order_status
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey""",
    "poe_detail": f"""
SELECT {_POE_ID} AS poe_id, CAST(l.l_linenumber AS BIGINT) AS poe_seq, o.o_custkey AS subject_id,
       'Discharge Planning' AS field_name, l.l_returnflag || l.l_linestatus AS field_value
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
WHERE l.l_discount >= 0.05""",
    "prescriptions": f"""
SELECT o.o_custkey AS subject_id, l.l_orderkey AS hadm_id, l.l_partkey AS pharmacy_id,
       {_POE_ID} AS poe_id, CAST(l.l_linenumber AS BIGINT) AS poe_seq,
       {_PROVIDER} AS order_provider_id,
       l.l_shipdate AS starttime, l.l_shipdate + INTERVAL 3 DAYS AS stoptime,
       'MAIN' AS drug_type, 'D' || CAST(l.l_partkey AS STRING) AS drug,
       'F' || CAST(l.l_partkey AS STRING) AS formulary_drug_cd,
       CASE WHEN l.l_quantity > 25 THEN 'IV' ELSE 'PO' END AS route
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
WHERE l.l_tax >= 0.04""",
    "microbiologyevents": """
SELECT conv_id * 1000 + turn AS microevent_id, conv_id AS subject_id, turn AS test_seq,
       role AS org_name, text AS comments
FROM conversations""",
    "omr": """
SELECT o.o_custkey AS subject_id, l.l_shipdate AS chartdate, CAST(l.l_linenumber AS BIGINT) AS seq_num,
       CASE l.l_returnflag WHEN 'A' THEN 'Weight (Lbs)' WHEN 'N' THEN 'Height (Inches)' ELSE 'BMI (kg/m2)' END AS result_name,
       l.l_linestatus AS result_value
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    # lab events: every event is a measurement; the item is the value decile band.
    "labevents": """
SELECT event_id AS labevent_id, user_id AS subject_id, CAST(NULL AS BIGINT) AS hadm_id,
       CAST(floor(value / 10) AS BIGINT) AS itemid,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'L' || CAST(user_id % 13 AS STRING) END AS order_provider_id,
       ts AS charttime, value AS valuenum
FROM events""",
    # labs taken in a stay: one per line item, ordered by the line's provider (joins the merged study table).
    "hospital_labs": f"""
SELECT l.l_orderkey * 8 + l.l_linenumber AS labevent_id, o.o_custkey AS subject_id, l.l_orderkey AS hadm_id,
       CAST(l.l_partkey AS BIGINT) AS itemid, {_PROVIDER} AS order_provider_id,
       l.l_shipdate AS charttime, l.l_quantity AS valuenum
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    "d_labitems": """
SELECT p_partkey AS itemid, p_name AS label, p_type AS fluid, p_brand AS category FROM part""",
    # integer ids delivered as text with NA tokens and junk (for the NA rule).
    "raw_ids": """
SELECT event_id,
       CASE event_id % 10 WHEN 0 THEN '' WHEN 1 THEN 'NULL' WHEN 2 THEN 'null' WHEN 3 THEN 'None'
                          WHEN 4 THEN 'x' || CAST(user_id AS STRING)
                          WHEN 5 THEN ' ' || CAST(user_id AS STRING) || ' '
                          ELSE CAST(user_id AS STRING) END AS subject_id_text
FROM events""",
    # stays for the nearest-interval join: every signup opens a 12 hour stay.
    "stays": """
SELECT user_id AS subject_id, event_id AS hadm_id, ts AS admittime,
       ts + INTERVAL 12 HOURS AS dischtime
FROM events WHERE event_type = 'signup'""",
    # generic order stream for the feature operators.
    "order_events": """
SELECT user_id AS patient, event_id, event_type AS order_type, ts AS ordertime,
       min(CASE WHEN event_type = 'signup' THEN ts END) OVER (PARTITION BY user_id) AS admittime,
       max(ts) OVER (PARTITION BY user_id) AS dischtime
FROM events""",
    # numeric features (long form) and given cluster labels from the embeddings.
    "feature_long": {
        "spark": """
SELECT vec_id AS key, format_string('f%02d', pos) AS feature, CAST(v AS DOUBLE) AS value
FROM embeddings LATERAL VIEW posexplode(embedding) e AS pos, v""",
        "duckdb": """
SELECT vec_id AS key, printf('f%02d', i - 1) AS feature, CAST(embedding[i] AS DOUBLE) AS value
FROM embeddings, range(1, 65) r(i)""",
    },
    "features": {
        "spark": "SELECT vec_id AS key, "
                 + ", ".join(f"CAST(embedding[{i}] AS DOUBLE) AS f{i:02d}" for i in range(N_EMBED))
                 + " FROM embeddings",
        "duckdb": "SELECT vec_id AS key, "
                  + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS f{i:02d}" for i in range(N_EMBED))
                  + " FROM embeddings",
    },
    # eight features with holes (for imputation).
    "features_missing": {
        "spark": "SELECT vec_id AS key, "
                 + ", ".join(f"CASE WHEN (vec_id + {i}) % 13 = 0 THEN NULL ELSE CAST(embedding[{i}] AS DOUBLE) END AS f{i:02d}"
                             for i in range(8))
                 + " FROM embeddings",
        "duckdb": "SELECT vec_id AS key, "
                  + ", ".join(f"CASE WHEN (vec_id + {i}) % 13 = 0 THEN NULL ELSE CAST(embedding[{i + 1}] AS DOUBLE) END AS f{i:02d}"
                              for i in range(8))
                  + " FROM embeddings",
    },
    "cluster_labels": "SELECT vec_id AS key, label AS cluster FROM embeddings",
    # patients grouped by nation (given patient-level clusters).
    "patient_clusters": "SELECT c_custkey AS subject_id, CAST(c_nationkey % 5 AS INTEGER) AS cluster FROM customer",
    # a second clustering of the same rows (for agreement indices): the
    # label folded onto five groups, with one group marked noise.
    "cluster_labels_b": """
SELECT vec_id AS key, CASE WHEN label % 5 = 4 THEN -1 ELSE label % 5 END AS cluster FROM embeddings""",
    # two-class outcomes per document, clustered by language.
    "doc_outcomes": """
SELECT d.doc_id AS key, d.lang AS cluster_name, l.quality AS quality, l.toxic AS toxic,
       CAST(d.n_chars AS DOUBLE) AS n_chars
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
}

FEATURE_COLS = [f"f{i:02d}" for i in range(N_EMBED)]


def _sql_for(name: str, dialect: str) -> str:
    s = ROLE_SQL[name]
    return s if isinstance(s, str) else s[dialect]


def _deps(sql: str, names) -> list[str]:
    return [n for n in names if re.search(rf"\b{n}\b", sql)]


def role_names() -> list[str]:
    return list(ROLE_SQL)


def register_base(spark: SparkSession, sf_dir: str) -> None:
    """Register the parquet tables as temp views (scans stay lazy)."""
    for t in BASE_TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


_MARK = "cohortlens.roles.dir"


def register_roles(spark: SparkSession, sf_dir: str, force: bool = False) -> None:
    """Register base tables and role views for ``sf_dir`` (skipped when this
    session already has them for the same directory)."""
    apply_runtime_defaults(spark)
    checkpoint_dir(spark)   # shared folder for materialised intermediates (set here only if unset)
    if not force and spark.conf.get(_MARK, None) == sf_dir and spark.catalog.tableExists(list(ROLE_SQL)[-1]):
        return
    register_base(spark, sf_dir)
    for name in ROLE_SQL:
        spark.sql(_sql_for(name, "spark")).createOrReplaceTempView(name)
    spark.conf.set(_MARK, sf_dir)


def role(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One clinical table over the driver tables at ``sf_dir``."""
    register_roles(spark, sf_dir)
    return spark.table(name)


def roles(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    register_roles(spark, sf_dir)
    return [spark.table(n) for n in names]


def with_roles(sql: str, dialect: str = "duckdb") -> str:
    """Prefix ``sql`` with the CTEs of every role view it (transitively) uses."""
    names = list(ROLE_SQL)
    need: list[str] = []
    todo = _deps(sql, names)
    while todo:
        n = todo.pop()
        if n in need:
            continue
        need.append(n)
        todo.extend(d for d in _deps(_sql_for(n, dialect), names) if d != n)
    ordered = [n for n in names if n in need]
    if not ordered:
        return sql
    ctes = ",\n".join(f"{n} AS ({_sql_for(n, dialect)}\n)" for n in ordered)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[14:].lstrip()}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
