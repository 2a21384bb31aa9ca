"""Cohort rule and subject-selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import cohort
from cohortlens.plans.registry import query
from cohortlens.plans.roles import role, roles

STUDY_TABLES = ["patients", "admissions", "transfers", "diagnoses_icd", "d_icd_diagnoses",
                "poe", "poe_detail", "prescriptions"]

ADMISSION_COLS = ["subject_id", "hadm_id", "admittime", "dischtime", "deathtime", "admission_type",
                  "admit_provider_id", "admission_location", "discharge_location", "insurance",
                  "language", "marital_status", "race", "edregtime", "edouttime",
                  "hospital_expire_flag"]


@query("filter_patients", """
SELECT * FROM patients
WHERE anchor_age BETWEEN 18 AND 75 AND anchor_year_group IN ('2017 - 2019') AND dod IS NULL
""")
def q_filter_patients(spark, sf):
    return cohort.filter_patients(role(spark, sf, "patients"))


@query("filter_diagnoses", """
SELECT * FROM diagnoses_icd
WHERE icd_version IN (10) AND seq_num IN (1, 2, 3) AND icd_code LIKE 'E11%'
""")
def q_filter_diagnoses(spark, sf):
    return cohort.filter_diagnoses(role(spark, sf, "diagnoses_icd"))


@query("filter_icd_dict", "SELECT * FROM d_icd_diagnoses WHERE icd_version IN (10)")
def q_filter_icd_dict(spark, sf):
    return cohort.filter_icd_dictionary(role(spark, sf, "d_icd_diagnoses"))


@query("project_orders", """
SELECT poe_id, poe_seq, subject_id, hadm_id, ordertime, order_type, order_subtype, order_provider_id FROM poe
""")
def q_project_orders(spark, sf):
    return cohort.project_orders(role(spark, sf, "poe"), {"poe": {}})


@query("filter_admissions", """
SELECT subject_id, hadm_id, admittime, dischtime, deathtime, admission_type,
       admission_location, discharge_location, hospital_expire_flag
FROM admissions
WHERE admittime IS NOT NULL AND dischtime IS NOT NULL
  AND (deathtime IS NULL OR hospital_expire_flag = 0)
  AND dischtime > admittime
  AND NOT coalesce(admission_type IN ('EW EMER.', 'DIRECT EMER.', 'URGENT', 'ELECTIVE'), false)
""")
def q_filter_admissions(spark, sf):
    return cohort.filter_admissions(role(spark, sf, "admissions"))


@query("filter_transfers", "SELECT * FROM transfers WHERE hadm_id IS NOT NULL")
def q_filter_transfers(spark, sf):
    return cohort.filter_transfers(role(spark, sf, "transfers"))


@query("filter_microbiology", "SELECT microevent_id, subject_id, test_seq, org_name FROM microbiologyevents")
def q_filter_microbiology(spark, sf):
    return cohort.filter_microbiology(role(spark, sf, "microbiologyevents"))


@query("filter_labevents", """
SELECT labevent_id, subject_id, hadm_id, itemid, order_provider_id, charttime FROM labevents
""")
def q_filter_labevents(spark, sf):
    return cohort.filter_labevents(role(spark, sf, "labevents"))


@query("filter_prescriptions", """
SELECT subject_id, hadm_id, poe_id, poe_seq, order_provider_id, drug, route FROM prescriptions
""")
def q_filter_prescriptions(spark, sf):
    return cohort.filter_prescriptions(role(spark, sf, "prescriptions"))


@query("filter_omr", "SELECT * FROM omr WHERE seq_num IN (1, 2, 3)")
def q_filter_omr(spark, sf):
    return cohort.filter_omr(role(spark, sf, "omr"))


# ------------------------------------------------------------------- F11
@query("semi_join_subjects", """
SELECT * FROM poe WHERE subject_id IN
  (SELECT subject_id FROM patients
   WHERE anchor_age BETWEEN 18 AND 75 AND anchor_year_group IN ('2017 - 2019') AND dod IS NULL)
""")
def q_semi_join_subjects(spark, sf):
    poe, patients = roles(spark, sf, "poe", "patients")
    return cohort.rows_for_subjects(poe, cohort.filter_patients(patients))


# ------------------------------------------------------------------- F12
CRITERIA = cohort.CohortCriteria(
    encounter_start="1996-01-01 00:00:00", encounter_end="2000-12-31 00:00:00",
    age_min=20, age_max=70, diagnosis_prefixes=["E1"],
    admission_types=["OBSERVATION ADMIT", "SURGICAL SAME DAY ADMISSION"],
    required_units=["Medicine"], valid_times=True)


@query("cohort_criteria", """
SELECT a.* FROM admissions a
WHERE a.admittime >= TIMESTAMP '1996-01-01 00:00:00' AND a.admittime <= TIMESTAMP '2000-12-31 00:00:00'
  AND a.admission_type IN ('OBSERVATION ADMIT', 'SURGICAL SAME DAY ADMISSION')
  AND a.admittime IS NOT NULL AND a.dischtime IS NOT NULL AND a.dischtime > a.admittime
  AND a.subject_id IN (SELECT subject_id FROM patients WHERE anchor_age >= 20 AND anchor_age <= 70)
  AND EXISTS (SELECT 1 FROM diagnoses_icd d
              WHERE d.subject_id = a.subject_id AND d.hadm_id = a.hadm_id AND d.icd_code LIKE 'E1%')
  AND EXISTS (SELECT 1 FROM transfers t
              WHERE t.subject_id = a.subject_id AND t.hadm_id = a.hadm_id AND t.careunit IN ('Medicine'))
""")
def q_cohort_criteria(spark, sf):
    adm, pat, dia, tra = roles(spark, sf, "admissions", "patients", "diagnoses_icd", "transfers")
    return cohort.cohort_criteria(adm, CRITERIA, patients=pat, diagnoses=dia, transfers=tra)


# ------------------------------------------------------------- F17 / F18
@query("dropna_rows", "SELECT * FROM admissions WHERE "
       + " AND ".join(f"{c} IS NOT NULL" for c in ADMISSION_COLS))
def q_dropna_rows(spark, sf):
    return cohort.drop_null_rows(role(spark, sf, "admissions"))


@query("noise_exclusion", "SELECT * FROM cluster_labels_b WHERE cluster <> -1")
def q_noise_exclusion(spark, sf):
    return cohort.exclude_noise(role(spark, sf, "cluster_labels_b"))


@query("noise_relabel", """
SELECT key, CASE WHEN cluster = -1 THEN 'Noise' ELSE CAST(cluster AS VARCHAR) END AS cluster
FROM cluster_labels_b
""")
def q_noise_relabel(spark, sf):
    return cohort.label_noise(role(spark, sf, "cluster_labels_b"))


# ---------------------------------------------------- A1 / S7 / U1 / O4 / J13
@query("distinct_subjects", "SELECT DISTINCT subject_id FROM poe WHERE subject_id IS NOT NULL")
def q_distinct_subjects(spark, sf):
    return cohort.distinct_subjects(role(spark, sf, "poe"))


@query("subject_ids_full", "SELECT DISTINCT subject_id FROM admissions WHERE subject_id IS NOT NULL")
def q_subject_ids_full(spark, sf):
    return cohort.distinct_subjects(role(spark, sf, "admissions"))


_INTERSECT_SQL = "\nINTERSECT\n".join(
    f"SELECT subject_id FROM {t} WHERE subject_id IS NOT NULL"
    for t in STUDY_TABLES if t != "d_icd_diagnoses")


@query("subject_intersection", _INTERSECT_SQL)
def q_subject_intersection(spark, sf):
    return cohort.subject_intersection(roles(spark, sf, *STUDY_TABLES))


@query("sample_subjects", f"SELECT subject_id FROM ({_INTERSECT_SQL}) s ORDER BY subject_id LIMIT 100")
def q_sample_subjects(spark, sf):
    return cohort.first_subjects(cohort.subject_intersection(roles(spark, sf, *STUDY_TABLES)), 100)


@query("sampled_tables", f"""
SELECT 'admissions' AS table_name, count(*) AS n_rows FROM admissions
 WHERE subject_id IN (SELECT subject_id FROM ({_INTERSECT_SQL}) s ORDER BY subject_id LIMIT 100)
UNION ALL
SELECT 'poe', count(*) FROM poe
 WHERE subject_id IN (SELECT subject_id FROM ({_INTERSECT_SQL}) s ORDER BY subject_id LIMIT 100)
UNION ALL
SELECT 'd_icd_diagnoses', count(*) FROM d_icd_diagnoses
""")
def q_sampled_tables(spark, sf):
    tabs = dict(zip(STUDY_TABLES, roles(spark, sf, *STUDY_TABLES)))
    ids = cohort.first_subjects(cohort.subject_intersection(list(tabs.values())), 100)
    restricted = cohort.restrict_tables({k: tabs[k] for k in ("admissions", "poe", "d_icd_diagnoses")}, ids)
    parts = [t.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows")
             for n, t in restricted.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("table_counter", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, count(*) AS n_rows, count(DISTINCT subject_id) AS n_subjects FROM {t}"
    for t in STUDY_TABLES if t != "d_icd_diagnoses"))
def q_table_counter(spark, sf):
    tabs = dict(zip(STUDY_TABLES, roles(spark, sf, *STUDY_TABLES)))
    return cohort.table_counter({k: v for k, v in tabs.items() if "subject_id" in v.columns})


ORDER_CRITERIA = cohort.CohortCriteria(
    admission_locations=["EMERGENCY ROOM"], order_types=["Brand#13", "Brand#21", "Brand#34"],
    transaction_types=["New"])


@query("cohort_criteria_orders", """
SELECT a.* FROM admissions a
WHERE a.admission_location IN ('EMERGENCY ROOM')
  AND EXISTS (SELECT 1 FROM poe o
              WHERE o.subject_id = a.subject_id AND o.hadm_id = a.hadm_id
                AND o.order_type IN ('Brand#13', 'Brand#21', 'Brand#34') AND o.transaction_type IN ('New'))
""")
def q_cohort_criteria_orders(spark, sf):
    adm, poe = roles(spark, sf, "admissions", "poe")
    return cohort.cohort_criteria(adm, ORDER_CRITERIA, orders=poe)
