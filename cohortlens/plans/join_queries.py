"""Study-join queries (J1-J12, J14, join cardinality)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from cohortlens.operators import cohort, idsets, joins
from cohortlens.plans.registry import query
from cohortlens.plans.roles import roles
from cohortlens.session import Scratch

POE_COLS = ["poe_id", "poe_seq", "subject_id", "hadm_id", "ordertime", "order_type", "order_subtype",
            "transaction_type", "discontinue_of_poe_id", "discontinued_by_poe_id", "order_provider_id",
            "order_status"]
RX_COLS = ["subject_id", "hadm_id", "pharmacy_id", "poe_id", "poe_seq", "order_provider_id", "starttime",
           "stoptime", "drug_type", "drug", "formulary_drug_cd", "route"]
RX_KEYS = ["subject_id", "hadm_id", "poe_id", "poe_seq", "order_provider_id"]


@query("join_patients_admissions", "SELECT * FROM patients JOIN admissions USING (subject_id)")
def q_join_patients_admissions(spark, sf):
    p, a = roles(spark, sf, "patients", "admissions")
    return joins.merge_two(p, a, "subject_id")


@query("join_transfers", """
SELECT * FROM patients JOIN admissions USING (subject_id) JOIN transfers USING (subject_id, hadm_id)
""")
def q_join_transfers(spark, sf):
    p, a, t = roles(spark, sf, "patients", "admissions", "transfers")
    return joins.merge_two(joins.merge_two(p, a, "subject_id"), t, ["subject_id", "hadm_id"])


@query("join_diagnosis_dict", "SELECT * FROM diagnoses_icd JOIN d_icd_diagnoses USING (icd_code, icd_version)")
def q_join_diagnosis_dict(spark, sf):
    d, dd = roles(spark, sf, "diagnoses_icd", "d_icd_diagnoses")
    return joins.attach_dictionary(d, dd, ["icd_code", "icd_version"], "inner")


@query("join_order_detail", "SELECT * FROM poe JOIN poe_detail USING (poe_id, poe_seq, subject_id)")
def q_join_order_detail(spark, sf):
    p, d = roles(spark, sf, "poe", "poe_detail")
    return joins.merge_two(p, d, ["poe_id", "poe_seq", "subject_id"], "inner")


@query("join_order_detail_left", "SELECT * FROM poe LEFT JOIN poe_detail USING (poe_id, poe_seq, subject_id)")
def q_join_order_detail_left(spark, sf):
    p, d = roles(spark, sf, "poe", "poe_detail")
    return joins.merge_two(p, d, ["poe_id", "poe_seq", "subject_id"], "left")


_RX_REST = [c for c in RX_COLS if c not in RX_KEYS]


@query("join_left_multikey", "SELECT p.*, " + ", ".join(f"r.{c}" for c in _RX_REST) + """
FROM poe p LEFT JOIN prescriptions r
  ON p.subject_id = r.subject_id AND p.hadm_id = r.hadm_id AND p.poe_id = r.poe_id
 AND p.poe_seq = r.poe_seq AND p.order_provider_id IS NOT DISTINCT FROM r.order_provider_id
""")
def q_join_left_multikey(spark, sf):
    p, r = roles(spark, sf, "poe", "prescriptions")
    return joins.merge_two(p, r, RX_KEYS, "left", null_keys_match=["order_provider_id"])


@query("join_labs", "SELECT * FROM labevents JOIN d_labitems USING (itemid)")
def q_join_labs(spark, sf):
    l, d = roles(spark, sf, "labevents", "d_labitems")
    return joins.attach_dictionary(l, d, "itemid", "inner")


# ------------------------------------------------------------------ J10
def _j10_sql(how: str) -> str:
    common = [c for c in POE_COLS if c in RX_COLS and c != "poe_id"]
    key = "coalesce(p.poe_id, r.poe_id)" if how == "FULL OUTER" else ("r.poe_id" if how == "RIGHT" else "p.poe_id")
    cols = [f"{key} AS poe_id"]
    cols += [f"p.{c} AS {c}_x" if c in common else f"p.{c}" for c in POE_COLS if c != "poe_id"]
    cols += [f"r.{c} AS {c}_y" if c in common else f"r.{c}" for c in RX_COLS if c != "poe_id"]
    return f"SELECT {', '.join(cols)} FROM poe p {how} JOIN prescriptions r ON p.poe_id = r.poe_id"


for _how, _sql_how in (("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT"), ("outer", "FULL OUTER")):
    def _make(h):
        def fn(spark, sf):
            p, r = roles(spark, sf, "poe", "prescriptions")
            return joins.merge_two(p, r, "poe_id", h, harmonize=True)
        return fn
    query(f"join_{_how}", _j10_sql(_sql_how))(_make(_how))


# ------------------------------------------------------------------ J9
_FILTERED = """
fp AS (SELECT * FROM patients
       WHERE anchor_age BETWEEN 18 AND 75 AND anchor_year_group IN ('2017 - 2019') AND dod IS NULL),
fa AS (SELECT subject_id, hadm_id, admittime, dischtime, deathtime, admission_type,
              admission_location, discharge_location, hospital_expire_flag
       FROM admissions
       WHERE admittime IS NOT NULL AND dischtime IS NOT NULL
         AND (deathtime IS NULL OR hospital_expire_flag = 0) AND dischtime > admittime
         AND NOT coalesce(admission_type IN ('EW EMER.', 'DIRECT EMER.', 'URGENT', 'ELECTIVE'), false)),
ft AS (SELECT * FROM transfers WHERE hadm_id IS NOT NULL),
fd AS (SELECT * FROM diagnoses_icd WHERE icd_version IN (10) AND seq_num IN (1, 2, 3) AND icd_code LIKE 'E11%'),
fdict AS (SELECT * FROM d_icd_diagnoses WHERE icd_version IN (10)),
fpoe AS (SELECT poe_id, poe_seq, subject_id, hadm_id, ordertime, order_type, order_subtype, order_provider_id FROM poe),
frx AS (SELECT subject_id, hadm_id, poe_id, poe_seq, order_provider_id, drug, route FROM prescriptions),
m1 AS (SELECT * FROM fp JOIN fa USING (subject_id)),
m2 AS (SELECT * FROM m1 JOIN ft USING (subject_id, hadm_id)),
dg AS (SELECT * FROM fd JOIN fdict USING (icd_code, icd_version)),
m3 AS (SELECT * FROM m2 JOIN dg USING (subject_id, hadm_id)),
od AS (SELECT * FROM fpoe JOIN poe_detail USING (poe_id, poe_seq, subject_id)),
m4 AS (SELECT * FROM m3 JOIN od USING (subject_id, hadm_id)),
m5 AS (SELECT m4.*, r.drug, r.route FROM m4 LEFT JOIN frx r
         ON m4.subject_id = r.subject_id AND m4.hadm_id = r.hadm_id AND m4.poe_id = r.poe_id
        AND m4.poe_seq = r.poe_seq AND m4.order_provider_id IS NOT DISTINCT FROM r.order_provider_id)"""


def _filtered_tables(spark, sf):
    names = ["patients", "admissions", "transfers", "diagnoses_icd", "d_icd_diagnoses", "poe",
             "poe_detail", "prescriptions"]
    return {n: cohort.apply_table_rules(n, t, {"poe": {}}) for n, t in zip(names, roles(spark, sf, *names))}


@query("merged_table", f"WITH {_FILTERED}\nSELECT * FROM m5")
def q_merged_table(spark, sf):
    t = _filtered_tables(spark, sf)
    return joins.merged_table(t["patients"], t["admissions"], t["transfers"], t["diagnoses_icd"],
                              t["d_icd_diagnoses"], t["poe"], t["poe_detail"], t["prescriptions"])


@query("join_merged_labs", f"""WITH {_FILTERED},
lab AS (SELECT * FROM hospital_labs JOIN d_labitems USING (itemid))
SELECT * FROM m5 JOIN lab USING (subject_id, hadm_id, order_provider_id)
""")
def q_join_merged_labs(spark, sf):
    t = _filtered_tables(spark, sf)
    labs, items = roles(spark, sf, "hospital_labs", "d_labitems")
    return joins.merged_table(t["patients"], t["admissions"], t["transfers"], t["diagnoses_icd"], t["d_icd_diagnoses"], t["poe"],
                              t["poe_detail"], t["prescriptions"], labs, items)


@query("join_cardinality", f"""WITH {_FILTERED}
SELECT 'patients_admissions' AS stage, count(*) AS n_rows FROM m1
UNION ALL SELECT 'with_transfers', count(*) FROM m2
UNION ALL SELECT 'diagnoses_dictionary', count(*) FROM dg
UNION ALL SELECT 'with_diagnoses', count(*) FROM m3
UNION ALL SELECT 'orders_detail', count(*) FROM od
UNION ALL SELECT 'with_orders', count(*) FROM m4
UNION ALL SELECT 'with_prescriptions', count(*) FROM m5
""")
def q_join_cardinality(spark, sf):
    t = _filtered_tables(spark, sf)
    stages = joins.merge_stages(t["patients"], t["admissions"], t["transfers"], t["diagnoses_icd"],
                                t["d_icd_diagnoses"], t["poe"], t["poe_detail"], t["prescriptions"])
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("stage"), "n_rows")
             for n, df in stages.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


# ------------------------------------------------------------ J11 / J12
_NEAREST = """
cand AS (SELECT l.labevent_id, l.subject_id, l.itemid, l.charttime, l.valuenum,
                s.hadm_id, s.admittime, s.dischtime,
                row_number() OVER (PARTITION BY l.labevent_id
                                   ORDER BY abs(date_diff('microsecond', l.charttime, s.admittime)),
                                            s.admittime, s.hadm_id) AS rn
         FROM labevents l JOIN stays s ON l.subject_id = s.subject_id
         WHERE l.charttime IS NOT NULL AND s.dischtime IS NOT NULL
           AND s.admittime - INTERVAL 24 HOURS <= l.charttime
           AND l.charttime <= s.dischtime + INTERVAL 24 HOURS),
nearest AS (SELECT labevent_id, subject_id, itemid, charttime, valuenum, hadm_id, admittime, dischtime
            FROM cand WHERE rn = 1)"""


@query("nearest_admission", f"WITH {_NEAREST}\nSELECT * FROM nearest")
def q_nearest_admission(spark, sf):
    l, s = roles(spark, sf, "labevents", "stays")
    return joins.nearest_admission(l, s)


@query("nearest_admission_dict", f"WITH {_NEAREST}\nSELECT * FROM nearest LEFT JOIN d_labitems USING (itemid)")
def q_nearest_admission_dict(spark, sf):
    l, s, d = roles(spark, sf, "labevents", "stays", "d_labitems")
    return joins.attach_dictionary(joins.nearest_admission(l, s), d, "itemid", "left")


# ------------------------------------------------------------------ J14
@query("align_labels", "SELECT * FROM features JOIN cluster_labels_b USING (key)")
def q_align_labels(spark, sf):
    f, l = roles(spark, sf, "features", "cluster_labels_b")
    return joins.align_labels(f, l)


# --------------------------------------------------- study cohort (J9 + U1 + O4 + J13)
_STUDY_IDS = """
ids AS (SELECT subject_id FROM (
          SELECT subject_id FROM fp WHERE subject_id IS NOT NULL INTERSECT
          SELECT subject_id FROM fa WHERE subject_id IS NOT NULL INTERSECT
          SELECT subject_id FROM ft WHERE subject_id IS NOT NULL INTERSECT
          SELECT subject_id FROM fd WHERE subject_id IS NOT NULL INTERSECT
          SELECT subject_id FROM fpoe WHERE subject_id IS NOT NULL INTERSECT
          SELECT subject_id FROM poe_detail WHERE subject_id IS NOT NULL INTERSECT
          SELECT subject_id FROM frx WHERE subject_id IS NOT NULL) s
        ORDER BY subject_id LIMIT 25)"""


@query("study_cohort", f"WITH {_FILTERED},{_STUDY_IDS}\nSELECT * FROM m5 WHERE subject_id IN (SELECT subject_id FROM ids)")
def q_study_cohort(spark, sf):
    from cohortlens.plans.study import STUDY_TABLES, study_cohort
    return study_cohort(dict(zip(STUDY_TABLES, roles(spark, sf, *STUDY_TABLES))), n_subjects=25)


@query("admission_cohort", f"""WITH {_NEAREST}
SELECT * FROM nearest LEFT JOIN d_labitems USING (itemid)
WHERE subject_id IN (SELECT subject_id FROM patients
                     WHERE anchor_age BETWEEN 18 AND 75 AND anchor_year_group IN ('2017 - 2019') AND dod IS NULL)""")
def q_admission_cohort(spark, sf):
    from cohortlens.plans.study import admission_cohort
    l, s, d, p = roles(spark, sf, "labevents", "stays", "d_labitems", "patients")
    return admission_cohort(l, s, d, subjects=cohort.filter_patients(p).select("subject_id"))


# --------------------------------------------------- id bitmaps (F11 + U1 + J13 + S8)
# what each study table is after its rule, and the subjects that all of them have
_RESTRICTED = {"patients": "fp", "admissions": "fa", "transfers": "ft", "diagnoses_icd": "fd", "d_icd_diagnoses": "fdict", "poe": "fpoe",
               "poe_detail": "poe_detail", "prescriptions": "frx"}
_ALL_IDS = "ids AS (" + " INTERSECT ".join(f"SELECT subject_id FROM {t} WHERE subject_id IS NOT NULL"
                                           for n, t in _RESTRICTED.items() if n != "d_icd_diagnoses") + ")"


def _study_bitmap(spark, tables):
    """Bitmap of the subjects that every filtered table has, stored."""
    return Scratch(spark, "study-ids").keep(idsets.intersect_bitmaps([idsets.id_bitmap(t) for t in tables.values() if "subject_id" in t.columns]))


@query("bitmap_intersection", f"WITH {_FILTERED},{_ALL_IDS}\nSELECT subject_id FROM ids")
def q_bitmap_intersection(spark, sf):
    return idsets.ids_of(_study_bitmap(spark, _filtered_tables(spark, sf)))


for _name, _filtered in _RESTRICTED.items():
    def _make_restricted(name):
        def fn(spark, sf):
            tables = _filtered_tables(spark, sf)
            return idsets.restrict_tables({name: tables[name]}, _study_bitmap(spark, tables))[name]
        return fn
    _whole = _name == "d_icd_diagnoses"        # a dictionary has no subjects
    query(f"restricted_{_name}", f"WITH {_FILTERED},{_ALL_IDS}\nSELECT * FROM {_filtered}"
          + ("" if _whole else " WHERE subject_id IN (SELECT subject_id FROM ids)"))(_make_restricted(_name))
