"""Cohort inclusion / exclusion rules and subject selection
(SURVEY F1-F13, F17, F18, F11, U1, O4, J13).

Every rule is a predicate over the clinical column names, applied with
``where``/``select`` so Catalyst pushes it into the scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# The reference's cohort rules.
PATIENT_AGE_MIN = 18
PATIENT_AGE_MAX = 75
PATIENT_YEAR_GROUPS = ["2017 - 2019"]
DIAGNOSIS_ICD_VERSIONS = [10]
DIAGNOSIS_SEQ_NUMS = [1, 2, 3]
DIAGNOSIS_CODE_PREFIX = "E11"
POE_KEEP = ["poe_id", "poe_seq", "subject_id", "hadm_id", "ordertime", "order_type",
            "order_subtype", "order_provider_id"]
ADMISSIONS_DROP = ["admit_provider_id", "insurance", "language", "marital_status", "race",
                   "edregtime", "edouttime"]
ADMISSION_TYPES_EXCLUDED = ["EW EMER.", "DIRECT EMER.", "URGENT", "ELECTIVE"]
MICROBIOLOGY_DROP = ["comments"]
LABEVENTS_KEEP = ["labevent_id", "subject_id", "hadm_id", "itemid", "order_provider_id", "charttime"]
PRESCRIPTIONS_DROP = ["pharmacy_id", "starttime", "stoptime", "drug_type", "formulary_drug_cd"]
OMR_SEQ_NUMS = [1, 2, 3]


def _require(df: DataFrame, cols) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise KeyError(f"columns {missing} not found")


def _drop_strict(df: DataFrame, cols) -> DataFrame:
    """``drop`` that raises on a missing column (pandas semantics, trap T4)."""
    _require(df, cols)
    return df.drop(*cols)


def not_in(c: str, values) -> Column:
    """``NOT c IN values`` that keeps nulls (pandas ``~isin``, trap T2)."""
    return ~F.coalesce(F.col(c).isin(list(values)), F.lit(False))


# ---------------------------------------------------------------------- F1-F10
def filter_patients(df: DataFrame, age_min=PATIENT_AGE_MIN, age_max=PATIENT_AGE_MAX,
                    year_groups=PATIENT_YEAR_GROUPS) -> DataFrame:
    return df.where(F.col("anchor_age").between(age_min, age_max)
                    & F.col("anchor_year_group").isin(list(year_groups))
                    & F.col("dod").isNull())


def filter_diagnoses(df: DataFrame, versions=DIAGNOSIS_ICD_VERSIONS, seq_nums=DIAGNOSIS_SEQ_NUMS,
                     code_prefix: str = DIAGNOSIS_CODE_PREFIX) -> DataFrame:
    return df.where(F.col("icd_version").isin(list(versions))
                    & F.col("seq_num").isin(list(seq_nums))
                    & F.col("icd_code").startswith(code_prefix))


def filter_icd_dictionary(df: DataFrame, versions=DIAGNOSIS_ICD_VERSIONS) -> DataFrame:
    return df.where(F.col("icd_version").isin(list(versions)))


def project_orders(df: DataFrame, filter_params: dict | None = None) -> DataFrame:
    """Keep the 8 order columns -- only when ``'poe'`` is a key of ``filter_params``."""
    if filter_params is not None and "poe" not in filter_params:
        return df
    _require(df, POE_KEEP)
    return df.select(*POE_KEEP)


def filter_admissions(df: DataFrame, excluded_types=ADMISSION_TYPES_EXCLUDED) -> DataFrame:
    df = _drop_strict(df, ADMISSIONS_DROP)
    return df.where(F.col("admittime").isNotNull() & F.col("dischtime").isNotNull()
                    & (F.col("deathtime").isNull() | (F.col("hospital_expire_flag") == 0))
                    & (F.col("dischtime") > F.col("admittime"))
                    & not_in("admission_type", excluded_types))


def filter_transfers(df: DataFrame) -> DataFrame:
    return df.where(F.col("hadm_id").isNotNull())


def filter_microbiology(df: DataFrame) -> DataFrame:
    return _drop_strict(df, MICROBIOLOGY_DROP)


def filter_labevents(df: DataFrame) -> DataFrame:
    _require(df, LABEVENTS_KEEP)
    return df.select(*LABEVENTS_KEEP)


def filter_prescriptions(df: DataFrame) -> DataFrame:
    return _drop_strict(df, PRESCRIPTIONS_DROP)


def filter_omr(df: DataFrame) -> DataFrame:
    return df.where(F.col("seq_num").isin(OMR_SEQ_NUMS))


TABLE_RULES = {
    "patients": filter_patients,
    "diagnoses_icd": filter_diagnoses,
    "d_icd_diagnoses": filter_icd_dictionary,
    "admissions": filter_admissions,
    "transfers": filter_transfers,
    "microbiologyevents": filter_microbiology,
    "labevents": filter_labevents,
    "prescriptions": filter_prescriptions,
    "omr": filter_omr,
}


def apply_table_rules(table: str, df: DataFrame, filter_params: dict | None = None) -> DataFrame:
    """The fixed rule of ``table`` (identity for tables without one)."""
    if table == "poe":
        return project_orders(df, filter_params if filter_params is not None else {})
    rule = TABLE_RULES.get(table)
    return rule(df) if rule else df


# ------------------------------------------------------------------------- F12
@dataclass
class CohortCriteria:
    """Parameterised criteria (the UI's declared filters) as one conjunction."""
    encounter_start: str | None = None          # admittime >= start
    encounter_end: str | None = None            # admittime <= end
    age_min: int | None = None
    age_max: int | None = None
    diagnosis_prefixes: list[str] = field(default_factory=list)
    admission_types: list[str] = field(default_factory=list)
    admission_locations: list[str] = field(default_factory=list)
    required_units: list[str] = field(default_factory=list)
    order_types: list[str] = field(default_factory=list)
    transaction_types: list[str] = field(default_factory=list)
    valid_times: bool = False                   # admittime and dischtime present, disch > admit


def cohort_criteria(admissions: DataFrame, c: CohortCriteria, patients: DataFrame | None = None,
                    diagnoses: DataFrame | None = None, transfers: DataFrame | None = None,
                    orders: DataFrame | None = None) -> DataFrame:
    """Admissions meeting every given criterion.

    Row predicates become one ``where``; criteria on other tables are
    ``left_semi`` joins on the admission key, so no admission is duplicated.
    """
    for wanted, table, name in ((c.age_min is not None or c.age_max is not None, patients, "patients"),
                                (c.diagnosis_prefixes, diagnoses, "diagnoses"), (c.required_units, transfers, "transfers"),
                                (c.order_types or c.transaction_types, orders, "orders")):
        if wanted and table is None:
            raise ValueError(f"a criterion needs the {name} table")
    preds: list[Column] = []
    if c.encounter_start:
        preds.append(F.col("admittime") >= F.to_timestamp_ntz(F.lit(c.encounter_start)))
    if c.encounter_end:
        preds.append(F.col("admittime") <= F.to_timestamp_ntz(F.lit(c.encounter_end)))
    if c.admission_types:
        preds.append(F.col("admission_type").isin(c.admission_types))
    if c.admission_locations:
        preds.append(F.col("admission_location").isin(c.admission_locations))
    if c.valid_times:
        preds.append(F.col("admittime").isNotNull() & F.col("dischtime").isNotNull()
                     & (F.col("dischtime") > F.col("admittime")))
    out = admissions.where(reduce(lambda a, b: a & b, preds)) if preds else admissions
    if c.age_min is not None or c.age_max is not None:
        p = patients
        if c.age_min is not None:
            p = p.where(F.col("anchor_age") >= c.age_min)
        if c.age_max is not None:
            p = p.where(F.col("anchor_age") <= c.age_max)
        out = out.join(p.select("subject_id"), "subject_id", "left_semi")
    if c.diagnosis_prefixes:
        cond = reduce(lambda a, b: a | b, [F.col("icd_code").startswith(x) for x in c.diagnosis_prefixes])
        out = out.join(diagnoses.where(cond).select("subject_id", "hadm_id"),
                       ["subject_id", "hadm_id"], "left_semi")
    if c.required_units:
        out = out.join(transfers.where(F.col("careunit").isin(c.required_units))
                       .select("subject_id", "hadm_id"), ["subject_id", "hadm_id"], "left_semi")
    if c.order_types or c.transaction_types:
        o = orders
        if c.order_types:
            o = o.where(F.col("order_type").isin(c.order_types))
        if c.transaction_types:
            o = o.where(F.col("transaction_type").isin(c.transaction_types))
        out = out.join(o.select("subject_id", "hadm_id"), ["subject_id", "hadm_id"], "left_semi")
    return out


# ------------------------------------------------------------------ F17 / F18
def drop_null_rows(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    return df.na.drop(how="any", subset=subset)


def exclude_noise(labels: DataFrame, cluster: str = "cluster", noise=-1) -> DataFrame:
    return labels.where(F.col(cluster).isNotNull() & (F.col(cluster) != F.lit(noise)))


def label_noise(labels: DataFrame, cluster: str = "cluster", noise=-1, name: str = "Noise") -> DataFrame:
    """Cluster label as text with the noise label renamed."""
    return labels.withColumn(cluster, F.when(F.col(cluster) == F.lit(noise), F.lit(name))
                             .otherwise(F.col(cluster).cast("string")))


# ------------------------------------------------------ F11 / S7 / A1 / U1 / O4
def distinct_subjects(df: DataFrame, key: str = "subject_id") -> DataFrame:
    """Distinct non-null subject ids (partial + final aggregate; column-pruned scan)."""
    return df.select(key).where(F.col(key).isNotNull()).distinct()


def subject_intersection(tables: list[DataFrame], key: str = "subject_id") -> DataFrame:
    """Subjects present in every table that has ``key`` (tables without it are skipped).

    A chain of ``intersect`` (left-semi join on distinct ids); nothing is
    collected.  Raises when no table has the column.
    """
    with_key = [t for t in tables if key in t.columns]
    if not with_key:
        raise ValueError(f"no table has a {key} column")
    ids = [distinct_subjects(t, key) for t in with_key]
    return reduce(lambda a, b: a.intersect(b), ids)


def require_nonempty(df: DataFrame, what: str = "subject intersection") -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def first_subjects(ids: DataFrame, n: int, key: str = "subject_id") -> DataFrame:
    """The ``n`` smallest subject ids (top-k, the limit is the feature)."""
    return ids.select(key).orderBy(key).limit(int(n))


def rows_for_subjects(df: DataFrame, ids: DataFrame, key: str = "subject_id") -> DataFrame:
    """Rows whose subject is in ``ids`` (left-semi join; nothing duplicated)."""
    return df.join(ids.select(key), key, "left_semi")


def restrict_tables(tables: dict[str, DataFrame], ids: DataFrame, key: str = "subject_id") -> dict[str, DataFrame]:
    """Every table with ``key`` semi-joined to ``ids``; dictionaries untouched."""
    return {n: (rows_for_subjects(t, ids, key) if key in t.columns else t) for n, t in tables.items()}


def table_counter(tables: dict[str, DataFrame], key: str = "subject_id") -> DataFrame:
    """Rows and distinct subjects per table, one row per table (union of aggregates)."""
    parts = [t.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(key).alias("n_subjects"))
              .select(F.lit(name).alias("table_name"), "n_rows", "n_subjects")
             for name, t in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)
