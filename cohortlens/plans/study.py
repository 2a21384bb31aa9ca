"""The study cohort: catalog tables -> cohort rules -> subject sample -> study join.

Every table gets its fixed rule, the subjects present in all
filtered tables are intersected (left-semi joins on distinct ids), the first
``n_subjects`` ids are taken and stored (the sample is the feature), every table with a
``subject_id`` is semi-joined to them, and the eight tables are merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortlens.operators import cohort, joins
from cohortlens.session import Scratch
from cohortlens.sources import readers

STUDY_TABLES = ["patients", "admissions", "transfers", "diagnoses_icd", "d_icd_diagnoses", "poe",
                "poe_detail", "prescriptions"]


def study_cohort(tables: dict[str, DataFrame], n_subjects: int | None = None,
                 filter_params: dict | None = None) -> DataFrame:
    filtered = {n: cohort.apply_table_rules(n, t, filter_params if filter_params is not None else {"poe": {}})
                for n, t in tables.items()}
    if n_subjects:
        ids = cohort.first_subjects(cohort.subject_intersection(list(filtered.values())), n_subjects)
        ids = Scratch(ids.sparkSession, "study-subjects").keep(ids)     # else every table's semi-join finds them anew
        filtered = cohort.restrict_tables(filtered, ids)
    t = filtered
    return joins.merged_table(t["patients"], t["admissions"], t["transfers"], t["diagnoses_icd"],
                              t["d_icd_diagnoses"], t["poe"], t["poe_detail"], t["prescriptions"])


def load_study_tables(spark: SparkSession, base: str, names=STUDY_TABLES) -> dict[str, DataFrame]:
    """Read each study table from ``base`` (Parquet preferred over CSV over CSV.gz)."""
    return {n: readers.read_table(spark, base, n) for n in names}


def admission_cohort(labs: DataFrame, admissions: DataFrame, lab_items: DataFrame,
                     subjects: DataFrame | None = None, out_base: str | None = None) -> DataFrame:
    """Labs attached to their nearest admission, with the lab dictionary.

    Optionally restricted to a subject sample first (semi-joins, so the
    nearest-interval join only sees those subjects) and written as Parquet
    and CSV under ``out_base``.
    """
    from cohortlens.sources import sinks
    if subjects is not None:
        labs = cohort.rows_for_subjects(labs, subjects)
        admissions = cohort.rows_for_subjects(admissions, subjects)
    out = joins.attach_dictionary(joins.nearest_admission(labs, admissions), lab_items, "itemid", "left")
    if out_base:
        sinks.save_parquet_and_csv(out, out_base)
    return out
