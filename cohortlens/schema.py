"""Column type registry: one global name -> type map applied to whatever
columns a file has (unknown columns stay strings).

Integer columns are read as text and converted with the NA rule of
:func:`cohortlens.functions.nulls.normalize_na`, so ``''``, ``NULL``,
``null``, ``None`` and unparsable values become null instead of failing.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Column names by type (clinical schema).
BIGINT_COLUMNS = [
    "subject_id", "hadm_id", "stay_id", "icustay_id", "itemid", "labevent_id", "specimen_id",
    "poe_seq", "anchor_year", "anchor_age", "ab_itemid", "emar_seq", "isolate_num", "microevent_id",
    "org_itemid", "seq_num", "spec_itemid", "test_seq", "transfer_id", "drg_mortality", "drg_severity",
    "expiration_value", "icd_version", "pharmacy_id",
]
SMALLINT_COLUMNS = ["hospital_expire_flag"]
DOUBLE_COLUMNS = ["dilution_value", "parent_field_ordinal", "valuenum", "ref_range_lower", "ref_range_upper"]
# numeric by documentation but holding values such as "2.1-4": kept as text
TEXT_NUMERIC_COLUMNS = ["basal_rate", "doses_per_24_hrs", "duration", "one_hr_max"]
TIMESTAMP_COLUMNS = [
    "admittime", "chartdate", "charttime", "deathtime", "dischtime", "dod", "edouttime", "edregtime",
    "entertime", "expirationdate", "intime", "ordertime", "outtime", "scheduletime", "starttime",
    "stoptime", "storedate", "storetime", "transfertime", "verifiedtime",
]
BOOLEAN_COLUMNS = ["flag_mobil", "flag_work_phone", "flag_phone", "flag_email"]
# Allowed values of the categorical columns.
CATEGORIES = {
    "admission_type": ["AMBULATORY OBSERVATION", "DIRECT EMER.", "DIRECT OBSERVATION", "ELECTIVE",
                       "EU OBSERVATION", "EW EMER.", "OBSERVATION ADMIT", "SURGICAL SAME DAY ADMISSION",
                       "URGENT"],
    "transaction_type": ["Change", "Co", "D/C", "H", "New", "T"],
    "eventtype": ["ed", "admit", "transfer", "discharge"],
    "order_status": ["Active", "Inactive"],
    "interpretation": ["I", "R", "S", "P"],
    "sliding_scale": ["Y", "N"],
    "priority": ["ROUTINE", "STAT"],
    "order_type": ["ADT orders", "Blood Bank", "Cardiology", "Consults", "Critical Care", "General Care",
                   "Hemodialysis", "IV therapy", "Lab", "Medications", "Neurology", "Nutrition", "OB",
                   "Radiology", "Respiratory", "TPN"],
}

_TYPES: dict[str, T.DataType] = {}
_TYPES.update({c: T.LongType() for c in BIGINT_COLUMNS})
_TYPES.update({c: T.ShortType() for c in SMALLINT_COLUMNS})
_TYPES.update({c: T.DoubleType() for c in DOUBLE_COLUMNS})
_TYPES.update({c: T.TimestampNTZType() for c in TIMESTAMP_COLUMNS})
_TYPES.update({c: T.BooleanType() for c in BOOLEAN_COLUMNS})


def column_type(name: str) -> T.DataType:
    return _TYPES.get(name, T.StringType())


def is_integer_column(name: str) -> bool:
    return isinstance(column_type(name), (T.LongType, T.ShortType))


def schema_for(columns: list[str]) -> T.StructType:
    """Target schema for the given header."""
    return T.StructType([T.StructField(c, column_type(c), True) for c in columns])


def read_schema_for(columns: list[str]) -> T.StructType:
    """Schema used while parsing text: integer columns as strings (NA rule after)."""
    return T.StructType([T.StructField(c, T.StringType() if is_integer_column(c) else column_type(c), True)
                         for c in columns])


def category_violations(df, categories: dict[str, list[str]] | None = None):
    """Values of categorical columns outside their allowed list:
    ``(column_name, value, n)`` -- one partial+final count per checked column,
    nulls allowed.  Empty when every value is allowed."""
    from functools import reduce

    from pyspark.sql import functions as F
    cats = {c: v for c, v in (categories or CATEGORIES).items() if c in df.columns}
    if not cats:
        return df.sparkSession.createDataFrame([], "column_name string, value string, n bigint")
    parts = [df.where(F.col(c).isNotNull() & ~F.col(c).isin(allowed))
               .groupBy(F.col(c).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
               .select(F.lit(c).alias("column_name"), "value", "n")
             for c, allowed in cats.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)
