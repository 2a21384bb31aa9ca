"""Study joins.

All joins are declared with the DataFrame API and planned by Catalyst/AQE.
Broadcast hints are given only for sides whose size is bounded by
construction or checked by :func:`sized_broadcast`; everything else is left
to AQE, which converts to a broadcast at run time from real shuffle sizes and
splits skewed partitions of sort-merge joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.functions.timefn import add_hours
from cohortlens.session import Scratch

DICTIONARY_MAX_ROWS = 2_000_000


def sized_broadcast(df: DataFrame, max_rows: int = DICTIONARY_MAX_ROWS) -> DataFrame:
    """Broadcast hint only when ``df`` provably has at most ``max_rows`` rows.

    The check is a ``limit(max_rows + 1).count()``: it stops reading as soon
    as the bound is exceeded.  Beyond the bound the plain DataFrame is
    returned and the join stays a shuffle join.
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


# ----------------------------------------------------------------------- J10
_STRING_KEYS = {"poe_id", "emar_id", "pharmacy_id", "icd_code", "icd_version"}


def harmonize_key_types(df: DataFrame, keys) -> DataFrame:
    """Key type harmonisation before a join: ``*provider_id``, order/drug ids and
    ICD keys -> string, other ``*_id`` -> bigint."""
    out = df
    for k in keys:
        if k not in df.columns:
            continue
        if k in _STRING_KEYS or k.endswith("provider_id"):
            out = out.withColumn(k, F.col(k).cast("string"))
        elif k.endswith("_id"):
            out = out.withColumn(k, F.col(k).try_cast("bigint"))
    return out


def merge_two(left: DataFrame, right: DataFrame, on, how: str = "inner",
              null_keys_match=False, suffixes=("_x", "_y"), harmonize: bool = False) -> DataFrame:
    """Two-table join with pandas-merge naming.

    ``how`` in inner/left/right/outer.  Key columns appear once (coalesced
    for outer joins).  Non-key columns present on both sides get
    ``suffixes``.  ``null_keys_match`` (True or a list of key names) makes
    those keys match null = null via ``eqNullSafe``; by default nulls never
    match (SQL semantics).
    """
    on = [on] if isinstance(on, str) else list(on)
    how = {"outer": "full_outer", "full": "full_outer"}.get(how, how)
    if harmonize:
        left, right = harmonize_key_types(left, on), harmonize_key_types(right, on)
    ns = set(on) if null_keys_match is True else set(null_keys_match or [])
    if not ns:
        j = left.join(right, on, how)
        common = (set(left.columns) & set(right.columns)) - set(on)
        if not common:
            return j
    l, r = left.alias("_l"), right.alias("_r")
    cond = reduce(lambda a, b: a & b,
                  [(F.col(f"_l.`{k}`").eqNullSafe(F.col(f"_r.`{k}`")) if k in ns
                    else F.col(f"_l.`{k}`") == F.col(f"_r.`{k}`")) for k in on])
    j = l.join(r, cond, how)
    cols: list[Column] = []
    for k in on:
        if how in ("right", "right_outer"):
            cols.append(F.col(f"_r.`{k}`").alias(k))
        elif how == "full_outer":
            cols.append(F.coalesce(F.col(f"_l.`{k}`"), F.col(f"_r.`{k}`")).alias(k))
        else:
            cols.append(F.col(f"_l.`{k}`").alias(k))
    common = (set(left.columns) & set(right.columns)) - set(on)
    for c in left.columns:
        if c not in on:
            cols.append(F.col(f"_l.`{c}`").alias(c + suffixes[0] if c in common else c))
    for c in right.columns:
        if c not in on:
            cols.append(F.col(f"_r.`{c}`").alias(c + suffixes[1] if c in common else c))
    return j.select(*cols)


# ------------------------------------------------------------------ J1 - J9
def merged_table(patients: DataFrame, admissions: DataFrame, transfers: DataFrame,
                 diagnoses: DataFrame, icd_dictionary: DataFrame, poe: DataFrame,
                 poe_detail: DataFrame, prescriptions: DataFrame,
                 labevents: DataFrame | None = None, lab_items: DataFrame | None = None,
                 detail_how: str = "inner") -> DataFrame:
    """The study join as one lazy plan (no intermediate persist).

    patients -(subject)- admissions -(subject, hadm)- transfers
      -(subject, hadm)- (diagnoses -(icd_code, icd_version)- dictionary)
      -(subject, hadm)- (poe -(poe_id, poe_seq, subject)- poe_detail)
      =left(subject, hadm, poe_id, poe_seq, provider null-safe)= prescriptions
      [-(subject, hadm, provider)- (labevents -(itemid)- lab_items)]

    Every table is restricted to the stays that patients, admissions and diagnoses share before it is joined.
    """
    stays = studied_stays(patients, admissions, diagnoses)
    keys = {k: sized_broadcast(stays.select(k).distinct()) for k in ("hadm_id", "subject_id")}
    transfers, diagnoses, poe, poe_detail, prescriptions, labevents = (
        t and rows_of_keys(t, keys) for t in (transfers, diagnoses, poe, poe_detail, prescriptions, labevents))
    stages = merge_stages(patients, stays, transfers, diagnoses, icd_dictionary, poe,
                          poe_detail, prescriptions, labevents, lab_items, detail_how)
    return list(stages.values())[-1]


def studied_stays(patients: DataFrame, admissions: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """Admissions of ``patients`` with a row in ``diagnoses``, stored: every table of the study join is restricted to them."""
    near = (admissions.join(patients.select("subject_id"), "subject_id", "left_semi")
                      .join(diagnoses.select("subject_id", "hadm_id"), ["subject_id", "hadm_id"], "left_semi"))
    return Scratch(admissions.sparkSession, "studied-stays").keep(near)


def rows_of_keys(df: DataFrame, keys: dict[str, DataFrame]) -> DataFrame:
    """Rows of ``df`` whose key is in each of ``keys`` (distinct values by column name) that it has a column for.

    One semi-join for each key, so that each goes down to the side of a join below that holds it.
    """
    for k, values in keys.items():
        if k in df.columns:
            df = df.join(values, k, "left_semi")
    return df


def merge_stages(patients: DataFrame, admissions: DataFrame, transfers: DataFrame,
                 diagnoses: DataFrame, icd_dictionary: DataFrame, poe: DataFrame,
                 poe_detail: DataFrame, prescriptions: DataFrame,
                 labevents: DataFrame | None = None, lab_items: DataFrame | None = None,
                 detail_how: str = "inner") -> dict[str, DataFrame]:
    """Every intermediate of :func:`merged_table`, by stage name (for cardinality reports)."""
    st: dict[str, DataFrame] = {}
    st["patients_admissions"] = m = merge_two(patients, admissions, "subject_id")          # J1
    st["with_transfers"] = m = merge_two(m, transfers, ["subject_id", "hadm_id"])          # J2
    st["diagnoses_dictionary"] = diag = merge_two(                                         # J3
        diagnoses, sized_broadcast(icd_dictionary), ["icd_code", "icd_version"])
    st["with_diagnoses"] = m = merge_two(m, diag, ["subject_id", "hadm_id"])               # J4
    st["orders_detail"] = orders = merge_two(                                              # J5
        poe, poe_detail, ["poe_id", "poe_seq", "subject_id"], detail_how)
    st["with_orders"] = m = merge_two(m, orders, ["subject_id", "hadm_id"])                # J6
    st["with_prescriptions"] = m = merge_two(                                              # J7
        m, prescriptions, ["subject_id", "hadm_id", "poe_id", "poe_seq", "order_provider_id"],
        "left", null_keys_match=["order_provider_id"])
    if labevents is not None:                                                              # J8
        labs = merge_two(labevents, sized_broadcast(lab_items), "itemid")
        st["with_labs"] = merge_two(m, labs, ["subject_id", "hadm_id", "order_provider_id"])
    return st


# ---------------------------------------------------------------- J11 / J12
def nearest_admission(labs: DataFrame, admissions: DataFrame, lab_key: str = "labevent_id",
                      time: str = "charttime", buffer_hours: int = 24,
                      bucket_hours: int = 24, drop_lab_cols=("hadm_id", "order_provider_id")) -> DataFrame:
    """Nearest-interval join of timestamped rows to stays.

    A lab row matches an admission of the same subject when
    ``admittime - buffer <= charttime <= dischtime + buffer`` (both ends
    inclusive).  Of the matches, the admission with the smallest
    ``|admittime - charttime|`` is kept; ties go to the earlier admittime,
    then the smaller ``hadm_id``.  Labs with a null time or no match are
    dropped; one output row per ``lab_key``.

    Plan (skew-safe): time is cut into cells of ``bucket_hours``, twice that, four times that and so on.
    A window takes the cell size that covers it with at most ``COVER + 2`` cells, however long it is, so a
    stay of a year, or of thirty, is a few rows; a lab has one cell of each size that any window uses (a lazy scalar
    subquery, at most some forty sizes, one for stays of like length).  The equi-join key is
    ``(subject_id, size, cell)``: a subject with a huge history is spread over its cells, and a pair meets at
    most once.  The exact range test is the residual join condition.

    The arg-min is grouped by the lab key.  For one lab time c the order (|t - c|, t) equals the order of
    ``2|t - c| + [t > c]``; with the rank of ``hadm_id`` among stays of the subject with the same admittime
    it makes one exact DECIMAL(38) key, wide enough for any time and rank, and every output column is a
    ``min_by(column, key)``: with fixed-width columns a hash aggregate with map-side partial aggregation.
    """
    lab_cols = [c for c in labs.columns if c not in drop_lab_cols]
    adm_cols = [c for c in admissions.columns if c != "subject_id"]
    clash = set(lab_cols) & set(adm_cols)
    if clash:
        raise ValueError(f"lab and admission columns clash: {sorted(clash)}")
    base_us = int(bucket_hours) * 3_600_000_000

    def us(name: str) -> Column:
        # time-zone independent: exact microseconds since the NTZ epoch
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{name}`)")

    a = (admissions.where(F.col("admittime").isNotNull() & F.col("dischtime").isNotNull()
                          & F.col("subject_id").isNotNull())
         .withColumn("_lo", add_hours("admittime", -buffer_hours))
         .withColumn("_hi", add_hours("dischtime", buffer_hours))
         # a window that ends before it begins holds no lab
         .where(F.col("_lo") <= F.col("_hi"))
         # rank among the subject's stays with the same admittime (tie -> smaller hadm_id)
         .withColumn("_tr", F.dense_rank().over(Window.partitionBy("subject_id", "admittime").orderBy("hadm_id")) - 1)
         .withColumn("_w", _cell_width(us("_hi") - us("_lo"), base_us)))
    widths = a.agg(F.array_sort(F.collect_set("_w")).alias("w"))     # one row of at most some forty numbers
    a = a.withColumn("_b", F.explode(F.sequence(_cell_of(us("_lo")), _cell_of(us("_hi")))))
    a = a.select("subject_id", "_w", "_b", "_lo", "_hi", "_tr", *adm_cols)
    l = (labs.select(*lab_cols).where(F.col(time).isNotNull() & F.col("subject_id").isNotNull())
             .withColumn("_w", F.explode(widths.scalar())).withColumn("_b", _cell_of(us(time))))
    cand = l.join(a, ["subject_id", "_w", "_b"], "inner").where(
        (F.col("_lo") <= F.col(time)) & (F.col(time) <= F.col("_hi")))
    payload = [c for c in lab_cols + adm_cols if c != lab_key]
    apart = F.abs(F.expr(f"timestampdiff(MICROSECOND, `{time}`, admittime)")).cast("decimal(19,0)")
    order = F.lit(2).cast("decimal(1,0)") * apart + F.when(F.col("admittime") > F.col(time), 1).otherwise(0).cast("decimal(1,0)")
    # 22 digits for the order, 10 for the rank (a 32-bit number)
    key = order.cast("decimal(22,0)") * F.lit(10 ** 10).cast("decimal(11,0)") + F.col("_tr").cast("decimal(10,0)")
    best = cand.groupBy(lab_key).agg(*[F.min_by(F.col(c), key).alias(c) for c in payload])
    return best.select(lab_key, *payload)


COVER = 8           # cells that a window spans at most, but for its two ends


def _cell_width(length: Column, base_us: int) -> Column:
    """The smallest ``base_us * 2^j`` microseconds of which ``length`` spans at most ``COVER``."""
    level = F.greatest(F.lit(0), F.ceil(F.log2((length + 1) / F.lit(float(base_us * COVER)))).cast("int"))
    return F.lit(base_us) * F.pow(F.lit(2.0), level).cast("long")


def _cell_of(time_us: Column) -> Column:
    return F.floor((time_us - F.pmod(time_us, F.col("_w"))) / F.col("_w"))


def attach_dictionary(df: DataFrame, dictionary: DataFrame, key, how: str = "left",
                      max_rows: int = DICTIONARY_MAX_ROWS) -> DataFrame:
    """Join a dictionary table, broadcast when its size is proven small."""
    return merge_two(df, sized_broadcast(dictionary, max_rows), key, how)


# ----------------------------------------------------------------------- J14
def align_labels(data: DataFrame, labels: DataFrame, key: str = "key") -> DataFrame:
    """Intersection alignment of a data frame and a label frame on an explicit row key."""
    return data.join(labels, key, "inner")
