"""Order-pattern features: frequency matrix, sequences, transitions, timing,
distributions (SURVEY A2-A8, W1, W2, O2, U4).

Long format ``(patient, order, value)`` is the internal truth; wide
matrices are produced only at the edge by :func:`to_wide`, always with an
explicit, bounded list of pivot values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.functions.timefn import add_hours, hours_between
from cohortlens.session import materialize

MAX_PIVOT_VALUES = 1000


def _require(df: DataFrame, *cols: str | None) -> None:
    missing = [c for c in cols if c and c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} not found in DataFrame")


# --------------------------------------------------------------------------- O2
def top_values(df: DataFrame, col: str, n: int) -> DataFrame:
    """The ``n`` most frequent non-null values of ``col`` with their counts.

    Ties on the count are broken by the value ascending, so the cut is
    deterministic.  ``n <= 0`` keeps every value.  Partial counts are
    combined map-side; only one row per distinct value is shuffled.
    """
    counts = (df.where(F.col(col).isNotNull())
                .groupBy(col).agg(F.count(F.lit(1)).alias("n")))
    if n and n > 0:
        return counts.orderBy(F.desc("n"), F.asc(col)).limit(int(n))
    return counts


def top_value_list(df: DataFrame, col: str, n: int) -> list:
    """Driver-side list of the top ``n`` values (size bounded by ``n``)."""
    if not n or n <= 0:
        raise ValueError("a driver-side value list needs a positive bound n")
    return [r[col] for r in top_values(df, col, n).collect()]


# --------------------------------------------------------------------- A2 / A3
def order_frequency(df: DataFrame, patient: str, order: str, top_n: int = 20,
                    normalize: bool = False) -> DataFrame:
    """Patient x order-type frequency matrix in long form.

    Keeps the ``top_n`` order types by global count (nulls excluded), drops
    rows with a null patient or order, and returns one row per (patient,
    kept order type) for every patient that has at least one kept order;
    missing combinations are 0 (the crosstab's fill).  ``normalize`` divides
    each count by the patient's total over the kept types.

    Plan: one partial+final count for the top list (``limit top_n``, so the
    broadcast side is bounded by construction), a broadcast semi-join, and
    one ``groupBy(patient)`` with a pivot on the explicit value list.
    """
    _require(df, patient, order)
    base = df.select(patient, order)
    if top_n and top_n > 0:
        top = top_value_list(base, order, top_n)
    else:
        top = [r[order] for r in base.where(F.col(order).isNotNull())
               .select(order).distinct().limit(MAX_PIVOT_VALUES + 1).collect()]
        if len(top) > MAX_PIVOT_VALUES:
            raise ValueError(f"more than {MAX_PIVOT_VALUES} order types; pass top_n")
        top.sort()
    if not top:   # no non-null orders at all: an empty matrix
        value_type = "double" if normalize else "bigint"
        schema = (f"`{patient}` {base.schema[patient].dataType.simpleString()}, "
                  f"`{order}` {base.schema[order].dataType.simpleString()}, "
                  f"{'proportion' if normalize else 'n'} {value_type}")
        return base.sparkSession.createDataFrame([], schema)
    wide = _frequency_wide(base, patient, order, top)
    cells = [F.col(f"`{v}`").cast("bigint") for v in top]
    if normalize:
        # row total over the kept types only, computed on the wide row (no extra shuffle)
        tot = cells[0]
        for c in cells[1:]:
            tot = tot + c
        cells = [c / tot for c in cells]
    value_col = "proportion" if normalize else "n"
    stack = F.array(*[F.struct(F.lit(v).alias(order), c.alias(value_col)) for v, c in zip(top, cells)])
    return (wide.select(patient, F.explode(stack).alias("_c"))
                .select(patient, F.col(f"_c.{order}").alias(order), F.col(f"_c.{value_col}").alias(value_col)))


def _frequency_wide(base: DataFrame, patient: str, order: str, top: list) -> DataFrame:
    kept = base.where(F.col(patient).isNotNull() & F.col(order).isin(top))
    return kept.groupBy(patient).pivot(order, top).count().na.fill(0)


def order_frequency_wide(df: DataFrame, patient: str, order: str, top_n: int = 20) -> DataFrame:
    """The crosstab itself: one row per patient, one count column per kept
    order type (explicit, bounded pivot list), missing cells 0."""
    _require(df, patient, order)
    base = df.select(patient, order)
    top = top_value_list(base, order, top_n)
    return _frequency_wide(base, patient, order, top)


def to_wide(long_df: DataFrame, row_key: str, col_key: str, value: str,
            values: list | None = None, fill=0) -> DataFrame:
    """Long -> wide (U4) with an explicit, bounded list of column values."""
    if values is None:
        values = [r[col_key] for r in long_df.select(col_key).distinct()
                  .limit(MAX_PIVOT_VALUES + 1).collect()]
        if len(values) > MAX_PIVOT_VALUES:
            raise ValueError(f"more than {MAX_PIVOT_VALUES} pivot columns")
        values = sorted(v for v in values if v is not None)
    w = long_df.groupBy(row_key).pivot(col_key, values).agg(F.first(value))
    return w.na.fill(fill) if fill is not None else w


# ------------------------------------------------------------------------ W1
def order_sequences(df: DataFrame, patient: str, order: str, time: str,
                    max_len: int = 20, tiebreak: str | list[str] | None = None) -> DataFrame:
    """Time-ordered order sequence per patient, cut to the first ``max_len``.

    Null patients are dropped, null orders kept, null times sort last; ties
    on time are broken by ``tiebreak`` (an event id) when given.  The cut is
    a ``row_number() <= max_len`` filter, which Spark plans as a partial
    per-partition group limit *before* the shuffle, so a patient with a huge
    history never moves more than ``max_len`` rows per map task and never
    collects more than ``max_len`` items.
    """
    ties = [tiebreak] if isinstance(tiebreak, str) else list(tiebreak or [])
    _require(df, patient, order, time, *ties)
    keys = [F.col(time).isNull(), F.col(time)] + [F.col(t) for t in ties]
    base = df.where(F.col(patient).isNotNull())
    if max_len and max_len > 0:
        w = Window.partitionBy(patient).orderBy(*[k.asc() for k in keys])
        base = base.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= max_len)
    fields = [k.alias(f"k{i}") for i, k in enumerate(keys)] + [F.col(order).alias("o")]
    seq = base.groupBy(patient).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_s"))
    return seq.select(patient, F.transform("_s", lambda s: s["o"]).alias("sequence"))


# ------------------------------------------------------------------------ A8
def sequence_stats(seq: DataFrame, sequence: str = "sequence") -> DataFrame:
    return seq.agg(F.count(F.lit(1)).alias("n_patients"),
                   F.avg(F.size(sequence).cast("double")).alias("mean_length"))


# -------------------------------------------------------------------- A7 / W2
def order_transitions(seq: DataFrame, sequence: str = "sequence", top_n: int = 20) -> DataFrame:
    """Transition probabilities between the ``top_n`` order types.

    Items outside the top list (and nulls) are removed from each sequence
    *before* adjacent pairs are formed, so a pair can bridge a rare order.
    Rows are normalised to sum 1; a type without any successor gets a row
    of zeros.  Output is the dense matrix in long form
    ``(from_order, to_order, n, probability)``; its size is bounded by
    ``top_n``^2.

    All per-sequence work is array expressions on the row; the only
    shuffles are the global item count and the pair count.
    """
    seq = materialize(seq.select(sequence))   # read by the top-N job and by the pair count
    items = seq.select(F.explode(sequence).alias("item"))
    if top_n and top_n > 0:
        top = top_value_list(items, "item", top_n)
    else:
        top = [r["item"] for r in items.where(F.col("item").isNotNull()).select("item")
               .distinct().limit(MAX_PIVOT_VALUES + 1).collect()]
        if len(top) > MAX_PIVOT_VALUES:
            raise ValueError(f"more than {MAX_PIVOT_VALUES} order types; pass top_n")
        top.sort()
    if not top:   # no items at all: an empty matrix
        return seq.sparkSession.createDataFrame(
            [], "from_order string, to_order string, n bigint, probability double")
    top_arr = F.array(*[F.lit(v) for v in top])
    kept = F.filter(sequence, lambda x: F.array_contains(top_arr, x))
    pairs = (seq.select(kept.alias("s"))
                .where(F.size("s") > 1)
                .select(F.explode(F.arrays_zip(
                    F.slice("s", 1, F.size("s") - 1).alias("a"),
                    F.slice("s", 2, F.size("s") - 1).alias("b"))).alias("p"))
                .select(F.col("p.a").alias("from_order"), F.col("p.b").alias("to_order")))
    wide = pairs.groupBy("from_order").pivot("to_order", top).count()
    spark = seq.sparkSession
    rows = spark.createDataFrame([(v,) for v in top], "from_order string")
    dense = rows.join(wide, "from_order", "left").na.fill(0)
    stack = F.array(*[F.struct(F.lit(v).alias("to_order"), F.col(f"`{v}`").cast("bigint").alias("n"))
                      for v in top])
    out = (dense.select("from_order", F.explode(stack).alias("_c"))
                .select("from_order", F.col("_c.to_order").alias("to_order"), F.col("_c.n").alias("n")))
    tot = F.sum("n").over(Window.partitionBy("from_order"))
    prob = F.when(tot > 0, F.col("n") / tot).otherwise(F.lit(0.0))
    return out.select("from_order", "to_order", "n", prob.alias("probability"))


def history_transitions(df: DataFrame, patient: str, order: str, time: str, top_n: int = 20,
                        tiebreak: str | list[str] | None = None) -> DataFrame:
    """Transition probabilities over every patient's whole history.

    Same output as :func:`order_transitions`, without building sequences: rows of
    the ``top_n`` order types are paired inside (patient, calendar day) windows,
    and the days of a patient are stitched by each day's first and last row (one
    pair of fixed-size aggregates per day).  A patient holding a third of all
    rows is spread over its days; only one row per day meets in its window.
    Null times form a last slice of their own.
    """
    ties = [tiebreak] if isinstance(tiebreak, str) else list(tiebreak or [])
    _require(df, patient, order, time, *ties)
    top = top_value_list(df.where(F.col(patient).isNotNull()), order, top_n)
    spark = df.sparkSession
    if not top:
        return spark.createDataFrame([], "from_order string, to_order string, n bigint, probability double")
    keys = [F.col(time).isNull(), F.col(time)] + [F.col(t) for t in ties]
    rows = (df.where(F.col(patient).isNotNull() & F.col(order).isin(top))
              .select(F.col(patient).alias("_p"), F.coalesce(F.to_date(time), F.lit("9999-12-31").cast("date")).alias("_day"),
                      F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], F.col(order).alias("o")).alias("_k")))
    inside = rows.select(F.col("_k.o").alias("from_order"),
                         F.lead("_k.o").over(Window.partitionBy("_p", "_day").orderBy("_k")).alias("to_order"))
    days = rows.groupBy("_p", "_day").agg(F.min("_k").alias("_first"), F.max("_k").alias("_last"))
    across = days.select(F.col("_last.o").alias("from_order"),
                         F.lead("_first.o").over(Window.partitionBy("_p").orderBy("_day")).alias("to_order"))
    pairs = inside.union(across).where(F.col("to_order").isNotNull()).groupBy("from_order", "to_order").agg(F.count(F.lit(1)).alias("n"))
    grid = spark.createDataFrame([(a, b) for a in top for b in top], "from_order string, to_order string")   # top_n^2 rows
    out = grid.join(pairs, ["from_order", "to_order"], "left").na.fill(0, ["n"])
    tot = F.sum("n").over(Window.partitionBy("from_order"))
    return out.select("from_order", "to_order", "n", F.when(tot > 0, F.col("n") / tot).otherwise(F.lit(0.0)).alias("probability"))


def history_stats(df: DataFrame, patient: str) -> DataFrame:
    """Number of patients and mean length of their whole histories."""
    per = df.where(F.col(patient).isNotNull()).groupBy(patient).agg(F.count(F.lit(1)).alias("_n"))
    return per.agg(F.count(F.lit(1)).alias("n_patients"), F.avg(F.col("_n").cast("double")).alias("mean_length"))


# ------------------------------------------------------------------------ A5
def order_timing(df: DataFrame, patient: str, order: str, time: str,
                 admit: str | None = None, disch: str | None = None,
                 tiebreak: str | None = None) -> DataFrame:
    """Per-patient timing features in one hash aggregation.

    ``total_orders`` counts non-null orders, ``unique_order_types`` distinct
    non-null orders.  ``orders_in_first_{24,48,72}h`` count rows with
    ``time <= admit + h`` (no lower bound; each row's own admission time),
    ``orders_in_last_{24,48}h`` rows with ``time >= disch - h``.  For the
    span features the patient's admission / discharge is the earliest
    non-null one (deterministic where the reference takes the first row in
    file order).  Every aggregate has a fixed-width buffer, so Spark plans
    a hash aggregate with map-side partial aggregation: only one row per
    patient and map task is shuffled, however skewed the patients are.
    Rows without a patient are dropped.  ``tiebreak`` is accepted for API
    symmetry with the sequence operators.
    """
    _require(df, patient, order, time, admit, disch, tiebreak)

    def count_if(cond: Column) -> Column:
        return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")

    aggs = [F.min(time).alias("first_order_time"), F.max(time).alias("last_order_time"),
            F.count(order).alias("total_orders"),
            F.countDistinct(order).alias("unique_order_types")]
    if admit:
        for h in (24, 48, 72):
            aggs.append(count_if(F.col(time) <= add_hours(admit, h)).alias(f"orders_in_first_{h}h"))
        aggs.append(F.min(admit).alias("_adm"))
    if disch:
        for h in (24, 48):
            aggs.append(count_if(F.col(time) >= add_hours(disch, -h)).alias(f"orders_in_last_{h}h"))
        aggs.append(F.min(disch).alias("_dis"))
    g = df.where(F.col(patient).isNotNull()).groupBy(patient).agg(*aggs)
    g = g.withColumn("order_span_hours", hours_between("first_order_time", "last_order_time"))
    if admit:
        g = g.withColumn("time_to_first_order_hours", hours_between("_adm", "first_order_time")).drop("_adm")
    if disch:
        g = g.withColumn("time_from_last_order_to_discharge_hours",
                         hours_between("last_order_time", "_dis")).drop("_dis")
    return g


# ------------------------------------------------------------------- A4 / A6
def order_distribution_overall(df: DataFrame, order: str) -> DataFrame:
    """Global value counts and proportions of ``order`` (nulls excluded)."""
    c = top_values(df.select(order), order, 0)
    total = df.where(F.col(order).isNotNull()).agg(F.count(F.lit(1))).first()[0]
    return c.select(order, "n", (F.col("n") / F.lit(float(total or 1))).alias("proportion"))


def order_distribution_patient(df: DataFrame, patient: str, order: str) -> DataFrame:
    """Per-patient proportions of each order type (long, non-zero cells; null patients dropped).

    The wide, zero-filled matrix of the reference is ``to_wide(...)`` of this.
    """
    c = (df.where(F.col(order).isNotNull() & F.col(patient).isNotNull())
           .groupBy(patient, order).agg(F.count(F.lit(1)).alias("n")))
    tot = F.sum("n").over(Window.partitionBy(patient))
    return c.select(patient, order, "n", (F.col("n") / tot).alias("proportion"))
