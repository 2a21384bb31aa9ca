"""Table catalog.

The file listing is a DataFrame (Spark's ``binaryFile`` source with only
``path``/``length`` selected, so file contents are never read); grouping to
tables, sizes and the parquet > csv > csv.gz choice are DataFrame ops.
Per-table column lists come from file metadata (one schema read per table,
bounded by the number of tables).
"""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cohortlens.functions.frames import numeric_columns, temporal_columns
from cohortlens.operators.idsets import id_bitmap
from cohortlens.session import scratch_path

# regex over a file path relative to the root: [<module>/]<table><suffix>[/part-file...]
_FILE_RE = r"^(?:(hosp|icu)/)?([^/]+?)(\.parquet|\.csv\.gz|\.csv)(?:/.*)?$"


def scan_directory(spark: SparkSession, root: str) -> DataFrame:
    """One row per table under ``root`` (and its ``hosp``/``icu`` modules):
    module, table_name, suffix of the preferred file, path, size_bytes, n_files.

    Empty parquet directories list no files and so do not appear.
    """
    root = root.rstrip("/")
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
             .select("path", "length"))
    full = F.regexp_replace("path", r"^file:", "")
    under = re.escape(root) + "/"
    rel = F.regexp_extract(full, under + "(.*)$", 1)
    parsed = (files.where(full.rlike(under)).select(
        F.regexp_extract(rel, _FILE_RE, 1).alias("module"),
        F.regexp_extract(rel, _FILE_RE, 2).alias("table_name"),
        F.regexp_extract(rel, _FILE_RE, 3).alias("suffix"),
        F.concat(F.lit(root + "/"), F.regexp_extract(rel, r"^((?:(?:hosp|icu)/)?[^/]+?(?:\.parquet|\.csv\.gz|\.csv))", 1))
         .alias("table_path"),
        "length", "path")
        .where((F.col("table_name") != "") & ~F.col("path").rlike(r"/(_SUCCESS|\.[^/]*)$")).drop("path"))
    per_file = parsed.groupBy("module", "table_name", "suffix", "table_path").agg(
        F.sum("length").alias("size_bytes"), F.count(F.lit(1)).alias("n_files"))
    prio = F.when(F.col("suffix") == ".parquet", 0).when(F.col("suffix") == ".csv", 1).otherwise(2)
    w = Window.partitionBy("module", "table_name").orderBy(prio)
    best = per_file.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return best.withColumn("display_name", F.initcap(F.regexp_replace("table_name", "_", " ")))


def study_tables(catalog: DataFrame, names: list[str]) -> DataFrame:
    """The study subset of the catalog."""
    return catalog.where(F.col("table_name").isin(names))


def table_columns(spark: SparkSession, catalog: DataFrame) -> DataFrame:
    """Columns of every catalogued table from file metadata: (table_name, column, type)."""
    rows = []
    for r in catalog.select("table_name", "suffix", "table_path").collect():  # one row per table
        if r["suffix"] == ".parquet":
            sch = spark.read.parquet(r["table_path"]).schema
        else:
            sch = spark.read.option("header", True).csv(r["table_path"]).schema
        rows += [(r["table_name"], f.name, f.dataType.simpleString()) for f in sch.fields]
    return spark.createDataFrame(rows, "table_name string, column string, type string")


# ------------------------------------------------------------------------ S8
def cached_subject_ids(spark: SparkSession, df: DataFrame, table: str, params: dict | None = None,
                       recalculate: bool = False, key: str = "subject_id", root: str | None = None) -> DataFrame:
    """Distinct subject ids of a table, cached as Parquet in the shared folder.

    The cache key includes a hash of the filter parameters (so filtered and
    unfiltered id sets never collide) and of the source files the table is read
    from (so a rewritten or another source is another key); ``recalculate``
    overwrites it.
    """
    ids = df.select(key).where(F.col(key).isNotNull()).distinct()
    return _cached(spark, df, ids, table, params, recalculate, root)


def cached_id_bitmap(spark: SparkSession, df: DataFrame, table: str, params: dict | None = None,
                     recalculate: bool = False, key: str = "subject_id", root: str | None = None) -> DataFrame:
    """The same set as stored bitmaps (:mod:`cohortlens.operators.idsets`), under the same cache key rules."""
    return _cached(spark, df, id_bitmap(df, key), f"{table}-{key}-bitmap", params, recalculate, root)


def _cached(spark, df, ids, name, params, recalculate, root) -> DataFrame:
    source = hashlib.sha1("\n".join(sorted(df.inputFiles())).encode()).hexdigest()
    tag = hashlib.sha1(json.dumps([params or {}, source], sort_keys=True, default=str).encode()).hexdigest()[:12]
    path = f"{(root or scratch_path(spark, 'subject_ids')).rstrip('/')}/{name}-{tag}.parquet"
    if not recalculate:
        try:
            return spark.read.parquet(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):   # anything but "not cached yet" is a real error
                raise
    ids.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


# ---------------------------------------------------------------- F14 - F16
# Name fragments that mark order-like and temporal columns,
# date patterns of text columns, and patient-id candidates (in order).
ORDER_TERMS = ["order", "medication", "drug", "procedure", "treatment", "item", "event", "action",
               "prescription", "poe"]
TIME_TERMS = ["time", "date", "datetime", "timestamp", "start", "end", "created", "updated",
              "admission", "discharge"]
DATE_REGEXES = [r"\d{4}-\d{2}-\d{2}", r"\d{2}/\d{2}/\d{4}", r"\d{4}/\d{2}/\d{2}", r"\d{2}-\d{2}-\d{4}"]
PATIENT_ID_CANDIDATES = ["subject_id", "patient_id", "patientid", "pat_id", "patient"]


def column_roles(df: DataFrame) -> DataFrame:
    """F14-F16 as one profile: rows (column, role, evidence).

    Roles: ``order`` by name; ``temporal`` by name and type, or for text
    columns when any value looks like a date (one aggregate over all such
    columns); ``patient_id`` from the candidate list, else the
    first ``*id*`` column whose distinct count exceeds 10% of rows.
    """
    spark = df.sparkSession
    rows = []
    lower = {c: c.lower() for c in df.columns}
    for c, lc in lower.items():
        if any(t in lc for t in ORDER_TERMS):
            rows.append((c, "order", "name"))
        elif lc.endswith(("_id", "_type", "_name")) or lc.startswith("order_"):
            rows.append((c, "order", "affix"))
    tcols = set(temporal_columns(df))
    types = dict(df.dtypes)
    named = [c for c, lc in lower.items() if any(t in lc for t in TIME_TERMS)]
    texts = [c for c in named if c not in tcols and types[c] == "string"]
    dated = df.agg(*[F.max(F.col(c).rlike("|".join(DATE_REGEXES))).alias(c) for c in texts]).first() if texts else {}
    for c in named:
        if c in tcols:
            rows.append((c, "temporal", "type"))
        elif c in texts and dated[c]:
            rows.append((c, "temporal", "pattern"))
    pid = next((c for c in PATIENT_ID_CANDIDATES if c in df.columns), None)
    if pid is not None:
        rows.append((pid, "patient_id", "name"))
    else:
        idc = [c for c in df.columns if "id" in lower[c]]
        if idc:
            agg = df.agg(F.count(F.lit(1)).alias("_n"),
                         *[F.approx_count_distinct(c).alias(c) for c in idc]).first()
            n = agg["_n"]
            for c in idc:
                est = agg[c]
                if abs(est - 0.1 * n) <= 0.05 * n:  # near the threshold: exact count
                    est = df.select(c).distinct().count()
                if est > 0.1 * n:
                    rows.append((c, "patient_id", "distinct>10%"))
                    break
    return spark.createDataFrame(rows, "column string, role string, evidence string")


def numeric_feature_columns(df: DataFrame, exclude=()) -> list[str]:
    """F13."""
    return numeric_columns(df, exclude)
