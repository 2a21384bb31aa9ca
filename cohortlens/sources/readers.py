"""Typed table scans.

Parquet is preferred over CSV over CSV.gz for the same table.  CSV is read
with an explicit schema from the type registry (never ``inferSchema``);
integer columns are parsed as text and converted by the NA rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlens import schema
from cohortlens.functions.frames import numeric_columns
from cohortlens.functions.nulls import normalize_na

SUFFIX_PRIORITY = (".parquet", ".csv", ".csv.gz")


def _exists(spark: SparkSession, path: str) -> bool:
    """Existence check through Spark's own file listing (any Hadoop file
    system: local, HDFS, object stores); an empty directory counts as absent."""
    try:
        files = spark.read.format("binaryFile").load(path).select("path")
    except Exception:  # path not found
        return False
    return not files.isEmpty()


def resolve_table_path(spark: SparkSession, base: str, table: str) -> str:
    """``base/table.parquet`` (file or directory) > ``.csv`` > ``.csv.gz``."""
    for suf in SUFFIX_PRIORITY:
        p = f"{base.rstrip('/')}/{table}{suf}"
        if _exists(spark, p):
            return p
    raise FileNotFoundError(f"no parquet/csv/csv.gz file for table {table} under {base}")


def read_csv_typed(spark: SparkSession, path: str, partitions_after_gz: int | None = None) -> DataFrame:
    """S3 + S5: CSV with the registry's schema; integer NA tokens -> null.

    A ``.gz`` file is one unsplittable block; ``partitions_after_gz`` spreads
    it with one round-robin shuffle so downstream stages run in parallel.
    """
    header = spark.read.option("header", True).csv(path).columns
    df = (spark.read.schema(schema.read_schema_for(header)).option("header", True)
          .option("mode", "PERMISSIVE").csv(path))
    cols = []
    for f in schema.schema_for(header).fields:
        if schema.is_integer_column(f.name):
            cols.append(normalize_na(f.name, f.dataType.simpleString()).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    df = df.select(*cols)
    if partitions_after_gz and path.endswith(".gz"):
        df = df.repartition(int(partitions_after_gz))
    return df


def read_table(spark: SparkSession, base: str, table: str, **kw) -> DataFrame:
    """Resolve the preferred file of ``table`` and scan it lazily."""
    path = resolve_table_path(spark, base, table)
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    return read_csv_typed(spark, path, **kw)


def numeric_input(spark: SparkSession, path: str) -> DataFrame:
    """An external CSV/Parquet file reduced to its numeric columns."""
    if path.endswith((".csv", ".csv.gz")):
        df = read_csv_typed(spark, path)
    else:   # a Parquet file or directory on any file system
        df = spark.read.parquet(path)
    return df.select(*numeric_columns(df))
