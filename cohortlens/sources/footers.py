"""Column catalog from Parquet footers.

Row counts, null counts and ranges are aggregates that Spark's Parquet reader answers from
the footers (``PushedAggregation`` in the plan): tasks open each file's footer and no data page.
The reader does so in its second version only, so these plans live in a session of their own on the
same context; the caller's settings stay as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, ByteType, IntegerType, LongType, MapType, ShortType, StructType

from cohortlens.functions.frames import q, value_width
from cohortlens.session import apply_runtime_defaults

_NESTED = (ArrayType, MapType, StructType)
_INTEGERS = (ByteType, ShortType, IntegerType, LongType)
COLUMNS = ("table_name string, column_name string, type string, n_rows bigint, n_values bigint, min_value bigint, max_value bigint, "
           "fixed_bytes bigint")


def footer_session(spark: SparkSession) -> SparkSession:
    s = apply_runtime_defaults(spark.newSession())
    s.conf.set("spark.sql.sources.useV1SourceList", "")
    s.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return s


def footer_columns(session: SparkSession, table: str, path: str) -> DataFrame:
    """One row per column of a Parquet table: ``n_rows``; ``n_values`` (non-null) and, for integers without nulls, the range;
    ``fixed_bytes`` of fixed-width values in memory.

    A row group of nulls alone has no range in its footer, so columns with nulls get none; the counts are read first to tell.

    Nested columns have several leaves in the footer and get no ``n_values``; neither does any column of a table with
    structs or maps, whose leaves the reader does not tell apart.
    """
    df = session.read.parquet(path)
    nested = any(isinstance(f.dataType, (MapType, StructType)) or isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, _NESTED)
                 for f in df.schema.fields)
    plain = [] if nested else [f for f in df.schema.fields if not isinstance(f.dataType, _NESTED)]
    counts = [F.count(F.lit(1)).alias("_rows"), *[F.count(q(f.name)).alias(f"_n{i}") for i, f in enumerate(plain)]]
    seen = df.agg(*counts).first()
    whole = [f for i, f in enumerate(plain) if isinstance(f.dataType, _INTEGERS) and seen[f"_n{i}"] == seen["_rows"]]
    agg = df.agg(*counts,
                 *[F.min(q(f.name)).alias(f"_a{i}") for i, f in enumerate(whole)], *[F.max(q(f.name)).alias(f"_b{i}") for i, f in enumerate(whole)])
    none = F.lit(None).cast("long")
    at = {f.name: i for i, f in enumerate(plain)}
    ints = {f.name: i for i, f in enumerate(whole)}

    def row(f):
        width = value_width(f.dataType)
        return F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("type"),
                        (F.col(f"_n{at[f.name]}") if f.name in at else none).alias("n_values"),
                        (F.col(f"_a{ints[f.name]}").cast("long") if f.name in ints else none).alias("min_value"),
                        (F.col(f"_b{ints[f.name]}").cast("long") if f.name in ints else none).alias("max_value"),
                        (F.col("_rows") * width if width else none).alias("fixed_bytes"))

    return (agg.select(F.col("_rows"), F.explode(F.array(*[row(f) for f in df.schema.fields])).alias("c"))
               .select(F.lit(table).alias("table_name"), "c.column_name", "c.type", F.col("_rows").alias("n_rows"), "c.n_values",
                       "c.min_value", "c.max_value", "c.fixed_bytes"))


def catalog_columns(spark: SparkSession, catalog: DataFrame) -> DataFrame:
    """Every column of every catalogued table (a result of ``catalog.scan_directory``) as one plan.

    Text files have no footer: their columns come with their names and types, and no counts.
    """
    session = footer_session(spark)
    parts = []
    for r in catalog.select("table_name", "suffix", "table_path").collect():      # one row per table
        if r["suffix"] == ".parquet":
            parts.append(footer_columns(session, r["table_name"], r["table_path"]))
        else:
            sch = session.read.option("header", True).csv(r["table_path"]).schema
            parts.append(session.createDataFrame([(r["table_name"], f.name, f.dataType.simpleString(), None, None, None, None, None) for f in sch.fields], COLUMNS))
    return reduce(lambda a, b: a.unionByName(b), parts) if parts else session.createDataFrame([], COLUMNS)
