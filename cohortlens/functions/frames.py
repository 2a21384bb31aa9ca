"""Frame-shape helpers: numeric column selection, wide<->long, bounded driver lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    """numeric columns by schema (no data is read)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name not in exclude]


def text_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def temporal_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, TEMPORAL) and f.name not in exclude]


def q(name: str) -> Column:
    """Column by exact name (back-quoted, so dots and spaces are literal)."""
    return F.col("`" + name.replace("`", "``") + "`")


# bytes of one value in memory
_WIDTH = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4, T.DoubleType: 8,
          T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8}


def value_width(dtype: T.DataType) -> int | None:
    """Bytes of a value of a fixed-width type, else None."""
    if isinstance(dtype, T.DecimalType):
        return 8 if dtype.precision <= 18 else 16
    return _WIDTH.get(type(dtype))


def stack_stats(wide: DataFrame, id_cols: list[str], features: list[str], stats: list[str],
                feature_col: str = "feature") -> DataFrame:
    """Turn columns named ``{feature}__{stat}`` into rows ``(id..., feature, stat...)``.

    Used after a single wide ``groupBy().agg(...)``: aggregating wide and
    stacking the small result is far cheaper than exploding every input row.
    """
    arr = F.array(*[F.struct(F.lit(f).alias(feature_col),
                             *[q(f"{f}__{s}").cast("double").alias(s) for s in stats])
                    for f in features])
    return (wide.select(*id_cols, F.explode(arr).alias("_s"))
                .select(*id_cols, *[F.col(f"_s.{c}").alias(c) for c in [feature_col] + stats]))


def melt(df: DataFrame, id_cols: list[str], value_cols: list[str], var_name: str = "feature",
         value_name: str = "value") -> DataFrame:
    """Wide -> long (U3) with values cast to double."""
    cast = df.select(*id_cols, *[q(c).cast("double").alias(c) for c in value_cols])
    return cast.unpivot(id_cols, value_cols, var_name, value_name)
