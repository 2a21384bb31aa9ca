"""Null handling for integer columns read from text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Text tokens that mean "missing" in integer columns.
NA_TOKENS = ["", "NULL", "null", "None"]


def normalize_na(c, target_type: str = "bigint") -> Column:
    """Text -> ``target_type``: NA tokens and unparsable text become null."""
    col = F.col(c) if isinstance(c, str) else c
    txt = F.trim(col.cast("string"))
    return F.when(txt.isin(NA_TOKENS), F.lit(None)).otherwise(txt).try_cast(target_type)


def normalize_na_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Apply :func:`normalize_na` to every column named in ``types`` that exists."""
    cols = []
    for f in df.schema.fields:
        if f.name in types:
            cols.append(normalize_na(f.name, types[f.name]).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
