"""Sets of integer subject ids as bitmaps.

A set is a table ``(bucket, bits)``: one bitmap of 4 KB for each block of 32,768 consecutive ids that holds any.
It is stored as such, its intersection is a bitwise AND per bucket, and a table is restricted by a look at one
bit per row: the bitmaps are broadcast when their number is at most ``BROADCAST_BUCKETS``, otherwise the
ids are joined by shuffle.  Ids are any 64-bit integers; null ids belong to no set.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegralType

BUCKET_IDS = 32_768           # ids of one bitmap, fixed by Spark's bitmap functions
BROADCAST_BUCKETS = 8_192     # bitmaps of 4 KB each that may be broadcast: 32 MB


def _require_integers(df: DataFrame, key: str) -> None:
    if not isinstance(df.schema[key].dataType, IntegralType):
        raise TypeError(f"an id bitmap needs integer ids, {key} is {df.schema[key].dataType.simpleString()}")


def id_bitmap(df: DataFrame, key: str = "subject_id") -> DataFrame:
    """``(bucket, bits)`` of the distinct non-null ids of ``df``."""
    _require_integers(df, key)
    ids = df.select(F.col(key).cast("long").alias("_id")).where(F.col("_id").isNotNull()).distinct()
    return (ids.groupBy(F.bitmap_bucket_number("_id").alias("bucket"))
               .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_id")).alias("bits")))


def intersect_bitmaps(bitmaps: list[DataFrame]) -> DataFrame:
    """Ids that are in every set: the AND of the bitmaps of each bucket that all sets have."""
    if not bitmaps:
        raise ValueError("no id sets to intersect")
    rows = reduce(lambda a, b: a.unionByName(b), bitmaps)
    both = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"), F.bitmap_and_agg("bits").alias("bits"))
    return both.where((F.col("_n") == len(bitmaps)) & (F.bitmap_count("bits") > 0)).select("bucket", "bits")


def id_count(bitmap: DataFrame) -> DataFrame:
    """Number of ids in the set: one row ``n_ids``."""
    return bitmap.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).cast("long").alias("n_ids"))


def _byte(bits: Column, at: Column) -> Column:
    return F.conv(F.hex(F.substring(bits, at + 1, F.lit(1))), 16, 10).cast("int")


def _has(bits: Column, position: Column) -> Column:
    position = position.cast("int")
    byte = _byte(bits, F.shiftright(position, 3))
    return byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), position.bitwiseAND(F.lit(7)) + 1)) != 0


def ids_of(bitmap: DataFrame, key: str = "subject_id") -> DataFrame:
    """The ids of a set, one row each; bytes without ids are dropped before their bits are looked at."""
    bytes_ = (bitmap.select("bucket", "bits", F.explode(F.sequence(F.lit(0), F.lit(BUCKET_IDS // 8 - 1))).alias("_at"))
                    .select("bucket", "_at", _byte(F.col("bits"), F.col("_at")).alias("_b")).where(F.col("_b") != 0))
    bits = bytes_.select("bucket", "_at", "_b", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("_i"))
    set_ = bits.where(F.col("_b").bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), F.col("_i") + 1)) != 0)
    at = F.col("_at") * 8 + F.col("_i")
    top = F.col("bucket") * BUCKET_IDS          # the largest id of a bucket; positions count up above 0 and down from it below
    return set_.select(F.when(F.col("bucket") > 0, top - (BUCKET_IDS - 1) + at).otherwise(top - at).cast("long").alias(key))


def rows_in(df: DataFrame, bitmap: DataFrame, key: str = "subject_id", broadcast_buckets: int = BROADCAST_BUCKETS) -> DataFrame:
    """Rows of ``df`` whose id is in the set, columns as they are.

    ``bitmap`` should be a stored table: its number of buckets and their range are read first.  The range
    becomes a pushed filter on ``key``, so blocks of a sorted table without such ids are not read.
    """
    _require_integers(df, key)
    seen = bitmap.agg(F.count(F.lit(1)).alias("n"), F.min("bucket").alias("lo"), F.max("bucket").alias("hi")).first()
    if not seen["n"]:
        return df.limit(0)
    low, high = max(seen["lo"] * BUCKET_IDS - (BUCKET_IDS - 1), -(1 << 63)), min(seen["hi"] * BUCKET_IDS, (1 << 63) - 1)
    inside = df.where(F.col(key).between(F.lit(low).cast("long"), F.lit(high).cast("long")))
    if seen["n"] > broadcast_buckets:
        return inside.join(ids_of(bitmap, "_id"), F.col(key) == F.col("_id"), "left_semi")
    held = F.broadcast(bitmap.select(F.col("bucket").alias("_set_bucket"), F.col("bits").alias("_set_bits")))
    return (inside.join(held, F.bitmap_bucket_number(F.col(key).cast("long")) == F.col("_set_bucket"))
                  .where(_has(F.col("_set_bits"), F.bitmap_bit_position(F.col(key).cast("long")))).drop("_set_bucket", "_set_bits"))


def restrict_tables(tables: dict[str, DataFrame], bitmap: DataFrame, key: str = "subject_id") -> dict[str, DataFrame]:
    """Every table with ``key`` restricted to the set; dictionaries stay whole."""
    return {n: (rows_in(t, bitmap, key) if key in t.columns else t) for n, t in tables.items()}
