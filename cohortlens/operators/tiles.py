"""Blocks of rows as arrays: the helpers of operators whose work is dense arithmetic in tasks.

``vector_rows`` turns feature columns into one array column; ``tiles`` gathers rows into blocks of about
``TILE`` rows by a hash of their key, one row of a block table each, so a block has a bounded size
whatever the data.  Tasks see numpy matrices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortlens.functions.frames import q

TILE = 2048


def vector_rows(df: DataFrame, features: list[str], *keep) -> DataFrame:
    """``keep``, ``x``: the features as one array; rows with a null feature are left out."""
    return df.where(" AND ".join(f"`{f}` IS NOT NULL" for f in features)).select(*keep, F.array(*[q(f).cast("double") for f in features]).alias("x"))


def matrix(col, width: int) -> np.ndarray:
    """A list column whose lists all have ``width`` numbers, or a column of binary blocks of such rows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_binary(col.type):
        return np.concatenate([np.zeros(0), *[np.frombuffer(v.as_buffer()) for v in col]]).reshape(-1, width)
    off = col.offsets.to_numpy()
    return col.values.to_numpy(zero_copy_only=False)[off[0]:off[-1]].reshape(-1, width)


def tiles(rows: DataFrame, width: int, n: int, size: int = TILE) -> DataFrame:
    """``tile, key, cluster, x`` (blobs) of ``rows(key long, cluster long, x)``, ``n`` rows in all."""
    count = max(1, -(-n // size))

    def run(key, table):
        cells = [table.column("key").to_numpy().astype(np.int64), table.column("cluster").to_numpy().astype(np.int64), matrix(table.column("x"), width)]
        return pa.table({"tile": pa.array([key[0].as_py()], pa.int64()), **{c: pa.array([v.tobytes()], pa.binary()) for c, v in zip(("key", "cluster", "x"), cells)}})

    return (rows.withColumn("tile", F.pmod(F.xxhash64("key"), F.lit(count)))
                .groupBy("tile").applyInArrow(run, "tile long, key binary, cluster binary, x binary"))
