"""Writers.

Every writer is one distributed Spark write; nothing passes through the
driver.  File sizing uses AQE's rebalance (an explicit ``REBALANCE`` hint)
and ``maxRecordsPerFile`` instead of fixed chunk counts.
"""

from __future__ import annotations

import datetime as _dt
import time

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from cohortlens.sources.readers import read_table


def save_parquet(df: DataFrame, path: str, compression: str = "snappy", rebalance: bool = True,
                 max_records_per_file: int | None = None, partition_by: list[str] | None = None) -> str:
    """Overwrite ``path`` with ``df`` as Parquet.

    ``rebalance`` asks AQE to even out output partitions (target size from
    ``spark.sql.adaptive.advisoryPartitionSizeInBytes``) so the write
    produces files of similar size whatever the input layout.
    """
    out = df.hint("rebalance") if rebalance else df
    w = out.write.mode("overwrite").option("compression", compression)
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", int(max_records_per_file))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def save_csv(df: DataFrame, path: str, header: bool = True) -> str:
    """CSV export (written by the executors, never via driver bytes)."""
    _check_flat(df, "csv")
    df.write.mode("overwrite").option("header", header).csv(path)
    return path


def save_parquet_and_csv(df: DataFrame, base: str) -> dict[str, str]:
    """The same table as Parquet and CSV; the CSV is written from the Parquet, so ``df`` is computed once."""
    path = save_parquet(df, f"{base}.parquet")
    return {"parquet": path, "csv": save_csv(df.sparkSession.read.schema(df.schema).parquet(path), f"{base}.csv")}


def _check_flat(df: DataFrame, fmt: str) -> None:
    nested = [f.name for f in df.schema.fields
              if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    if nested and fmt == "csv":
        raise ValueError(f"columns {nested} are nested; save as parquet or json, not csv")


def save_features(df: DataFrame, feature_type: str, base_path: str, fmt: str = "csv",
                  stamp: str | None = None) -> str:
    """``<base>/engineered_features/<type>_<timestamp>`` as csv, parquet or json (records)."""
    if fmt not in ("csv", "parquet", "json"):
        raise ValueError(f"unsupported format {fmt}")
    _check_flat(df, fmt)
    stamp = stamp or _dt.datetime.now().strftime("%Y%m%d_%H%M%S")
    path = f"{base_path.rstrip('/')}/engineered_features/{feature_type}_{stamp}"
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)
    return path


def _size(spark: SparkSession, paths: list[str]) -> int:
    """Bytes of all files under ``paths``: one listing, one job."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return int(files.agg(F.sum("length")).first()[0] or 0)


def convert_tables(spark: SparkSession, src_base: str, tables: list[str], out_base: str,
                   **write_kw) -> DataFrame:
    """Convert each table to Parquet; a failing table is reported,
    not fatal.  Metrics: rows (observed during the write itself), bytes in
    and out, compression ratio, MB/s."""
    rows = []
    for t in tables:
        t0 = time.time()
        try:
            src = read_table(spark, src_base, t)
            obs = Observation(f"convert_{t}")
            observed = src.observe(obs, F.count(F.lit(1)).alias("rows"))
            src_path = src.inputFiles()
            out = save_parquet(observed, f"{out_base.rstrip('/')}/{t}.parquet", **write_kw)
            secs = time.time() - t0
            b_in = _size(spark, list(src_path))
            b_out = _size(spark, [out])
            rows.append((t, "ok", int(obs.get["rows"]), b_in, b_out,
                         (b_in / b_out) if b_out else None, (b_in / 1e6 / secs) if secs else None, None))
        except Exception as e:  # keep going; report the failure
            rows.append((t, "failed", None, None, None, None, None, str(e)[:500]))
    return spark.createDataFrame(rows, "table_name string, status string, rows bigint, bytes_in bigint, "
                                       "bytes_out bigint, ratio double, mb_per_sec double, error string")


# ----------------------------------------------------------------------- S19
def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
