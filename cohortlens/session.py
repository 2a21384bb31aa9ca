"""Session construction and the two session-level settings the library relies on."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings every plan in the library assumes.  They are session
# scoped and safe to set on a shared session:
#  * timestamps stay NTZ end to end (source parquet is timestamp without zone);
#  * AQE re-plans joins, coalesces small shuffles and splits skewed partitions.
RUNTIME_DEFAULTS = {
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def apply_runtime_defaults(spark: SparkSession) -> SparkSession:
    for k, v in RUNTIME_DEFAULTS.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark


def get_spark(master: str | None = None, app: str = "cohortlens",
              shuffle_partitions: int | None = None, **extra) -> SparkSession:
    """Build (or reuse) a session.  On a cluster pass ``master=None`` and let
    spark-submit decide; locally ``local[N]`` with N shuffle partitions."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (b.config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true")
          .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "128m")
          # materialised intermediates are deleted from the shared folder once unreferenced
          .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in extra.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_runtime_defaults(spark)
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder used to cut lineage (``DataFrame.checkpoint``) and
    to stage written tables.

    On a cluster this is whatever ``spark.checkpoint.dir`` names (a shared
    file system).  Only when it is unset -- local runs and tests -- a fresh
    scratch folder is created and registered.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            # a machine-local folder would not be shared by the executors of a cluster
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors "
                               "(HDFS / object store) before running cohortlens on a cluster")
        d = tempfile.mkdtemp(prefix="cohortlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub path of the shared checkpoint folder for written intermediate tables."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def materialize(df):
    """Compute ``df`` once and cut its lineage (reliable checkpoint in the shared
    folder).  Used for intermediates that a plan reads several times -- an
    aggregated table feeding both a statistic and a join -- so the expensive
    upstream work (scans, tokenising, shuffles) runs once, and a lost executor
    re-reads the checkpoint instead of recomputing the lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Written intermediates of one operator run, in a folder of their own under the shared checkpoint folder.

    ``keep`` writes a table as compressed Parquet and reads it back with its schema, so later reads prune
    columns and see real sizes; ``drop`` deletes tables that nothing reads any more, ``close`` the whole folder.
    Nothing depends on the session's checkpoint settings, and a lost executor rereads shared files.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self._n = spark, scratch_path(spark, f"{name}-{uuid.uuid4().hex}"), 0

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.path}/{self._n}"
        self._n += 1
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            delete_path(self.spark, t._scratch)

    def sweep(self) -> None:
        """Let go of finished plans: Spark deletes a shuffle's files when the driver has collected its plan."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def close(self) -> None:
        delete_path(self.spark, self.path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a written intermediate through Hadoop's file system of its path."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
