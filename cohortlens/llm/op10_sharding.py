"""Sharding over fixed virtual slots with a versioned slot-to-shard map.

Every record hashes into one of ``n_slots`` virtual slots; the bytes per slot are
one small aggregate; a map from slot to shard is stored with a version number.
Version 0 deals the slots in turn; rebalancing edits the newest stored version -- it moves (or swaps) as
few slots as it can from the fullest to the emptiest shard until no edit brings
the shards' bytes closer -- and stores the result as the next version, or none where
nothing was edited.  With fewer shards than the stored map has, the slots of the shards that
are gone go to the emptiest ones first; new shards start empty.  The law
that holds is therefore ``bytes``: shard sizes are near equal.

Only the slot table (``n_slots`` rows, a parameter) reaches the driver.  Records
never move through it: they meet the map in a broadcast join of ``n_slots`` rows.

Defined results: a null text has size 1 and checksum 0 like an empty one; null ids
and repeated rows are records like any other; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cohortlens.session import materialize, scratch_path

N_SLOTS = 4096


def records(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """``(doc_id, size, text_crc32, vslot)``: what the placement needs of each row."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                      (F.octet_length(raw) + 1).cast("long").alias("size"),
                      F.crc32(raw).alias("text_crc32"))
    slot = F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(n_slots)).cast("int")
    return out.withColumn("vslot", slot)


def slot_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def initial_map(n_slots: int, n_shards: int) -> np.ndarray:
    """Version 0: slots dealt to the shards in turn."""
    return np.arange(n_slots) % n_shards


def rebalance(shard_of: np.ndarray, slot_bytes: np.ndarray, n_shards: int) -> np.ndarray:
    """Edit a map until no move or swap between the fullest and the emptiest shard narrows their gap."""
    shard_of = shard_of.copy()
    load = np.bincount(shard_of, weights=slot_bytes, minlength=n_shards).astype(np.int64)
    while True:
        hi, lo = int(load.argmax()), int(load.argmin())
        gap = int(load[hi] - load[lo])
        a, b = (np.flatnonzero((shard_of == s) & (slot_bytes > 0)) for s in (hi, lo))
        if gap <= 1 or not len(a):
            return shard_of
        # what leaves the fullest shard, less what comes back (nothing, or one slot of the emptiest)
        back = np.append(slot_bytes[b], 0)
        order = np.argsort(back, kind="stable")
        want = slot_bytes[a] - gap / 2
        at = np.clip(np.searchsorted(back[order], want), 0, len(back) - 1)
        best = None
        for cand in (at, np.maximum(at - 1, 0)):
            net = slot_bytes[a] - back[order[cand]]
            left = np.abs(gap - 2 * net)
            i = int(left.argmin())
            if best is None or left[i] < best[0]:
                best = (int(left[i]), a[i], order[cand[i]], int(net[i]))
        left, out, into, net = best
        if left >= gap:
            return shard_of
        shard_of[out] = lo
        if into < len(b):
            shard_of[b[into]] = hi
        load[hi] -= net
        load[lo] += net


def refit(shard_of: np.ndarray, slot_bytes: np.ndarray, n_shards: int) -> np.ndarray:
    """A stored map for ``n_shards``: slots of shards that are gone, largest first, go to the emptiest shard."""
    shard_of = shard_of.copy()
    gone = np.flatnonzero(shard_of >= n_shards)
    if len(gone):
        stay = shard_of < n_shards
        load = np.bincount(shard_of[stay], weights=slot_bytes[stay], minlength=n_shards).astype(np.int64)
        slots = np.bincount(shard_of[stay], minlength=n_shards)
        for i in gone[np.argsort(-slot_bytes[gone], kind="stable")]:
            to = int(np.lexsort((slots, load))[0])
            shard_of[i] = to
            load[to] += slot_bytes[i]
            slots[to] += 1
    return shard_of


def map_versions(spark: SparkSession, path: str) -> list[int]:
    """Versions of the map that were written whole (their folder has Spark's success mark), ascending."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(top)]
    found = [int(n.removeprefix("version=")) for n in names if n.startswith("version=")]
    return sorted(v for v in found if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/version={v}/_SUCCESS")))


def write_map(spark: SparkSession, path: str, version: int, shard_of: np.ndarray) -> None:
    """Store one version of the slot-to-shard map; earlier versions stay readable.  What a lost driver left half written is replaced."""
    if version in map_versions(spark, path):
        raise FileExistsError(f"{path} has a version {version}")
    (spark.createDataFrame([(i, int(s)) for i, s in enumerate(shard_of)], "vslot int, shard int")
          .coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}"))


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("vslot int, shard int").parquet(f"{path}/version={version}")


def shard(docs: DataFrame, n_shards: int = 8, n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, vslot, shard, slot, map_version``.

    With a ``map_path`` the newest map stored there is edited and the next version written beside it; without
    one the map starts anew.  A stored map keeps its number of slots.

    ``slot`` is the row's place in its shard, gapless from 0: the rows of the
    shard's earlier virtual slots plus the row's rank in its own one.
    """
    spark = docs.sparkSession
    path = map_path or scratch_path(spark, f"slotmap-{uuid.uuid4().hex}")
    rows = materialize(records(docs, n_slots))
    bytes_, count = np.zeros(n_slots, dtype=np.int64), np.zeros(n_slots, dtype=np.int64)
    for r in slot_totals(rows).collect():   # at most n_slots rows
        bytes_[r.vslot], count[r.vslot] = r.bytes, r.rows
    stored = map_versions(spark, path)
    if stored:
        version = stored[-1]
        old = np.full(n_slots, -1)
        for r in read_map(spark, path, version).collect():   # n_slots rows
            if r.vslot >= n_slots:
                raise ValueError(f"the stored map has more than {n_slots} slots")
            old[r.vslot] = r.shard
        if (old < 0).any():
            raise ValueError(f"the stored map has fewer than {n_slots} slots")
    else:
        version, old = 0, initial_map(n_slots, n_shards)
        write_map(spark, path, 0, old)
    new = rebalance(refit(old, bytes_, n_shards), bytes_, n_shards)
    if (new != old).any():
        version += 1
        write_map(spark, path, version, new)
    counts = spark.createDataFrame([(i, int(c)) for i, c in enumerate(count)], "vslot int, n_rows long")
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    placed = (read_map(spark, path, version).join(F.broadcast(counts), "vslot")
              .withColumn("start", F.coalesce(F.sum("n_rows").over(before), F.lit(0))).drop("n_rows"))
    rank = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size"))
    return (rows.withColumn("_rank", rank).join(F.broadcast(placed), "vslot")
                .select("doc_id", "size", "text_crc32", "vslot", "shard",
                        (F.col("start") + F.col("_rank") - 1).cast("long").alias("slot"),
                        F.lit(version).alias("map_version")))
