r"""Merkle manifest of a dataset with pointer-jumping proofs.

``H`` is the lowercase hex SHA-256 of its concatenated inputs.  Every row is a leaf: ``H`` of its fields, each
``-`` if null, else its UTF-8 byte count, ``:`` and the value.  Per group (source), leaves ascend by id and
every ``FAN`` consecutive nodes (the last run may be shorter) become their ``H`` until one node, the subroot, is left; the
subroots in order of their groups (null first, then bytewise) are reduced likewise to the root.

1. **Places.**  Leaves are range-partitioned by (group, id, leaf) and written sorted; a leaf's place is its rank in its
   partition plus the rows of its group in earlier partitions.  No group, however large, meets in one task.
2. **Levels.**  One aggregate per level makes runs of at most ``FAN`` nodes; each level has a sixteenth of the rows.
3. **Pointer jumping.**  Every inner node starts with a pointer to its parent and the segment of its siblings there.
   Rounds of self-joins replace the pointer by the pointer of the node it points to and append that node's segment, so the
   distance doubles until all pointers end at the root.  Nodes that have arrived wait aside.  Leaves take their
   parent's finished segment in one last jump, run by run, so no long segment is shuffled per row.
4. **Proofs.**  The proof of a row is the list of its siblings from its run up to the root; ``folded_root``
   folds a leaf with it.

Defined results: null fields count as ``-``, an empty text is ``0:``; a null id comes first; rows that repeat are leaves
of their own, in any order where they are equal; an empty table gives no rows; only the named fields enter the leaf, extra columns
are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.session import Scratch

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = ""                 # name of the tree over the groups; groups are named "n" (null) or "s" + value
BROADCAST_NODES = 4096   # nodes (a few KB each at most) that may be broadcast in a jump
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sha(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(c: Column) -> Column:
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(**changed: Column) -> Column:
    return sha(*[field(changed.get(f, F.col(f))) for f in FIELDS])


def group_name(c: Column) -> Column:
    return F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), c.cast("string")))


def placed(df: DataFrame, group: str, order: list[str], scratch: Scratch) -> DataFrame:
    """``df`` with ``i``, the row's place in its group by ``order``, and ``size``, the group's rows; no group is gathered in a task.

    ``n`` sorts before ``s...`` and strings sort by UTF-8 bytes, so groups come in the manifest's order.
    """
    held = scratch.keep(df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
                          .withColumn("_at", F.monotonically_increasing_id()))      # partition number and rank in it, written with the row
    part = F.shiftright("_at", 33)
    runs = held.groupBy(group, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = runs.select(group, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_start"),
                        F.sum("_n").over(Window.partitionBy(group)).alias("size"))
    return (held.withColumn("_part", part).join(start, [group, "_part"])
                .withColumn("i", (F.col("_start") + F.col("_at")).cast("long")).drop("_part", "_at", "_start"))


def grow(leaves: DataFrame, scratch: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """The runs ``t, i, members, size`` of each level of all trees above ``leaves(t, i, h, size)``, and ``t, level, h`` of the trees' tops.

    ``i`` is a run's place in the next level, ``members`` are the hashes of its nodes in order (``FAN`` at most), ``size`` is the
    number of the tree's nodes on the run's level.
    """
    now, runs, tops = leaves, [], []
    while True:
        tops.append(now.where("size = 1").select("t", F.lit(len(runs)).alias("level"), "h"))
        members = F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"])
        r = scratch.keep(now.where("size > 1").groupBy("t", F.floor(F.col("i") / FAN).cast("long").alias("p"))
                            .agg(members.alias("members"), F.max("size").alias("size")).withColumnRenamed("p", "i"))
        if r.isEmpty():
            return runs, scratch.keep(reduce(DataFrame.union, tops))
        runs.append(r)
        now = r.select("t", "i", sha(F.array_join("members", "")).alias("h"), F.ceil(F.col("size") / FAN).alias("size"))


def siblings(runs: DataFrame, level: int) -> DataFrame:
    """Nodes of ``level`` with their pointer and first segment: ``t, level, i, pt, plevel, pi, seg``."""
    other = F.concat(F.slice("members", F.lit(1), F.col("pos")), F.slice("members", F.col("pos") + 2, F.lit(FAN)))
    return (runs.select("t", F.col("i").alias("pi"), "members", F.posexplode("members").alias("pos", "_h"))
                .select("t", F.lit(level).alias("level"), (F.col("pi") * FAN + F.col("pos")).alias("i"),
                        F.col("t").alias("pt"), F.lit(level + 1).alias("plevel"), "pi",
                        F.array(F.struct("pos", F.unhex(F.array_join(other, "")).alias("hs"))).alias("seg"), F.lit(None).cast("string").alias("subroot")))


def jump(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """``t, level, i, seg, subroot`` of all nodes, segments up to the root: pointers double their distance by self-joins.

    ``nodes`` have pointers ``pt, plevel, pi`` (null at the root, whose segment is empty).  A node that is pointed to from a
    distance lies that many levels up, or in the tree over the groups; as soon as these are ``BROADCAST_NODES`` or fewer they are
    broadcast, before that no node is pointed to by more than a few.
    """
    now, far = nodes, 1
    while not (open_ := now.where(F.col("pt").isNotNull())).isEmpty():
        aims = now.where((F.col("level") >= far) | (F.col("t") == TOP))
        ahead = aims.select(F.col("t").alias("pt"), F.col("level").alias("plevel"), F.col("i").alias("pi"),
                            F.col("pt").alias("qt"), F.col("plevel").alias("qlevel"), F.col("pi").alias("qi"), F.col("seg").alias("more"), F.col("subroot").alias("sub2"))
        ahead = F.broadcast(ahead) if aims.count() <= BROADCAST_NODES else ahead
        moved = (open_.join(ahead, ["pt", "plevel", "pi"])
                      .select("t", "level", "i", F.col("qt").alias("pt"), F.col("qlevel").alias("plevel"), F.col("qi").alias("pi"),
                              F.concat("seg", "more").alias("seg"), F.coalesce("subroot", "sub2").alias("subroot")))
        after = scratch.keep(now.where(F.col("pt").isNull()).union(moved))
        scratch.drop(now)
        now, far = after, 2 * far
    return now.select("t", "level", "i", "seg", "subroot")


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` gives with the siblings of ``path``, an array of ``(pos, hex digests before and after it)``."""
    def step(h, s):
        return F.sha2(F.concat(F.substring(s["hs"], F.lit(1), s["pos"] * 64), h, F.substring(s["hs"], s["pos"] * 64 + 1, F.lit(64 * FAN))), 256)
    return F.aggregate(path, leaf, step)


def manifest(docs: DataFrame, tamper: Column | None = None) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    Where ``tamper`` holds, the leaf that is folded is that of the row with its text's A-Z lower-cased.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "merkle")
    touched = F.coalesce(tamper, F.lit(False)) if tamper is not None else F.lit(False)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), group_name(F.col("source")).alias("t"), F.unhex(leaf_hash()).alias("h"),
                       F.when(touched, F.unhex(leaf_hash(text=F.translate("text", _UPPER, _LOWER)))).alias("h2"))
    leaves = placed(rows, "t", ["doc_id", "h"], scratch)

    # runs of leaves keep their rows; everything above is a sixteenth of them
    item = F.struct("i", F.lower(F.hex("h")).alias("h"), "doc_id", F.lower(F.hex("h2")).alias("h2"))
    first = scratch.keep(leaves.groupBy("t", F.floor(F.col("i") / FAN).cast("long").alias("p"))
                               .agg(F.array_sort(F.collect_list(item)).alias("rows"), F.max("size").alias("size")))
    if first.isEmpty():
        return spark.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    hashes = F.transform("rows", lambda r: r["h"])
    alone = F.col("size") == 1          # a group of one row: the leaf is the subroot, its run is no level
    start = scratch.keep(first.select("t", F.col("p").alias("i"), F.when(alone, hashes[0]).otherwise(sha(F.array_join(hashes, ""))).alias("h"),
                                      F.ceil(F.col("size") / FAN).alias("size")))
    runs, tops = grow(start, scratch)

    # the tree over the groups, whose level 0 are the subroots
    subs = scratch.keep(placed(tops.select(F.lit(TOP).alias("o"), "t", "level", "h"), "o", ["t"], scratch).drop("o"))
    over, top = grow(subs.select(F.lit(TOP).alias("t"), "i", "h", "size"), scratch)
    root = top.first().h

    # pointers: to the parent; from a subroot to itself as a node of the tree over the groups; from the root to nothing
    empty, none = F.array().cast("array<struct<pos:int,hs:binary>>"), F.lit(None)
    link = subs.select("t", "level", F.lit(0).cast("long").alias("i"), F.lit(TOP).alias("pt"), F.lit(0).alias("plevel"), F.col("i").alias("pi"),
                       empty.alias("seg"), F.col("h").alias("subroot"))
    tip = top.select("t", "level", F.lit(0).cast("long").alias("i"), none.cast("string").alias("pt"), none.cast("int").alias("plevel"),
                     none.cast("long").alias("pi"), empty.alias("seg"), none.cast("string").alias("subroot"))
    nodes = [siblings(r, k) for k, r in enumerate(runs)] + [siblings(r, k) for k, r in enumerate(over)]
    paths = jump(scratch.keep(reduce(DataFrame.union, [*nodes, link, tip])), scratch)

    # the last jump: the rows of a run take the finished segment of its node
    up = paths.where((F.col("level") == 0) & (F.col("t") != TOP)).select("t", F.col("i").alias("p"), "seg", "subroot")
    seg = F.transform("seg", lambda s: F.struct(s["pos"].alias("pos"), F.lower(F.hex(s["hs"])).alias("hs"))).cast("array<struct<pos:int,hs:string>>")
    each = (first.join(up, ["t", "p"]).select(seg.alias("seg"), "subroot", "size", hashes.alias("members"), F.posexplode("rows").alias("pos", "r")))
    own = F.array_join(F.concat(F.slice("members", F.lit(1), F.col("pos")), F.slice("members", F.col("pos") + 2, F.lit(FAN))), "")
    path = F.when(alone, F.col("seg")).otherwise(F.concat(F.array(F.struct("pos", own.alias("hs"))), "seg"))
    each = each.select("r", "subroot", path.alias("path"))
    out = each.select("r.doc_id", F.col("r.h").alias("leaf"), "subroot", F.lit(root).alias("root"),
                      F.sha2(F.array_join(F.transform("path", lambda s: s["hs"]), ""), 256).alias("proof_sha256"),
                      fold(F.coalesce("r.h2", "r.h"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
