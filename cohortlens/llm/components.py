"""Connected components by alternating large-star and small-star steps.

Every step is one minimum per vertex (aggregated map-side, so a vertex with very
many links costs one partial row per task) and one join; the edge table ends as a
star around the smallest vertex of each component.  Edges stay distributed; of a
round the driver learns only whether the table is such stars, so stars cost no round.
Both steps are written, so the driver plans each part of a round once, not as
often as it is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortlens.session import Scratch


def _stars(e: DataFrame) -> bool:
    """Whether every vertex of ``e(u, v)`` is the centre of its links or has one link, to a centre."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("out")).union(e.select(F.col("v").alias("x"), F.lit(0).alias("out")))
    n = ends.groupBy("x").agg(F.sum("out").alias("out"), F.count(F.lit(1)).alias("all"))
    return n.where((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("out") < F.col("all")))).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``(v, comp)`` for every vertex of ``edges(u, v)``; ``comp`` is its component's smallest vertex."""
    scratch = Scratch(edges.sparkSession, "components")
    e = scratch.keep(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                          .where(F.col("u") != F.col("v")).distinct())
    while not _stars(e):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = scratch.keep(both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        scratch.drop(e)
        low = scratch.keep(large.groupBy("u").agg(F.min("v").alias("v")))
        e = scratch.keep(large.join(low.withColumnRenamed("v", "m"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                              .where(F.col("u") != F.col("v")).union(low).distinct())
        scratch.drop(large, low)
    return e.select(F.col("u").alias("v"), F.col("v").alias("comp")).union(
        e.select("v", F.col("v").alias("comp")).distinct())
