"""Connected components without a hot label.

Alternating star steps: in the large-star step every vertex hands its larger neighbours to the smallest vertex it
knows, in the small-star step every vertex ties its smaller neighbours to the smallest of them.  Both keep
components as they are; the edge table ends as one star around the smallest vertex of each.  What a step
needs of a vertex is one minimum, aggregated map-side, so a component of a third of all rows sends one partial row
per task; the join that follows spreads a big star's edges by AQE's skew handling.  Rounds go on until
the table no longer changes: no limit, two numbers a round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortlens.session import Scratch


def _state(edges: DataFrame):
    """Size and an order-free checksum of the edge table."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())


def star_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, label`` of every node with an edge of ``edges(u, v)`` to another; the label is the component's smallest node.

    The result lies in ``scratch``.
    """
    stars = scratch.keep(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before, state = None, _state(stars)
    while state != before:
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        after = scratch.keep(small.where("u <> v").distinct())
        scratch.drop(stars)
        stars, before, state = after, state, _state(after)
    return (stars.select(F.col("u").alias("node"), F.col("v").alias("label"))
                 .union(stars.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()))
