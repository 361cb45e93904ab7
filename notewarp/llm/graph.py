"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """(node, label) for every node of ``edges`` (columns u, v: long), label being the smallest node of its component.

    Each step is one aggregation and one join on node ids and is written to the shared folder; the edge table never
    grows, and the number of steps is logarithmic in the diameter. A node with very many edges is aggregated on the map
    side and split by the adaptive skew join.
    """
    stars = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    stars = scratch.table(stars, f"{name}0")
    step, state = 0, None
    while True:
        now = stars.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first()
        # a pass that leaves the edges as they are has found stars around each smallest node
        if now == state or not now[0]:
            break
        state = now
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        stars = both.where("v > u").join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = stars.groupBy("u").agg(F.min("v").alias("m"))
        small = stars.join(low, "u")
        small = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = scratch.table(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), f"{name}{step + 1}")
        scratch.free(f"{name}{step}")
        step += 1
    ends = stars.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(ends)
