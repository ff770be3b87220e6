"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topictide.llm.store import saved


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node and component (its smallest node) for every node that has an edge.

    Each round points all larger neighbours of a node, and then all smaller ones, to their
    smallest; edges end up as stars. A node with very many edges is aggregated before it is
    shuffled, and its rows are split by skew joins. Nothing is gathered on the driver but a
    count and a checksum, which tell when a round has changed nothing.
    """
    ends = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    now, state = edges.where(F.col(a) != F.col(b)).select(*ends).distinct(), None
    while True:
        now = saved(now)
        new = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if new == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        state = new
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u")
        pairs = small.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = pairs.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()
