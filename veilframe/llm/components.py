"""Connected components by alternating star contraction, all on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import written


def _contract(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step on edges (high, low), high > low."""
    both = edges.select(F.col("high").alias("u"), F.col("low").alias("v")).unionByName(edges.select(F.col("low").alias("u"), F.col("high").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.filter("v > u").join(least, "u").select(F.col("v").alias("high"), F.col("m").alias("low")).distinct()
    lowest = large.groupBy("high").agg(F.min("low").alias("m"))
    joined = large.join(lowest, "high")
    small = joined.filter("low > m").select(F.col("low").alias("high"), F.col("m").alias("low")).unionByName(lowest.select("high", F.col("m").alias("low")))
    return small.distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its least node) of every node that an edge joins to another.

    Works for any ordered type. Loops and repeated edges count for nothing, edges with a null end
    neither; without edges there are no rows. Each round is written to the shared folder, which cuts lineage; their number grows with
    the logarithm of the longest path.
    """
    edges = written(edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).distinct(), "components")
    state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
    while state[0]:
        edges = written(_contract(edges), "components")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(edges.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct())
