"""Connected components of a link table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import materialize


def connected_components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, component): each linked node and the smallest node that it reaches.

    Alternates large-star and small-star rounds on (a, b) rows until every node hangs on its component's smallest.
    A round is grouped minima and joins against one row per node, so a hub with very many links is
    pre-aggregated and its rows are split by the join. Each round is stored, so a lost executor costs one round."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    edges = materialize(edges, label)
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = materialize(small.select("e.u", "e.v").where("u > v").distinct(), label)
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum("v"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
        seen = state
