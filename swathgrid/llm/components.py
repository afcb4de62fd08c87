"""Connected components of an edge list, by alternating star contractions on DataFrames.

Each round is two joins and two aggregations over the edges that are left. Hubs are met by partial
aggregation (the least neighbour) and by joins whose skewed partitions Spark can split; no
neighbour list is ever gathered into one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Tie every larger neighbour of a node to the least node of its neighbourhood."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    return (
        both.where("b > a").join(least, F.col("a") == F.col("k"))
        .where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Tie a node and its smaller neighbours to the least of them (edges point from a down to b)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    met = edges.join(least.withColumnRenamed("a", "k"), F.col("a") == F.col("k")).where("b != m")
    return least.select("a", F.col("m").alias("b")).union(met.select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a long, b long; any order, repeats and loops allowed) -> (node, component).

    component is the smallest node reachable. Nodes without an edge to another node don't appear;
    null ends are dropped. An empty edge list gives an empty result. Written to the shared folder
    after every round, so that a lost executor costs at most one round.
    """
    now = cut(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a is not null and b is not null and a != b").distinct()
    )
    seen = None
    for _ in range(max_rounds):
        now = cut(_small_star(_large_star(now)))
        # a forest of stars stays as it is: count and order-free hash are the same in two rounds
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("component"))
            ).distinct()
        seen = state
    raise RuntimeError(f"the components haven't settled in {max_rounds} rounds")
