"""Connected components by alternating large-star and small-star rounds.

Every round is joins and minimum aggregates over the edges, so no neighbour list is ever
gathered, however large a component is. Rounds go on until the edge set stays the same (its
count and hash sum), when every vertex points at its component's smallest vertex.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from costsieve.llm.common import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
    return (both.where("v > u").join(least, F.col("u") == F.col("c"))
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` run from the larger vertex u to the smaller one v."""
    least = edges.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
    rest = edges.join(least, F.col("u") == F.col("c")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(least.select("c", "m")).distinct()


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a table, and their count and hash sum, observed while it is written."""
    seen = Observation()
    table = materialise(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "edges")
    return table, (seen.get["n"], seen.get["h"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(vertex, root) for every vertex of the edges (u, v); the root is the component's least."""
    now, state = _written(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while state[0]:
        now, after = _written(_small_star(_large_star(now)))
        if after == state:
            break
        state = after
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct())
