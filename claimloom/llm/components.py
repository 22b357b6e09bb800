"""Connected components of a graph of 64-bit ids, as alternating star operations on DataFrames.

Each round joins every node's edges with the least id around it (large star), then the same for
smaller neighbours (small star), until the edges are stars around the least id of each
component. Only minima are aggregated, and they are written before they are joined to the edges,
so that Spark can split the edges of a node of any degree over tasks. Each round is written to
the shared folder, so lineage stays short. Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import materialize


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "large-star")
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Edges have a > b."""
    least = materialize(edges.groupBy("a").agg(F.min("b").alias("m")), "small-star")
    return edges.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a != b").distinct()


def _all_stars(edges: DataFrame) -> bool:
    """Whether every id has one edge to a smaller id, which has none itself."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e")).select("e.*")
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def components(edges: DataFrame, label: str = "component") -> DataFrame:
    """edges: (a, b), any order. Returns (id, component) for every id that has an edge to another id; component is the least id."""
    now = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), label)
    while True:
        now = materialize(_small(materialize(_large(now), "large-edges")), label)
        if _all_stars(now):
            return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
