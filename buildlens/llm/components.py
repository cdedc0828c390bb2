"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.llm.common import Staged


def _is_star_forest(edges: DataFrame) -> bool:
    """Every node has one smaller neighbour at most, and no node that has one is another's."""
    twice = edges.groupBy("u").count().where("count > 1").limit(1)
    between = edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi").limit(1)
    return not twice.select("u").unionByName(between).head(1)


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node in an edge of `edges` (a, b); component is the smallest id reachable.

    Each step is two joins and two minimum aggregates, staged in the shared folder; the number of steps grows with the
    logarithm of the longest path. Loops and nulls are ignored, repeated edges count once.
    """
    held = Staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _is_star_forest(held.df):
        e = held.df
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        large = Staged(large, "large-star")
        low = large.df.groupBy("u").agg(F.min("v").alias("m"))
        small = large.df.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = Staged(small.select("e.u", "e.v").where("u <> v").distinct(), "small-star")
        held.drop()
        large.drop()
        held = after
    nodes = held.df.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return nodes.unionByName(held.df.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
