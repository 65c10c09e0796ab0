"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from memlake.llm.base import stored


def _least(edges: DataFrame) -> DataFrame:
    """(u, v, m): every directed edge with the least of u and its neighbours that the rows name."""
    return edges.join(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    hung = _least(down)
    return (hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(hung.select("u", F.col("m").alias("v")))
            .filter("u <> v").distinct())


def _state(edges: DataFrame) -> tuple:
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v), root being the least node of its component.

    Each round hangs neighbours under the least one (two keyed shuffles each
    way); the number of rounds grows with the logarithm of a component's size.
    The rounds end when the edges no longer change, and each is a stored table.
    """
    now = stored(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    was, state = None, _state(now)
    while state != was:
        now = stored(_small_star(_large_star(now)), "edges")
        was, state = state, _state(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
