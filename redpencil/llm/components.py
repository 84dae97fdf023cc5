"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round replaces the edges by edges to smaller neighbours and never makes more of them. Groups are reduced
by partial aggregates, and joins back to a large group rely on Spark's split of skewed joins, so that a
component may hold any share of all vertices; the reduced tables are stored first, as only joins of plain
shuffles are split. Rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redpencil.llm.storage import discard, store, store_at


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a vertex to the smallest vertex around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = store(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "smallest")
    return both.join(smallest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a vertex and its smaller neighbours to the smallest of them. Edges run from larger to smaller."""
    smallest = store(edges.groupBy("u").agg(F.min("v").alias("m")), "smallest")
    moved = edges.join(smallest, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (u, root) for every vertex of ``edges`` (u, v) that is not the smallest of its component."""
    spark = edges.sparkSession
    current = (
        edges.filter("u != v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    current, path = store_at(current, "edges")
    while not _settled(current):
        following, next_path = store_at(_small_star(_large_star(current)), "edges")
        discard(spark, path)
        current, path = following, next_path
    return current.select("u", F.col("v").alias("root"))


def _settled(edges: DataFrame) -> bool:
    """Every vertex has one edge, to a vertex that has none."""
    rows, sources = edges.agg(F.count(F.lit(1)), F.count_distinct("u")).first()
    if rows != sources:
        return False
    return edges.select("v").join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()
