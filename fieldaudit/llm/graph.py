"""Connected components by alternating large and small stars, as joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldaudit.llm.common import keep


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node ties its larger neighbours to the least node around it."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node ties itself and its smaller neighbours to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _is_star(edges: DataFrame) -> bool:
    rows, nodes = edges.agg(F.count("*"), F.countDistinct("u")).first()
    return rows == nodes and edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): every node of a frame of edges (u, v) with the least node it is linked to; the least nodes are left out."""
    edges = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = keep(edges, "edges")
    while not _is_star(edges):
        edges = keep(_small_star(_large_star(edges)), "edges")
    return edges
