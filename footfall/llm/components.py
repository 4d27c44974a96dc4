"""Connected components by star contraction, as joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _smallest(edges: DataFrame) -> DataFrame:
    """Smallest neighbour of each ``u``, or ``u`` itself where it is smaller."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: each ``u`` has one edge, and no ``u`` is the ``v`` of another."""
    ends = edges.select(F.col("u").alias("k"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("k").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0)).isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Nodes of the links as ``id`` with the smallest id that they reach as ``component_id``.

    Large-star and small-star steps take turns until all nodes of a component hang on its smallest. A step sends a row for
    each link; the smallest neighbour is a partial aggregate, and the join that brings it back can split a hub's links.
    Nodes without links are not in the result; links with null are ignored.
    """
    edges = cut(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())
    while not _settled(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        small = _smallest(both)
        # each u then points to smaller nodes only
        large = both.where("v > u").join(small, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        stars = large.join(least, F.col("u") == F.col("k"))
        edges = cut(
            stars.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(stars.where("v = m").select("u", F.col("m").alias("v"))).distinct())
    roots = edges.select(F.col("v").alias("id")).distinct().withColumn("component_id", F.col("id"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(roots)
