"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is a minimum per node (combined map-side) and a join in which a node with
many links is broadcast instead of sent to one task; nothing is collected, and each
step's result is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.llm.common import finished, join_groups, stored


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _with_least(links: DataFrame, also: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) with m, the least b of their a (or a itself), and the table of m."""
    least = F.min("b") if also is None else F.least(F.min("b"), F.first(also))
    low = stored(links.groupBy("a").agg(least.alias("m"), F.count(F.lit(1)).alias("k")), "star-least")
    total = low.agg(F.sum("k")).first()[0] or 0
    return join_groups(links, low, ["a"], "k", total), low


def _large_star(edges: DataFrame) -> DataFrame:
    met, _ = _with_least(_both(edges), "a")
    return met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    met, low = _with_least(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    moved = met.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour or larger ones only: then it has its root."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up")))
    met = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.count(F.lit(1)).alias("n"))
    return met.filter("ups > 1 OR (ups = 1 AND n > 1)").isEmpty()


@finished("components")
def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link; the root is the smallest node reached.

    ``edges`` has long columns ``a`` and ``b``, not null; loops and repeats are ignored.
    """
    edges = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _all_stars(edges):
        edges = stored(_small_star(stored(_large_star(edges), "large-star")), "small-star")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
