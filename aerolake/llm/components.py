"""Connected components of a table of links, by alternating star contractions on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolake.llm.common import materialise


def _large_star(links: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour, itself included."""
    both = links.union(links.select("b", "a").toDF("a", "b"))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")).withColumnRenamed("a", "_a")
    return both.filter("b > a").join(least, F.col("a") == F.col("_a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "_a")
    moved = down.join(least, F.col("a") == F.col("_a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.toDF("a", "b")).filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b): root is the smallest node of its component, which has no row of its own.

    Each round is two joins and two aggregates and halves the depth at least; rounds end when nothing moves. Links are
    written to the shared folder between rounds. Empty links give no rows.
    """
    links = materialise(links.select("a", "b").filter("a <> b").distinct(), "links")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = None
    while (now := mark(links)) != seen and now[0]:
        seen = now
        links = materialise(_small_star(_large_star(links)), "links")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
