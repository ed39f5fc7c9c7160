"""Connected components of a table of links, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.sources.workspace import fresh_path


def _written(df: DataFrame, purpose: str) -> DataFrame:
    """The table from the shared folder: later plans start there, and lost executors do no harm."""
    path = fresh_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to its smallest neighbour, or itself if that is smaller."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("own"), F.least("a", "m").alias("m")
    )
    larger = both.where("b > a").join(least, F.col("a") == F.col("own"))
    return larger.select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours and itself go to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("own"), "m")
    moved = edges.join(least, F.col("a") == F.col("own"))
    return moved.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
        least.select(F.col("own").alias("a"), F.col("m").alias("b"))
    )


def components(links: DataFrame) -> DataFrame:
    """`node`, `label` (the smallest node reachable) for each node of the links `a`, `b`.

    Large-star and small-star in turn, as published by Kiveris et al. (2014), until no edge changes:
    every node then points to its label. The rounds grow with the logarithm of the nodes.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = _written(edges.where("a <> b").distinct(), "links")
    while True:
        made = _written(_small_star(_large_star(edges).distinct()).distinct(), "links")
        changed = made.exceptAll(edges).limit(1).count() + edges.exceptAll(made).limit(1).count()
        edges = made
        if not changed:
            break
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return nodes.union(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
