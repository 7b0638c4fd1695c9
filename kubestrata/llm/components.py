"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kubestrata.llm.store import staged


def _stars(edges: DataFrame, both: bool) -> DataFrame:
    """One contraction. ``both``: each node's larger neighbours go to its smallest neighbour; else its smaller ones do."""
    if both:
        pairs = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = staged(pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    joined = pairs.join(least, "a")  # both sides come from their own exchange, so a hub can be split
    if both:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return staged(out.where("a <> b").distinct(), "stars")


def _unfinished(edges: DataFrame) -> DataFrame:
    """Nodes that keep (a, b), a > b, distinct, from being stars: with two edges down, or with one down and one up."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    met = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return met.where("down > 1 or (down = 1 and up = 1)")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node on an edge (a long, b long); the label is the smallest node of its component.

    Each round halves distances at least; it ends when the edges are stars around the smallest nodes. Only whether a
    node is left that is no part of a star comes to the driver.
    """
    edges = staged(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct(), "edges")
    while True:
        edges = _stars(_stars(edges, both=True), both=False)
        if _unfinished(edges).isEmpty():
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
