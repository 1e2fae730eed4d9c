"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anamnesis.session import materialize


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (a, b) with b < a."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    # every node hangs its larger neighbours on its least one
    large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
    large = materialize(large, "large-star")
    # every node hangs its smaller neighbours and itself on its least one
    lowest = large.groupBy("a").agg(F.min("b").alias("low"))
    moved = large.join(lowest, "a").filter("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return materialize(moved.unionByName(lowest.select("a", F.col("low").alias("b"))).distinct(), "small-star")


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): root is the least node it is connected with.

    Rounds grow with the logarithm of the longest path; each round's edges are written to the shared folder.
    Only one count and one sum a round reach the driver.
    """
    edges = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = materialize(edges.distinct(), "edges")
    before = _fingerprint(edges)
    while before[0]:
        edges = _stars(edges)
        after = _fingerprint(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
