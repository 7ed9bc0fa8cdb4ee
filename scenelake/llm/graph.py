"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, delete


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one other, and that one on none."""
    child = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    parent = edges.select(F.col("v").alias("u"), F.lit(True).alias("above")).distinct()
    return child.join(parent, "u", "left").where("n > 1 or above").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``links`` has long columns a and b; the result (node, root) names for every node in a link the smallest it can reach.

    Each step hangs larger neighbours on the smallest one (large star), then smaller ones too (small star); the number
    of steps grows with the logarithm of the longest chain. Minima are partial aggregates, so a node with very many
    links is no hot task; each step is written to the shared folder, so a lost executor costs one step.
    Self-links and repeated links do no harm; an empty table gives an empty result.
    """
    edges = cut(links.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).where("u <> v").distinct())
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = cut(low.select("u", F.col("m").alias("v")).unionByName(small).where("u <> v").distinct())
        delete(edges)
        edges = new
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
