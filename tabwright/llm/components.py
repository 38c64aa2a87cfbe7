"""Connected components of an edge table, by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.session import Scratch


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _large(edges: DataFrame) -> DataFrame:
    ways = _both_ways(edges)
    low = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return ways.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    ways = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = ways.groupBy("u").agg(F.min("v").alias("m"))
    moved = ways.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node of an edge: root is the smallest node that can be reached.

    edges has columns a and b of one orderable type. Every round is written to the shared folder, so its
    lineage is one scan; rounds grow with the logarithm of the longest path. No edges give no rows.
    """

    def state(table: DataFrame) -> tuple:
        row = table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        return tuple(row)

    current = scratch.table(edges.select("a", "b").where("a <> b").distinct())
    before = state(current)
    while True:
        after_large = scratch.table(_large(current))
        scratch.drop(current)
        current = scratch.table(_small(after_large))
        scratch.drop(after_large)
        now = state(current)
        if now == before:
            break
        before = now
    nodes = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
