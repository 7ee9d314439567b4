"""Connected components of a table of links, without gathering any neighbourhood."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmill.sources.scratch import keep


def _least(edges: DataFrame) -> DataFrame:
    """The smallest neighbour of each node, or the node itself; a hub is a partial minimum in every task."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every greater neighbour is linked with the smallest neighbour instead."""
    near = _both(edges)
    return near.join(_least(near), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour, and the node, is linked with the smallest neighbour."""
    near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = near.join(_least(near), "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node in ``links``; the component is its smallest node.

    Large and small stars take turns until nothing changes. Repeated links and links of a node with itself do
    no harm; rows with a null are left out.
    """
    ends = links.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    edges = keep(ends.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    nodes = _both(edges).select("u").distinct()
    edges, mark = edges.where("u <> v"), None
    while True:
        starred = _small_star(_large_star(edges)).where("u <> v").distinct()
        edges = keep(starred, "edges")
        found = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(found) == mark:
            break
        mark = tuple(found)
    joined = nodes.join(edges, "u", "left")
    return joined.groupBy(F.col("u").alias("node")).agg(F.coalesce(F.min("v"), F.first("u")).alias("component"))
