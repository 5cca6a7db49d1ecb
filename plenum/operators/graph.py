"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.session import cut_lineage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The smallest node of every component as (node, component), for all nodes with an edge.

    Each round points every node at the smallest neighbour it knows (large star, then small
    star). Only minima are aggregated, never neighbour lists, so a hub is a partial ``min``
    and a join that adaptive execution may split. Rounds go on until nothing changes; their
    number grows with the logarithm of the size. Each round is written to the checkpoint
    folder.
    """
    current = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    nodes = edges.select(F.col(a).alias("node")).union(edges.select(F.col(b))).distinct()
    current = cut_lineage(current)
    state = _fingerprint(current)
    while True:
        current = cut_lineage(_small_star(_large_star(current)))
        after = _fingerprint(current)
        if after == state:
            break
        state = after
    labels = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _fingerprint(edges: DataFrame) -> tuple:
    hashed = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), hashed).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node move to its smallest neighbour (or itself)."""
    both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
    smallest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    larger = both.where("v > u").join(smallest, "u")
    return larger.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of a node, and the node, move to the smallest of them."""
    smallest = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = smallest.select("u", F.col("m").alias("v"))
    return moved.union(own).where("u <> v").distinct()
