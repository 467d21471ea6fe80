"""Connected components of a distributed edge list, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_unique, stash

#: Edges that one task can hold.
FEW_EDGES = 1_000_000


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) with any comparable type to (node, component): the smallest node that is reachable.

    Only nodes with an edge to another node appear. Each round moves every neighbour above a node
    to the smallest neighbour (large star), then those below it (small star); rounds grow with the
    logarithm of the nodes. Edges stay in tables of the shared folder, none goes to the driver; those of
    hubs are not exchanged by their node.
    """
    now = stash(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = join_unique(both, low, ["u"], FEW_EDGES).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stash(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            join_unique(large, low, ["u"], FEW_EDGES)
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u != v")
            .distinct()
        )
        now = stash(small, "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
