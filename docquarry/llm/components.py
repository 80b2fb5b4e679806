"""Connected components of a large graph by star contraction, in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.session import broadcast_if_small, materialise

MAX_ROUNDS = 60


def _with_least(arcs: DataFrame) -> DataFrame:
    """Arcs (u, v) with ``least``: the smallest node among u and its neighbours."""
    least = arcs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("least"))
    return arcs.join(broadcast_if_small(least), "u")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to its smallest one."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return _with_least(both).filter("v > u").select(F.col("least").alias("a"), F.col("v").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them."""
    down = _with_least(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    linked = down.select(F.col("least").alias("a"), F.col("v").alias("b")).union(down.select(F.col("least").alias("a"), F.col("u").alias("b")))
    return linked.filter("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (smallest node reachable) for all nodes of the edges (``a``, ``b``).

    Large and small stars alternate until nothing changes; a path is shortened to stars in a number of
    rounds that grows with the logarithm of its length. Only minima are gathered per node, so a node with
    very many neighbours is combined before the shuffle. Self loops say nothing; an empty graph is fine.
    """
    tidy = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    stars, mark = materialise(tidy, "edges"), None
    for _ in range(MAX_ROUNDS):
        seen = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark or seen[0] == 0:
            break
        mark = tuple(seen)
        stars = materialise(_small_star(_large_star(stars)), "stars")
    else:
        raise RuntimeError("components did not settle")
    return stars.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
        stars.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )
