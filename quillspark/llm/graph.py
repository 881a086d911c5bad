"""Connected components of an edge table by alternating large and small stars, on the executors alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

#: Edges in a task.
TASK_EDGES = 100_000


def _with_least(pairs: DataFrame, parts: int) -> DataFrame:
    """(u, v, m): m is the least of u and its neighbours.

    The nodes of more than TASK_EDGES edges, at most one for so many rows of ``pairs``, are broadcast; the rest meet by shuffle.
    """
    least = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n"))
    hubs = least.where(F.col("n") > TASK_EDGES).select("u", F.col("m").alias("hub"))
    told = pairs.join(F.broadcast(hubs), "u", "left")
    rest = told.where("hub is null").select("u", "v").join(least.where(F.col("n") <= TASK_EDGES).select("u", "m"), "u")
    return told.where("hub is not null").select("u", "v", F.col("hub").alias("m")).unionByName(rest).coalesce(parts)


def _large_star(edges: DataFrame, parts: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, parts).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, parts: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    found = _with_least(down, parts)
    moved = found.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(found.select("u", F.col("m").alias("v"))).distinct().coalesce(parts)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): component is the least node that can be reached. Takes (a, b) rows; nodes without edges are left out."""
    now = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "components")
    parts = max(4, -(-now.count() // TASK_EDGES))
    mark = None
    while True:  # each round either joins nodes to lesser ones or changes nothing
        before, large = now, materialise(_large_star(now, parts), "components")
        now = materialise(_small_star(large, parts), "components")
        discard(before, large)
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == mark:
            break
        mark = seen
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct().coalesce(parts)


def join_groups(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """``groups`` (node, component) after more edges: only the groups that the edges join are worked on."""
    a = edges.join(groups.withColumnRenamed("component", "ca"), edges["a"] == groups["node"], "left").select("a", "b", F.coalesce("ca", "a").alias("ca"))
    b = a.join(groups.withColumnRenamed("component", "cb").withColumnRenamed("node", "nb"), F.col("b") == F.col("nb"), "left").select("a", "b", "ca", F.coalesce("cb", "b").alias("cb"))
    moved = components(b.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("to"))
    known = groups.unionByName(b.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("ca").alias("component")), F.struct(F.col("b").alias("node"), F.col("cb").alias("component")))).alias("x")).select("x.*")).distinct()
    return known.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
