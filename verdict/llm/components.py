"""Connected components of an edge list that stays distributed: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdict.llm.common import checkpointed


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links every neighbour of a node to the least one. The large step looks at all neighbours of a node and moves the
    larger ones; the small step looks at those that are smaller. Minima are combined before the shuffle."""
    pair = lambda u, v: F.struct(u.alias("u"), v.alias("v"))
    u, v, m = F.col("u"), F.col("v"), F.col("m")
    both = edges.select(F.explode(F.array(pair(u, v), pair(v, u))).alias("e")).select("e.*") if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.join(least, "u")
    moved = moved.where(v > u).select(v.alias("u"), m.alias("v")) if large else moved.select(F.explode(F.array(pair(v, m), pair(u, m))).alias("e")).select("e.*")
    return moved.where("u <> v").distinct()


def _stars(edges: DataFrame) -> bool:
    """True if every edge leads to the least node of its component: no node starts two edges, or starts one and ends one."""
    at = lambda name, starts, ends: F.struct(F.col(name).alias("node"), F.lit(starts).alias("starts"), F.lit(ends).alias("ends"))
    nodes = edges.select(F.explode(F.array(at("u", 1, 0), at("v", 0, 1))).alias("e")).groupBy("e.node").agg(F.sum("e.starts").alias("starts"), F.max("e.ends").alias("ends"))
    return nodes.where((F.col("starts") > 1) | (F.col("starts") == 1) & (F.col("ends") == 1)).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); the root is the least node of its component.

    The number of rounds grows with the logarithm of the longest path. Every round is checkpointed, so a lost executor
    costs one round at most.
    """
    edges = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _stars(edges):
        edges = checkpointed(_star(_star(edges, True), False))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def contracted(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``edges`` between the roots of their ends, where those differ. Nodes that ``roots`` lacks are their own root."""
    for end in ("u", "v"):
        named = roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
        edges = edges.join(named, end, "left").withColumn(end, F.coalesce(f"{end}_root", end)).drop(f"{end}_root")
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def refined(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``roots`` after ``edges`` have joined some of their components: the new edges alone, between roots, are worked on."""
    above = components(contracted(edges, roots)).select(F.col("node").alias("root"), F.col("root").alias("top"))
    moved = roots.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    fresh = above.join(roots.select(F.col("node").alias("root")), "root", "left_anti")
    return moved.unionByName(fresh.select(F.col("root").alias("node"), F.col("top").alias("root")))
