"""Connected components of a graph of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written


def components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (node, component): the smallest node that each node of a link reaches.

    Links move to smaller and smaller nodes until each node has one, to the root of its star. Every step is a minimum by node
    and a join, and its result is written, so lineage stays short and a lost executor costs a step at most.
    """
    edges = Written(_directed(links.select("a", "b")), "components")
    before = None
    while True:
        state = edges.df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            return edges.df.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = state
        large = Written(_directed(_large_star(edges.df)), "components")
        edges.drop()
        edges = Written(_directed(_small_star(large.df)), "components")
        large.drop()


def united(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The components of earlier links, given as labels, and of more links (a, b): only classes that these join are looked at again."""
    if links.isEmpty():
        return labels
    a = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    b = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    raised = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = components(raised).select(F.col("node").alias("_class"), F.col("component").alias("_root"))
    nodes = labels.unionByName(joined.select(F.col("_class").alias("node"), F.col("_class").alias("component"))).dropDuplicates(["node"])
    merged = nodes.join(joined, F.col("component") == F.col("_class"), "left").select("node", F.coalesce("_root", "component").alias("component"))
    return Written(merged.where("node != component"), "components").df


def _directed(pairs: DataFrame) -> DataFrame:
    a, b = pairs.columns
    return pairs.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to its least neighbour, or to itself if none is less."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select("v", "m")


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the least of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
