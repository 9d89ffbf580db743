"""Connected components by alternating large-star and small-star steps.

Every step is a group-by and a join on the node; neighbours of a node are never gathered in one place.
Each round is written to the shared checkpoint folder, so a lost executor replays one round at most."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from querygauge.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, label) for each node of ``links`` (a, b) that is not the smallest of its component.

    ``label`` is the smallest node reachable; nodes without a row are their own label. Self-links, repeated
    links and links with a null end change nothing."""
    edges = cut_lineage(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _settled(edges):
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        lower = large.join(small, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(lower.union(small.select("u", F.col("m").alias("v"))).distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))


def _settled(edges: DataFrame) -> bool:
    """Is every edge one of a star: does each upper end have one edge, and is no lower end an upper one?"""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    nodes = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.count("*").alias("n"))
    return nodes.filter("ups > 1 or (ups = 1 and n > 1)").isEmpty()
