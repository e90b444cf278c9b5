"""Connected components of an edge table by alternating large and small stars, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.llm.common import cut


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step over edges (a > b): neighbours of each node are linked to its least neighbour."""
    if larger:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        pairs = around.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = around.groupBy("u").agg(F.min("v").alias("m"))
        pairs = around.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    return pairs.where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links (a, b long): the least node that it reaches.

    Null ends, self links and repeated links change nothing; without links the result is empty. Each round is cut
    into the checkpoint folder; rounds go on until the edges no longer change.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    sign = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1000003)).first()
    before, now = None, sign(edges)
    while now != before and now[0]:
        edges = cut(_stars(_stars(edges, True), False))
        before, now = now, sign(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
