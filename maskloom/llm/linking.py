"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from maskloom.llm.records import stored


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node it can reach, for every node of ``links(a, b)``.

    Large star: each node hangs its larger neighbours on its smallest one. Small star: each node hangs its
    smaller neighbours, and itself, on its smallest one. Both keep what is connected, and repeated in turn
    they end when every component is a star around its smallest node, after about log steps.

    The smallest neighbour is a partial aggregate and the join that uses it has one row per node on that
    side, so a node with very many links can be split. Each step ends in a table in the shared folder.
    Links that are null, or from a node to itself, are ignored; no links give no rows.
    """
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = None
    while True:
        mark = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if not mark[0] or mark == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = mark
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))).distinct())
        edges = stored(small, "links")
