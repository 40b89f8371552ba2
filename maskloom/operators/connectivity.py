"""Connected components of labels: inside one batch, and of pairs spread over the cluster."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from maskloom.session import cut_lineage

#: A label is the component's first pixel in row order, as ``y * ROW + x``.
ROW = 1 << 32

# Fixed value: components below this area are specks.
MIN_COMPONENT_AREA = 50


def united(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first member of each of ``n`` places' component, given pairs ``(a, b)`` that are connected."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        nxt = root.copy()
        np.minimum.at(nxt, root[a], low)
        np.minimum.at(nxt, root[b], low)
        nxt = nxt[nxt]
        if np.array_equal(nxt, root):
            return root
        root = nxt


def contracted(pairs: DataFrame) -> DataFrame:
    """Root per label, ``(mask_id, label, root)``, by alternating large-star and small-star steps.

    Every step is a grouped minimum joined back, so a component spanning very many tiles is not
    collected; the number of rounds grows with the logarithm of its size.
    """
    edges, mark = cut_lineage(pairs), None
    while True:
        both = edges.unionByName(edges.select("mask_id", F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("mask_id", "u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, ["mask_id", "u"]).filter("v > u").select(
            "mask_id", F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("mask_id", "u").agg(F.min("v").alias("m"))
        moved = large.join(least, ["mask_id", "u"]).filter("v <> m").select(
            "mask_id", F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(moved.unionByName(least.select("mask_id", "u", F.col("m").alias("v"))).distinct())
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("mask_id", "u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == mark:
            return edges.select("mask_id", F.col("u").alias("label"), F.col("v").alias("root"))
        mark = tuple(row)
