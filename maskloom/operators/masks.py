"""Measures and selection of masks.

Pixel tables are sparse: rows ``(mask_id, w, h, x, y)`` for the set pixels only, the frame size
carried along. They are spread over pixels or lines of a mask, never gathered per mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from maskloom.functions import boxes as B, rasters as R
from maskloom.operators import raster_kernels

# An automatic segment must reach these to be kept.
MIN_SEGMENT_SCORE = 0.85
MIN_SEGMENT_STABILITY = 0.92
MIN_AREA_SHARE = 0.005
MAX_AREA_SHARE = 0.60

PIXEL = ["mask_id", "w", "h", "x", "y"]


def passes_quality(
    score: str, stability: str, area: str, image_area: Column,
    min_score: float = MIN_SEGMENT_SCORE, min_stability: float = MIN_SEGMENT_STABILITY,
    min_share: float = MIN_AREA_SHARE, max_share: float = MAX_AREA_SHARE,
) -> Column:
    """Good enough, stable enough, and neither tiny nor the whole image; limits included."""
    share = F.col(area) / image_area
    return (
        (F.col(score) >= min_score) & (F.col(stability) >= min_stability) & share.between(min_share, max_share)
    )


def raster_pixels(rasters: DataFrame) -> DataFrame:
    """All pixels of array rasters ``(mask_id, w, h, v)`` as rows with ``x``, ``y`` and value ``v``.

    The outer form of explode is used for computed arrays throughout: for the plain form the
    optimizer adds a test on the array's size and pushes it below, which evaluates the array again.
    """
    return rasters.select("mask_id", "w", "h", F.posexplode_outer("v").alias("i", "p")).filter("i IS NOT NULL").select(
        "mask_id", "w", "h", (F.col("i") % F.col("w")).cast("int").alias("x"),
        F.floor(F.col("i") / F.col("w")).cast("int").alias("y"), F.col("p").cast("double").alias("v"),
    )


def thresholded(rasters: DataFrame, limit: float) -> DataFrame:
    """Set pixels of array rasters; explode and filter run in one generated stage, before any shuffle."""
    return raster_pixels(rasters).filter(F.col("v") > F.lit(float(limit)))


def mask_boxes(masks: DataFrame, pixels: DataFrame) -> DataFrame:
    """Tight box and area per mask; an empty mask gets zeros."""
    found = pixels.groupBy("mask_id").agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"),
        F.count("*").alias("n"),
    )
    zero = F.lit(0)
    return masks.select("mask_id").join(found, "mask_id", "left").select(
        "mask_id", F.coalesce("x0", zero).alias("x"), F.coalesce("y0", zero).alias("y"),
        F.coalesce(F.col("x1") - F.col("x0") + 1, zero).alias("w"),
        F.coalesce(F.col("y1") - F.col("y0") + 1, zero).alias("h"), F.coalesce("n", zero).alias("area"),
    )


def raster_scores(rasters: DataFrame, offset: float = R.STABILITY_OFFSET) -> DataFrame:
    """Stability, flips, positives, coverage and compactness of array rasters; no shuffle."""
    return raster_kernels.raster_scores(rasters, offset)


def covers_points(candidates: DataFrame, points: DataFrame, side: int = B.SEGMENTER_SIDE) -> DataFrame:
    """Does a candidate raster ``(prompt_id, index, w, h, v)`` cover all positive points of its prompt?

    ``points(prompt_id, x, y, label)`` are in model space; label 1 is positive. Candidates meet the points as packed bits, and a
    point reads one byte of them. Only candidates with positive points are listed, the others cover trivially.
    """
    def cell(p, size):
        return F.greatest(F.lit(0), F.least(F.col(size) - 1, B.round_half_up(F.col(p) / side * F.col(size)))).cast("int")

    p = points.filter("label = 1").select("prompt_id", F.col("x").alias("px"), F.col("y").alias("py"))
    hit = R.bit_at(F.col("bits"), cell("py", "h") * F.col("w") + cell("px", "w"))
    return (
        raster_kernels.packed(candidates.select("prompt_id", "index", "w", "h", "v"), 0.0).join(p, "prompt_id")
        .select("prompt_id", "index", hit.alias("hit"))
        .groupBy("prompt_id", "index").agg(F.bool_and("hit").alias("covers"))
    )


def selected_candidates(
    candidates: DataFrame, points: DataFrame, offset: float = R.STABILITY_OFFSET,
    min_iou: float = R.MIN_IOU, min_stability: float = R.MIN_STABILITY, min_compactness: float = R.MIN_COMPACTNESS,
    side: int = B.SEGMENTER_SIDE,
) -> DataFrame:
    """One candidate per prompt.

    Those covering all positive points come first, then those that pass all three limits, then the
    highest quality, then the input order. Picked by a mergeable minimum, not by sorting groups.
    """
    scores = raster_scores(candidates, offset)
    scores = scores.withColumn(
        "quality", R.quality(F.col("iou"), F.col("stability"), F.col("compactness"), F.col("coverage")))
    judged = (
        scores.join(covers_points(candidates, points, side), ["prompt_id", "index"], "left")
        .withColumn("covers", F.coalesce("covers", F.lit(True)))
        .withColumn("passes", (F.col("iou") >= min_iou) & (F.col("stability") >= min_stability)
                    & (F.col("compactness") >= min_compactness))
    )
    rank = F.struct((~F.col("covers")).alias("a"), (~F.col("passes")).alias("b"),
                    (-F.col("quality")).alias("c"), F.col("index").alias("d"))
    best = F.min_by(F.struct("index", "iou", "stability", "compactness", "coverage", "quality", "covers", "passes"), rank)
    return judged.groupBy("prompt_id").agg(best.alias("b")).select("prompt_id", "b.*")


def reference_points(points: DataFrame) -> DataFrame:
    """Points a refined mask must contain: the positives, else the centre of a two-corner box.

    Labels 2 and 3 mark the top left and bottom right corner. Corners are aggregated, positives
    stay rows.
    """
    summary = points.groupBy("prompt_id").agg(
        F.bool_or(F.col("label") == 1).alias("has_positive"),
        F.count_if(F.col("label").isin(2, 3)).alias("n_corners"),
        *[F.min(F.when(F.col("label") == k, F.col(c))).alias(f"{c}{k}") for k in (2, 3) for c in ("x", "y")],
    )
    positives = points.filter("label = 1").select("prompt_id", "x", "y")
    centres = summary.filter("NOT has_positive AND n_corners = 2 AND x2 IS NOT NULL AND x3 IS NOT NULL").select(
        "prompt_id", ((F.col("x2") + F.col("x3")) / 2).alias("x"), ((F.col("y2") + F.col("y3")) / 2).alias("y"))
    return positives.unionByName(centres)


def edge_margin(w: Column, h: Column) -> Column:
    """Fixed rule: 2 % of the shorter side, at least 3 pixels."""
    return F.greatest(F.lit(3), B.round_half_up(F.least(w, h) * F.lit(0.02))).cast("int")


def edge_coverage(pixels: DataFrame, margin: Column | None = None) -> DataFrame:
    """Area share, box, and how full the strip along each side of the frame is."""
    m = edge_margin(F.col("w"), F.col("h")) if margin is None else margin
    top, left = F.least(m, F.col("h")), F.least(m, F.col("w"))
    bottom, right = F.greatest(F.lit(0), F.col("h") - m), F.greatest(F.lit(0), F.col("w") - m)
    counted = pixels.groupBy("mask_id", "w", "h").agg(
        F.count("*").alias("area"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"),
        F.max("y").alias("y1"), F.count_if(F.col("y") < top).alias("n_top"),
        F.count_if(F.col("y") >= bottom).alias("n_bottom"), F.count_if(F.col("x") < left).alias("n_left"),
        F.count_if(F.col("x") >= right).alias("n_right"),
    )
    return edge_shares(counted, m)


def edge_shares(counted: DataFrame, margin: Column) -> DataFrame:
    """Shares of the frame and of its four strips, from the pixels counted in each."""
    top, left = F.least(margin, F.col("h")), F.least(margin, F.col("w"))
    bottom, right = F.greatest(F.lit(0), F.col("h") - margin), F.greatest(F.lit(0), F.col("w") - margin)
    return counted.select(
        "mask_id", "w", "h", "x0", "y0", "x1", "y1", margin.alias("margin"),
        (F.col("area") / (F.col("w") * F.col("h"))).alias("area_share"),
        (F.col("n_top") / (top * F.col("w"))).alias("top"),
        (F.col("n_bottom") / ((F.col("h") - bottom) * F.col("w"))).alias("bottom"),
        (F.col("n_left") / (left * F.col("h"))).alias("left"),
        (F.col("n_right") / ((F.col("w") - right) * F.col("h"))).alias("right"),
    )


def union_masks(*tables: DataFrame) -> DataFrame:
    """Pixels set in any of the tables."""
    out = tables[0].select(*PIXEL)
    for t in tables[1:]:
        out = out.unionByName(t.select(*PIXEL))
    return out.distinct()


def frame_pixels(masks: DataFrame) -> DataFrame:
    """Every pixel of every frame ``(mask_id, w, h)``."""
    return (
        masks.select("mask_id", "w", "h", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y"))
        .select("mask_id", "w", "h", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("x"), "y")
    )


def inverted(masks: DataFrame, pixels: DataFrame) -> DataFrame:
    """Frame pixels that are not set."""
    return frame_pixels(masks).join(pixels.select("mask_id", "x", "y"), ["mask_id", "x", "y"], "left_anti")
