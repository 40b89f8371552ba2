"""From a decoder's raster to a clean mask, and from a probability map to text regions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from maskloom.functions import boxes as B, rasters as R
from maskloom.operators import components, masks as M, ordering, raster_kernels, runs as row_runs
from maskloom.session import cut_lineage

# When a mask is taken to fill the frame, and which sides then follow.
SNAP_MIN_SHARE = 0.45
SNAP_COVERAGE = 0.65
SNAP_LARGE_SHARE = 0.7
SNAP_LARGE_FACTOR = 0.75
SNAP_TOUCH_COVERAGE = 0.4
SNAP_TWO_SIDES_SHARE = 0.65

# Size limits of text components, as floors and as shares of the model input.
TEXT_MIN_SIDE = 8
TEXT_SIDE_SHARE = 0.01
TEXT_AREA_SHARE = 0.0001
TEXT_MIN_PIXELS = 96
TEXT_PIXEL_SHARE = 0.6
TEXT_MIN_CONFIDENCE = 0.6


def upsampled_pixels(rasters: DataFrame, limit: float = R.LOGIT_THRESHOLD) -> DataFrame:
    """Bilinear upsampling of ``(mask_id, w, h, v, out_w, out_h)`` and threshold, as pixel rows.

    A record first splits into output lines that carry just the two source lines they need; the
    threshold is applied per line, so only set pixels become rows. Nothing is shuffled.
    """
    w, h = F.col("src_w"), F.col("src_h")
    renamed = rasters.select(
        "mask_id", F.col("w").alias("src_w"), F.col("h").alias("src_h"), "v", "out_w", "out_h")

    def line(y):
        at = y / F.col("out_h") * h
        y0 = F.floor(at).cast("int")
        y1 = F.least(y0 + 1, h - 1)
        return F.struct(
            y.alias("y"), F.slice("v", y0 * w + 1, w).alias("upper"), F.slice("v", y1 * w + 1, w).alias("lower"),
            (at - y0).alias("fy"),
        )

    out_lines = F.transform(F.sequence(F.lit(0), F.col("out_h") - 1), line)
    lines = renamed.select("mask_id", "src_w", "out_w", "out_h", F.explode_outer(out_lines).alias("l")).select(
        "mask_id", "src_w", "out_w", "out_h", "l.*")

    def above(x):
        at = x / F.col("out_w") * w
        x0 = F.floor(at).cast("int")
        x1 = F.least(x0 + 1, w - 1)
        fx, fy = at - x0, F.col("fy")

        def mix(row):
            return F.get(row, x0).cast("double") * (1 - fx) + F.get(row, x1).cast("double") * fx

        return mix("upper") * (1 - fy) + mix("lower") * fy > F.lit(float(limit))

    xs = F.filter(F.sequence(F.lit(0), F.col("out_w") - 1), above)
    return lines.select("mask_id", F.col("out_w").alias("w"), F.col("out_h").alias("h"), F.explode_outer(xs).alias("x"), "y").filter(
        "x IS NOT NULL")


def upsampled_runs(rasters: DataFrame, limit: float = R.LOGIT_THRESHOLD) -> DataFrame:
    """As :func:`upsampled_pixels`, as row runs; nothing is shuffled and no pixel becomes a row."""
    return raster_kernels.upsampled_runs(rasters, limit)


def blurred(rasters: DataFrame, sigma: float = R.BLUR_SIGMA) -> DataFrame:
    """Gaussian blur of array rasters; beyond the edge the edge value repeats. Stored in single precision."""
    return raster_kernels.blurred(rasters, sigma)


def smoothing_limits(w: Column, h: Column) -> dict[str, Column]:
    """Fixed rules: how small a speck or hole is, and how far gaps are closed, for a frame."""
    area = w.cast("double") * h
    reach = F.least(F.lit(5), B.round_half_up(F.least(w, h) / 250))
    return {
        "speck": F.greatest(F.lit(100), F.floor(area * F.lit(0.0005))),
        "hole": F.greatest(F.lit(200), F.floor(area * F.lit(0.0015))),
        "closing": F.greatest(F.lit(3), reach).cast("int"),
    }


def default_smoothing_limits(w: Column, h: Column) -> dict[str, Column]:
    """Fixed rules where smoothing is used on its own."""
    factor = F.sqrt(w.cast("double") * h) / 1000
    return {
        "speck": F.greatest(F.lit(50), F.floor(factor * 200)),
        "hole": F.greatest(F.lit(30), F.floor(factor * 100)),
        "closing": F.lit(3),
    }


def smoothed_runs(frames: DataFrame, runs: DataFrame, speck: Column | int | None, hole: Column | int,
                  closing: Column | int = 3, erode_after: int = 1) -> DataFrame:
    """Drop specks (unless ``speck`` is None), fill holes, close gaps, and take back the growth, on row runs."""
    out = runs.select(*row_runs.RUN)
    if speck is not None:
        out = row_runs.without_small(out, speck)
    out = row_runs.filled_holes(frames, out, hole)
    out = row_runs.closed(out, closing)
    return row_runs.eroded(out, erode_after) if erode_after else out


def smoothed(frames: DataFrame, pixels: DataFrame, speck: Column | int | None, hole: Column | int,
             closing: Column | int = 3, erode_after: int = 1) -> DataFrame:
    """As :func:`smoothed_runs`, from pixel rows to pixel rows."""
    return row_runs.pixels_of_runs(smoothed_runs(frames, row_runs.runs_of_pixels(pixels), speck, hole, closing, erode_after))


def snap_decisions(runs: DataFrame, min_share: float = SNAP_MIN_SHARE, coverage: float = SNAP_COVERAGE) -> DataFrame:
    """Per mask which frame sides to fill; only masks that snap are listed."""
    s = row_runs.edge_coverage(runs)
    near = {
        "top": F.col("y0") <= F.col("margin"),
        "bottom": F.col("y1") + 1 >= F.col("h") - F.col("margin"),
        "left": F.col("x0") <= F.col("margin"),
        "right": F.col("x1") + 1 >= F.col("w") - F.col("margin"),
    }
    for side, close in near.items():
        c = F.col(side)
        s = s.withColumn(
            f"fill_{side}",
            (c >= coverage) | ((F.col("area_share") >= SNAP_LARGE_SHARE) & (c >= coverage * SNAP_LARGE_FACTOR))
            | (close & (c >= SNAP_TOUCH_COVERAGE)),
        )
    sides = list(near)
    n = reduce(lambda a, b: a + b, [F.col(f"fill_{x}").cast("int") for x in sides])
    mean = reduce(lambda a, b: a + b, [F.col(x) for x in sides]) / 4
    share = F.col("area_share")
    return s.filter((share >= min_share) & (
        (n >= 3) | ((n >= 2) & (share >= SNAP_TWO_SIDES_SHARE)) | (mean >= coverage)))


def snapped_runs(runs: DataFrame) -> DataFrame:
    """Fill the strips along the frame sides that a large mask already hugs, then close by one pixel; row runs."""
    own = cut_lineage(runs.select(*row_runs.RUN))  # measured, then read for both outcomes
    d = snap_decisions(own)
    m, w, h = F.col("margin"), F.col("w"), F.col("h")
    spans = F.array_compact(F.array(*[
        F.when(F.col(f"fill_{side}") & (x1 >= x0) & (y1 >= y0), F.struct(
            x0.cast("int").alias("xa"), x1.cast("int").alias("xb"), y0.cast("int").alias("ya"), y1.cast("int").alias("yb")))
        for side, x0, x1, y0, y1 in [
            ("top", F.lit(0), w - 1, F.lit(0), F.least(m, h) - 1),
            ("bottom", F.lit(0), w - 1, F.greatest(F.lit(0), h - m), h - 1),
            ("left", F.lit(0), F.least(m, w) - 1, F.lit(0), h - 1),
            ("right", F.greatest(F.lit(0), w - m), w - 1, F.lit(0), h - 1),
        ]
    ]))
    strips = d.select("mask_id", "w", "h", F.explode(spans).alias("s")).select(
        "mask_id", "w", "h", F.explode(F.sequence("s.ya", "s.yb")).alias("y"), F.col("s.xa").alias("x0"), F.col("s.xb").alias("x1"))
    ids = d.select("mask_id")
    filled = row_runs.united_runs(own.join(ids, "mask_id", "left_semi"), strips)
    return row_runs.closed(filled, 1).unionByName(own.join(ids, "mask_id", "left_anti").select(*row_runs.RUN))


def snapped_to_edges(pixels: DataFrame) -> DataFrame:
    """As :func:`snapped_runs`, from pixel rows to pixel rows."""
    return row_runs.pixels_of_runs(snapped_runs(row_runs.runs_of_pixels(pixels)))


def refined_runs(rasters: DataFrame, points: DataFrame, sigma: float = R.BLUR_SIGMA,
                 limit: float = R.LOGIT_THRESHOLD, limits=smoothing_limits) -> DataFrame:
    """Blur, upsample, threshold, keep what the points touch, smooth, snap: the final masks as row runs.

    ``rasters(mask_id, w, h, v, out_w, out_h)``; ``points(mask_id, px, py)`` in output pixels. No step has a row for each
    pixel of the output, set or not.
    """
    frames = rasters.select("mask_id", F.col("out_w").alias("w"), F.col("out_h").alias("h"))
    lim = limits(F.col("w"), F.col("h"))
    runs = row_runs.touching_points(upsampled_runs(blurred(rasters, sigma), limit), points, lim["speck"])
    return snapped_runs(smoothed_runs(frames, runs, None, lim["hole"], lim["closing"], 1))


def refined_masks(rasters: DataFrame, points: DataFrame, sigma: float = R.BLUR_SIGMA,
                  limit: float = R.LOGIT_THRESHOLD, limits=smoothing_limits) -> DataFrame:
    """As :func:`refined_runs`, as pixel rows."""
    return row_runs.pixels_of_runs(refined_runs(rasters, points, sigma, limit, limits))


def text_regions(maps: DataFrame, probability: float = R.TEXT_PROBABILITY,
                 min_confidence: float = TEXT_MIN_CONFIDENCE, floors: tuple[int, int] = (TEXT_MIN_SIDE, TEXT_MIN_PIXELS)) -> DataFrame:
    """Text boxes from probability maps ``(mask_id, w, h, v, image_w, image_h)``, in image space.

    Components are measured and size-filtered first; only boxes that pass meet the map again, as two lines of
    its summed-area table, for the mean over the whole box.
    """
    min_side, min_pixels = floors
    px = M.thresholded(maps, probability)
    labels = components.labelled(px)
    w, h = F.col("w"), F.col("h")
    found = labels.groupBy("mask_id", "w", "h", "label").agg(
        F.count("*").alias("n"), F.avg("v").alias("mask_mean"), F.min("x").alias("x0"), F.max("x").alias("x1"),
        F.min("y").alias("y0"), F.max("y").alias("y1"))
    least_area = F.greatest(F.lit(min_side * min_side), B.round_half_up(w * h * F.lit(TEXT_AREA_SHARE)))
    least_side = F.greatest(F.lit(min_side), B.round_half_up(F.least(w, h) * F.lit(TEXT_SIDE_SHARE)))
    least_pixels = F.greatest(F.lit(min_pixels), B.round_half_up(least_area * F.lit(TEXT_PIXEL_SHARE)))
    bw, bh = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    sized = found.filter((F.col("n") >= least_pixels) & (bw >= least_side) & (bh >= least_side) & (bw * bh >= least_area))

    # The box sum is what the last line of the box has summed up less what the line above it has.
    edges = F.array(F.struct(F.col("y1").alias("y"), F.lit(1.0).alias("sign")), F.struct((F.col("y0") - 1).alias("y"), F.lit(-1.0).alias("sign")))
    corners = sized.select("mask_id", "label", "x0", "x1", F.explode(edges).alias("e")).select("mask_id", "label", "x0", "x1", "e.y", "e.sign").filter("y >= 0")
    part = F.col("sign") * (F.get("sums", F.col("x1") + 1) - F.get("sums", F.col("x0")))
    box_sums = corners.join(raster_kernels.summed_lines(maps), ["mask_id", "y"]).groupBy("mask_id", "label").agg(F.sum(part).alias("box_sum"))

    sure = (
        sized.join(box_sums, ["mask_id", "label"]).withColumn("box_mean", F.col("box_sum") / (bw * bh))
        .filter((F.col("box_mean") >= probability) & (F.col("mask_mean") >= min_confidence))
    )
    frames = maps.select("mask_id", "image_w", "image_h")
    sx, sy = F.col("image_w") / w, F.col("image_h") / h
    box = B.scale_box(B.box(F.col("x0"), F.col("y0"), bw, bh), sx, sy)
    grown = (
        sure.join(frames, "mask_id").withColumn("box", box)
        .withColumn("bbox", B.grow(F.col("box"), F.col("image_w").cast("double"), F.col("image_h").cast("double")))
        .select("mask_id", "label", "bbox.*", F.least("box_mean", "mask_mean").alias("confidence"))
    )
    placed = ordering.reading_order(grown.select(
        F.col("mask_id").alias("document_id"), F.col("label").alias("region_id"), "x", "y", "w", "h", "confidence"))
    return placed.withColumn("polygon", B.corners(B.box("x", "y", "w", "h")))
