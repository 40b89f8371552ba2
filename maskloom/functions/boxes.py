"""Geometry of axis-aligned boxes and polygons.

A box is a struct column ``(x, y, w, h)`` of doubles, a point a struct ``(x, y)``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# How far a detected text box grows, and when a contour is noise.
TEXT_BOX_GROWTH = 1.5
NOISE_AREA = 10.0
NOISE_PERIMETER = 10.0

# Input sizes of the text detector and of the segmentation model.
DETECTOR_MAX_SIDE = 960
DETECTOR_SIDE_STEP = 32
SEGMENTER_SIDE = 1024


def box(x, y, w, h) -> Column:
    """Box struct from four numeric columns."""
    def num(c):
        return (F.col(c) if isinstance(c, str) else c).cast("double")

    return F.struct(num(x).alias("x"), num(y).alias("y"), num(w).alias("w"), num(h).alias("h"))


def round_half_up(v: Column) -> Column:
    """Round to the nearest integer, halves towards +infinity (unlike Spark's ``round``)."""
    return F.floor(v + F.lit(0.5))


def area(b: Column) -> Column:
    return b["w"] * b["h"]


def intersection_area(a: Column, b: Column) -> Column:
    dx = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    dy = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    zero = F.lit(0.0)
    return F.greatest(zero, dx) * F.greatest(zero, dy)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 when the union is empty."""
    inter = intersection_area(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def overlap_ratio(mask_box: Column, window: Column) -> Column:
    """Share of ``mask_box`` inside ``window``; null for empty boxes or no strict overlap."""
    inter = intersection_area(mask_box, window)
    usable = (mask_box["w"] > 0) & (mask_box["h"] > 0) & (inter > 0)
    return F.when(usable, inter / area(mask_box))


def contains_point(b: Column, px: Column, py: Column) -> Column:
    """Edges belong to the box."""
    return px.between(b["x"], b["x"] + b["w"]) & py.between(b["y"], b["y"] + b["h"])


def touches(a: Column, b: Column) -> Column:
    """Any overlap, including touching edges."""
    return (
        (a["x"] <= b["x"] + b["w"])
        & (b["x"] <= a["x"] + a["w"])
        & (a["y"] <= b["y"] + b["h"])
        & (b["y"] <= a["y"] + a["h"])
    )


def centroid(b: Column) -> Column:
    return F.struct((b["x"] + b["w"] / 2).alias("x"), (b["y"] + b["h"] / 2).alias("y"))


def corners(b: Column) -> Column:
    """The box as a polygon: four corners from the top left, clockwise."""
    right, bottom = b["x"] + b["w"], b["y"] + b["h"]

    def pt(x, y):
        return F.struct(x.alias("x"), y.alias("y"))

    return F.array(pt(b["x"], b["y"]), pt(right, b["y"]), pt(right, bottom), pt(b["x"], bottom))


def grow(b: Column, frame_w: Column, frame_h: Column, ratio: float = TEXT_BOX_GROWTH) -> Column:
    """Grow a box by area * ratio / perimeter on every side, clamped to the frame.

    The clipped part at the left and top does not shorten the box: width and height keep
    twice the distance and are only limited by the right and bottom frame edge.
    """
    d = area(b) * F.lit(ratio) / (F.lit(2.0) * (b["w"] + b["h"]))
    x = F.greatest(F.lit(0.0), b["x"] - d)
    y = F.greatest(F.lit(0.0), b["y"] - d)
    return F.struct(
        x.alias("x"),
        y.alias("y"),
        F.least(frame_w - x, b["w"] + 2 * d).alias("w"),
        F.least(frame_h - y, b["h"] + 2 * d).alias("h"),
    )


def scale_box(b: Column, sx: Column, sy: Column) -> Column:
    """Box in another coordinate space (image, model or display)."""
    return F.struct(
        (b["x"] * sx).alias("x"), (b["y"] * sy).alias("y"),
        (b["w"] * sx).alias("w"), (b["h"] * sy).alias("h"),
    )


def scale_point(x: Column, y: Column, sx: Column, sy: Column) -> Column:
    return F.struct((x * sx).alias("x"), (y * sy).alias("y"))


def detector_input_size(w: Column, h: Column) -> Column:
    """Model input size: longest side at most 960, each side rounded up to a multiple of 32."""
    ratio = F.least(F.lit(float(DETECTOR_MAX_SIDE)) / F.greatest(w, h), F.lit(1.0))
    step = F.lit(DETECTOR_SIDE_STEP)

    def side(v):
        return (F.ceil(round_half_up(v * ratio) / step) * step).cast("long")

    return F.struct(side(w).alias("w"), side(h).alias("h"))


def normalize_box(b: Column) -> Column:
    """Null boxes and missing members become zeros."""
    def part(name):
        return F.coalesce(b[name].cast("double"), F.lit(0.0)).alias(name)

    return F.struct(*[part(n) for n in ("x", "y", "w", "h")])


def normalize_polygon(points: Column) -> Column:
    """Null polygons become empty, missing coordinates zero."""
    zero = F.lit(0.0)
    return F.coalesce(
        F.transform(
            points,
            lambda p: F.struct(
                F.coalesce(p["x"].cast("double"), zero).alias("x"),
                F.coalesce(p["y"].cast("double"), zero).alias("y"),
            ),
        ),
        F.array().cast("array<struct<x:double,y:double>>"),
    )


def _next_points(points: Column) -> Column:
    n = F.size(points)
    return F.concat(F.slice(points, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(points, 1, 1))


def signed_area(points: Column) -> Column:
    """Shoelace area; its sign tells the direction of travel."""
    terms = F.zip_with(points, _next_points(points), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t) / 2


def perimeter(points: Column) -> Column:
    terms = F.zip_with(
        points, _next_points(points),
        lambda p, q: F.sqrt((q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"])),
    )
    return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)


def is_hole(points: Column) -> Column:
    return signed_area(points) < 0


def is_noise_contour(points: Column) -> Column:
    return (F.abs(signed_area(points)) < NOISE_AREA) & (perimeter(points) < NOISE_PERIMETER)


def covered_tiles(lo: Column, hi: Column, side: float) -> Column:
    """Indices of the tiles of width ``side`` that the closed span ``[lo, hi]`` touches."""
    s = F.lit(float(side))
    return F.sequence(F.floor(lo / s), F.floor(F.greatest(lo, hi) / s))


def tile_of(v: Column, side: float) -> Column:
    return F.floor(v / F.lit(float(side)))
