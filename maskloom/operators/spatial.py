"""Joins between regions, pointers and selection windows.

Documents of up to ``CROWD`` rows meet on the document: no row is repeated. Those of more
meet on ``(document, level, tile)`` instead, so that one document with
very many regions is spread over its tiles. The tiles of a level are as large as its boxes, so a box lies
in four of them at most. A pair meets in exactly one tile: the one that holds the top left corner of
the common area on the level of the larger box.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from maskloom.functions import boxes as B
from maskloom.functions.rasters import bit_at
from maskloom.session import cut_lineage

# Shares that decide a selection and a clipped candidate, and hit scoring.
SELECTION_SHARE = 0.5
VISIBLE_SHARE = 0.5
HIT_WEIGHT = 1e6
OPAQUE_ABOVE = 10
STAGGER_MS = 200

TILE = 64.0
# Tiles double in size from level to level, up to this one.
LEVELS = 12
#: Rows of a document, of both tables together, up to which they meet on the document alone.
CROWD = 1024


def _b(alias: str) -> Column:
    return B.box(F.col(f"{alias}.x"), F.col(f"{alias}.y"), F.col(f"{alias}.w"), F.col(f"{alias}.h"))


def _level(df: DataFrame, tile: float) -> Column:
    """The first level whose tiles are no smaller than the box."""
    side = F.greatest(F.col("w"), F.col("h"), F.lit(0.0)) / tile
    return F.least(F.lit(LEVELS), F.when(side > 1, F.ceil(F.log2(side))).otherwise(F.lit(0)).cast("int"))


def _levels(df: DataFrame, tile: float) -> Column:
    """The levels that occur in a table, as an array of at most ``LEVELS + 1``."""
    found = df.select(_level(df, tile).alias("level")).distinct().collect()
    return F.array(*[F.lit(r.level) for r in sorted(found)]).cast("array<int>")


def _spread(df: DataFrame, levels: Column, tile: float) -> DataFrame:
    """One row per tile that a box touches on each of ``levels``; on its own level that is four at most."""
    out = df.withColumn("level", F.explode(levels))
    scale = F.lit(tile) * F.pow(F.lit(2.0), F.col("level"))
    for axis, size in (("x", "w"), ("y", "h")):
        low, high = F.col(axis), F.greatest(F.col(axis), F.col(axis) + F.col(size))
        out = out.withColumn(f"tile_{axis}", F.explode(F.sequence(F.floor(low / scale), F.floor(high / scale))))
    return out


def _by_crowd(left: DataFrame, right: DataFrame) -> list[tuple[DataFrame, DataFrame, bool]]:
    """Both tables cut into documents of up to ``CROWD`` rows and, if there are any, those of more (``True``).

    A crowded document takes more than ``CROWD`` rows, so few ids are kept, however large the tables.
    """
    rows = left.select("document_id").unionByName(right.select("document_id")).groupBy("document_id").count()
    crowded = cut_lineage(rows.filter(F.col("count") > CROWD).select("document_id"))
    if crowded.isEmpty():
        return [(left, right, False)]

    def part(how: str) -> list[DataFrame]:
        return [df.join(crowded, "document_id", how) for df in (left, right)]

    return [(*part("left_anti"), False), (*part("left_semi"), True)]


def point_hits(regions: DataFrame, points: DataFrame, tile: float = TILE) -> DataFrame:
    """Non-text regions whose box holds the pointer, edges included.

    In a crowded document a region lies in the tiles of its own level only, a pointer looks into one tile of every level there is.
    """
    sized = regions.filter((F.col("type") != "text") & F.col("x").isNotNull() & F.col("y").isNotNull() & (F.col("w") + F.col("h")).isNotNull())

    def tiled(r: DataFrame, p: DataFrame) -> tuple[DataFrame, DataFrame]:
        scale = F.lit(tile) * F.pow(F.lit(2.0), F.col("level"))
        return _spread(r, F.array(_level(r, tile)), tile), p.withColumn("level", F.explode(_levels(r, tile))).withColumns(
            {"tile_x": F.floor(F.col("px") / scale), "tile_y": F.floor(F.col("py") / scale)})

    out = []
    for r, p, crowded in _by_crowd(sized, points):
        r, p = tiled(r, p) if crowded else (r, p)
        on = [F.col(f"r.{c}") == F.col(f"p.{c}") for c in ("document_id", "level", "tile_x", "tile_y")[:4 if crowded else 1]]
        out.append(p.alias("p").join(r.alias("r"), [*on, B.contains_point(_b("r"), F.col("p.px"), F.col("p.py"))]).select(
            "p.document_id", "p.px", "p.py", "r.region_id", "r.x", "r.y", "r.w", "r.h",
            *[F.col(f"r.{c}") for c in regions.columns
              if c not in ("document_id", "region_id", "x", "y", "w", "h")],
        ))
    return reduce(DataFrame.unionByName, out)


def pixel_hits(hits: DataFrame, masks: DataFrame, pixels: DataFrame, missing_mask: bool = False) -> DataFrame:
    """Add ``pixel_hit``: is the pointer, scaled to the mask raster, on an opaque pixel?

    ``masks(mask_id, mask_w, mask_h)`` lists the loaded masks and ``pixels(mask_id, x, y, alpha)``
    their pixels. ``missing_mask`` is the answer where no mask is loaded.
    """
    opaque = pixels.filter(F.col("alpha") > OPAQUE_ABOVE).select(
        "mask_id", F.col("x").alias("data_x"), F.col("y").alias("data_y"), F.lit(True).alias("on_pixel")
    )
    return (
        hits.join(masks, "mask_id", "left")
        .withColumn("data_x", F.floor((F.col("px") - F.col("x")) * (F.col("mask_w") / F.col("w"))))
        .withColumn("data_y", F.floor((F.col("py") - F.col("y")) * (F.col("mask_h") / F.col("h"))))
        .join(opaque, ["mask_id", "data_x", "data_y"], "left")
        .withColumn(
            "pixel_hit",
            F.when(F.col("mask_w").isNull(), F.lit(missing_mask)).otherwise(F.coalesce("on_pixel", F.lit(False))),
        )
        .drop("data_x", "data_y", "on_pixel", "mask_w", "mask_h")
    )


def bit_hits(hits: DataFrame, masks: DataFrame, missing_mask: bool | None = False) -> DataFrame:
    """As :func:`pixel_hits`, with the loaded masks as packed bits ``masks(mask_id, mask_w, mask_h, bits)``.

    With ``missing_mask=None`` the answer is null where no mask is loaded.

    A hit meets the packed mask, some KB, instead of pixel rows, and reads one byte of it.
    """
    joined = hits.join(masks, "mask_id", "left").withColumns({
        "data_x": F.floor((F.col("px") - F.col("x")) * (F.col("mask_w") / F.col("w"))),
        "data_y": F.floor((F.col("py") - F.col("y")) * (F.col("mask_h") / F.col("h")))})
    inside = F.col("data_x").between(0, F.col("mask_w") - 1) & F.col("data_y").between(0, F.col("mask_h") - 1)
    on_pixel = F.when(inside, bit_at(F.col("bits"), F.col("data_y") * F.col("mask_w") + F.col("data_x")))
    return joined.withColumn(
        "pixel_hit", F.when(F.col("mask_w").isNull(), F.lit(missing_mask).cast("boolean")).otherwise(F.coalesce(on_pixel, F.lit(False))),
    ).drop("data_x", "data_y", "mask_w", "mask_h", "bits")


def hit_score(pixel_hit: Column, w: Column, h: Column) -> Column:
    """Pixel hits first, then small boxes."""
    size = w * h
    return F.when(pixel_hit, F.lit(HIT_WEIGHT)).otherwise(F.lit(0.0)) + F.lit(HIT_WEIGHT) / F.when(
        size == 0, F.lit(1.0)
    ).otherwise(size)


def best_hit(hits: DataFrame, keys: list[str]) -> DataFrame:
    """One region per pointer: highest score, ties to the smaller region id."""
    score = hit_score(F.col("pixel_hit"), F.col("w"), F.col("h"))
    best = F.min_by(
        F.struct("region_id", score.alias("score")), F.struct((-score).alias("o"), F.col("region_id"))
    )
    return hits.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.region_id", "b.score")


def _window_pairs(regions: DataFrame, windows: DataFrame, tile: float, *columns: Column | str) -> DataFrame:
    """``columns`` of the pairs that touch, regions being ``r`` and windows ``m``.

    In a crowded document they meet on the level of the larger box, so each lies in few tiles: of its own and of the other's higher levels.
    """
    def sized(df: DataFrame) -> DataFrame:
        known = F.col("x").isNotNull() & F.col("y").isNotNull() & (F.col("w") + F.col("h")).isNotNull()
        return df.filter(known)

    def spread(df: DataFrame, others: Column) -> DataFrame:
        higher = F.filter(others, lambda level: level > F.col("own_level"))
        return _spread(df, F.concat(F.array("own_level"), higher), tile)

    def tiled(regions: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
        regions, windows = (df.withColumn("own_level", _level(df, tile)) for df in (regions, windows))
        return spread(regions, _levels(windows, tile)), spread(windows, _levels(regions, tile))

    out = []
    for r, m, crowded in _by_crowd(sized(regions), sized(windows)):
        on = [F.col("r.document_id") == F.col("m.document_id"), B.touches(_b("r"), _b("m"))]
        if crowded:
            r, m = tiled(r, m)
            scale = F.lit(tile) * F.pow(F.lit(2.0), F.col("r.level"))
            on += [F.col(f"r.{c}") == F.col(f"m.{c}") for c in ("level", "tile_x", "tile_y")]
            on.append(F.col("r.level") == F.greatest("r.own_level", "m.own_level"))
            on.append(F.col("r.tile_x") == F.floor(F.greatest("r.x", "m.x") / scale))
            on.append(F.col("r.tile_y") == F.floor(F.greatest("r.y", "m.y") / scale))
        out.append(r.alias("r").join(m.alias("m"), on).select(*columns))
    return reduce(DataFrame.unionByName, out)


def regions_in_window(regions: DataFrame, windows: DataFrame, tile: float = TILE) -> DataFrame:
    """Regions that overlap the dragged window at all; touching edges count."""
    return _window_pairs(regions, windows, tile, "r.document_id", "r.region_id")


def regions_mostly_in_window(
    regions: DataFrame, windows: DataFrame, share: float = SELECTION_SHARE, tile: float = TILE
) -> DataFrame:
    """Non-text regions with at least ``share`` of their area inside the window."""
    usable = regions.filter((F.col("type") != "text") & (F.col("w") > 0) & (F.col("h") > 0))
    ratio = B.overlap_ratio(_b("r"), _b("m"))
    return (
        _window_pairs(usable, windows, tile, "r.document_id", "r.region_id", ratio.alias("ratio"))
        .filter(F.col("ratio") >= share)
    )


def iou_with_leader(regions: DataFrame) -> DataFrame:
    """IoU of every region with the best-scored region of its document."""
    lead = regions.groupBy("document_id").agg(
        F.min_by(
            F.struct("region_id", "x", "y", "w", "h"),
            F.struct((-F.col("score")).alias("o"), F.col("region_id")),
        ).alias("lead")
    )
    return regions.join(lead, "document_id").select(
        "document_id", "region_id", F.col("lead.region_id").alias("leader_id"),
        B.iou(B.box("x", "y", "w", "h"), F.col("lead")).alias("iou"),
    )


def clip_visibility(candidates: DataFrame, clips: DataFrame, share: float = VISIBLE_SHARE) -> DataFrame:
    """Add ``visible``: enough of the candidate shows inside every clipping ancestor.

    Only ancestors that clip are listed in ``clips``; a candidate without any is visible, and an
    empty candidate passes every test.
    """
    c, a = candidates.alias("r"), clips.alias("m")
    total = B.area(_b("r"))
    ok = (total <= 0) | (B.intersection_area(_b("r"), _b("m")) / total >= share)
    verdict = (
        c.join(a, F.col("r.element_id") == F.col("m.element_id"))
        .groupBy(F.col("r.element_id").alias("element_id")).agg(F.bool_and(ok).alias("visible"))
    )
    return candidates.join(verdict, "element_id", "left").withColumn("visible", F.coalesce("visible", F.lit(True)))


def distance_from_selected(boxes: DataFrame, selected: DataFrame) -> DataFrame:
    """Distance of every other box centre from the selected one, and the same scaled by the farthest.

    ``selected(document_id, region_id)`` names one box per document. The farthest distance is an
    aggregate joined back, so a crowded document is not sorted in one task.
    """
    c = B.centroid(B.box("x", "y", "w", "h"))
    centres = boxes.select("document_id", "region_id", c["x"].alias("cx"), c["y"].alias("cy"))
    chosen = centres.join(selected, ["document_id", "region_id"], "left_semi").select(
        "document_id", F.col("region_id").alias("selected_id"), F.col("cx").alias("sx"), F.col("cy").alias("sy")
    )
    far = (
        centres.join(chosen, "document_id").filter(F.col("region_id") != F.col("selected_id"))
        .withColumn("distance", F.hypot(F.col("cx") - F.col("sx"), F.col("cy") - F.col("sy")))
        .select("document_id", "region_id", "distance")
    )
    most = far.groupBy("document_id").agg(F.max("distance").alias("farthest"))
    share = F.when(F.col("farthest") > 0, F.col("distance") / F.col("farthest"))
    return far.join(most, "document_id").select(
        "document_id", "region_id", "distance", share.alias("share"), (share * STAGGER_MS).alias("delay_ms")
    )
