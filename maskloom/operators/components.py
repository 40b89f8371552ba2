"""4-connected components of pixel tables.

Pixels are labelled tile by tile (a group is at most ``tile`` x ``tile`` pixels), then labels that
touch across tile borders are merged by star contraction over the border pairs. Masks that fit in
one tile skip the second step. A label is the component's first pixel in row order, as
``y * 2^32 + x``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from maskloom.functions.boxes import round_half_up
from maskloom.operators import runs as row_runs
from maskloom.operators.connectivity import MIN_COMPONENT_AREA, ROW, contracted, united
from maskloom.session import cut_lineage

TILE = 128


def _labels(pdf: pd.DataFrame, tile: int) -> pd.DataFrame:
    """Label many whole tiles at once; rows are sorted by mask, tile, y, x."""
    x, y = pdf["x"].to_numpy(np.int64), pdf["y"].to_numpy(np.int64)
    # One spare row and column per tile keep neighbours of different tiles apart.
    key = _starts(pdf).cumsum() * (2 * tile * (tile + 1)) + (y % tile) * (2 * tile) + x % tile
    below = np.searchsorted(key, key + 2 * tile)
    found = np.flatnonzero(np.append(key, -1)[below] == key + 2 * tile)
    beside = np.flatnonzero(np.diff(key) == 1)
    a, b = np.concatenate([beside, found]), np.concatenate([beside + 1, below[found]])
    return pdf.drop(columns=["tile_x", "tile_y"]).assign(label=(y * ROW + x)[united(len(key), a, b)])


def _starts(pdf: pd.DataFrame) -> np.ndarray:
    """True where a row begins another tile than the row before."""
    keys = pdf[["mask_id", "tile_x", "tile_y"]]
    return (keys != keys.shift()).any(axis=1).to_numpy()


def labelled(pixels: DataFrame, tile: int = TILE) -> DataFrame:
    """Add ``label``. ``pixels`` has distinct rows ``(mask_id, w, h, x, y, ...)``.

    The result is materialised: callers read it several times, and the test for frames wider than
    a tile must not run everything before it again.
    """
    schema = T.StructType([*pixels.schema.fields, T.StructField("label", T.LongType())])

    def label_batches(batches):
        open_tile = None  # the last tile of a batch may go on in the next one; never more than that
        for pdf in batches:
            if open_tile is not None:
                pdf = pd.concat([open_tile, pdf], ignore_index=True)
            if not len(pdf):
                continue
            cut = int(np.flatnonzero(_starts(pdf))[-1])
            open_tile = pdf.iloc[cut:].reset_index(drop=True)
            if cut:
                yield _labels(pdf.iloc[:cut].reset_index(drop=True), tile)
        if open_tile is not None:
            yield _labels(open_tile, tile)

    tiles = ["mask_id", "tile_x", "tile_y"]
    local = cut_lineage(
        pixels.withColumn("tile_x", F.floor(F.col("x") / tile)).withColumn("tile_y", F.floor(F.col("y") / tile))
        .repartition(*tiles).sortWithinPartitions(*tiles, "y", "x")
        .mapInPandas(label_batches, schema)
    )
    wide = (F.col("w") > tile) | (F.col("h") > tile)
    if local.filter(wide).isEmpty():
        return local
    roots = contracted(_border_pairs(local.filter(wide), tile))
    return cut_lineage(
        local.join(roots, ["mask_id", "label"], "left")
        .withColumn("label", F.coalesce("root", "label")).select(*pixels.columns, "label")
    )


def _border_pairs(local: DataFrame, tile: int) -> DataFrame:
    def pairs(axis, other):
        last = local.filter(F.col(axis) % tile == tile - 1).select(
            "mask_id", (F.col(axis) + 1).alias(axis), other, F.col("label").alias("p"))
        first = local.filter((F.col(axis) % tile == 0) & (F.col(axis) > 0)).select("mask_id", axis, other, F.col("label").alias("q"))
        return last.join(first, ["mask_id", axis, other]).select(
            "mask_id", F.greatest("p", "q").alias("u"), F.least("p", "q").alias("v"))

    return pairs("x", "y").unionByName(pairs("y", "x")).filter("u <> v").distinct()


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("mask_id", "w", "h", "label").agg(F.count("*").alias("area"))


def largest_share(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """Share of the largest component in the mask area; 0 for an empty mask."""
    share = component_sizes(labels).groupBy("mask_id").agg(
        (F.max("area") / F.sum("area")).alias("share"), F.count("*").alias("components"))
    return masks.select("mask_id").join(share, "mask_id", "left").select(
        "mask_id", F.coalesce("share", F.lit(0.0)).alias("share"), F.coalesce("components", F.lit(0)).alias("components"))


def _keep(labels: DataFrame, which: DataFrame, columns: list[str]) -> DataFrame:
    return labels.join(which.select("mask_id", "label"), ["mask_id", "label"], "left_semi").select(*columns)


def without_small(pixels: DataFrame, min_area: Column | int = MIN_COMPONENT_AREA, tile: int = TILE) -> DataFrame:
    """Drop components with fewer than ``min_area`` pixels (a number or an expression in ``w``, ``h``)."""
    limit = F.lit(min_area) if isinstance(min_area, int) else min_area
    labels = labelled(pixels, tile)
    return _keep(labels, component_sizes(labels).filter(F.col("area") >= limit), pixels.columns)


def filled_holes(masks: DataFrame, pixels: DataFrame, min_area: Column | int, band: int = row_runs.BAND) -> DataFrame:
    """Set the background components with fewer than ``min_area`` pixels; the background is handled as row runs."""
    return row_runs.pixels_of_runs(row_runs.filled_holes(masks, row_runs.runs_of_pixels(pixels), min_area, band))


def touching_points(
    pixels: DataFrame, points: DataFrame, min_area: Column | int | None = None, tile: int = TILE
) -> DataFrame:
    """Keep components that hold one of the mask's ``points(mask_id, px, py)``, rounded to pixels.

    Where no point hits, the largest component stays (of equals the later in row order). Masks
    without any point are left whole. ``min_area`` then drops small components in the same pass,
    as the ones kept are unchanged.
    """
    labels = labelled(pixels, tile)
    spots = points.select("mask_id", round_half_up(F.col("px")).cast("int").alias("x"),
                          round_half_up(F.col("py")).cast("int").alias("y"))
    hit = labels.join(spots.distinct(), ["mask_id", "x", "y"]).select("mask_id", "label").distinct()
    sizes = component_sizes(labels)
    asked = points.select("mask_id").distinct()
    missed = asked.join(hit.select("mask_id").distinct(), "mask_id", "left_anti")
    largest = sizes.join(missed, "mask_id", "left_semi").groupBy("mask_id").agg(
        F.max_by("label", F.struct("area", "label")).alias("label"))
    chosen = sizes.join(asked, "mask_id", "left_anti").unionByName(
        sizes.join(hit.unionByName(largest), ["mask_id", "label"], "left_semi"))
    if min_area is not None:
        chosen = chosen.filter(F.col("area") >= (F.lit(min_area) if isinstance(min_area, int) else min_area))
    return _keep(labels, chosen, pixels.columns)
