"""Masks as row runs: rows ``(mask_id, w, h, y, x0, x1)``, one for each stretch of set pixels in a line.

Runs of a line are maximal (they neither overlap nor touch) unless a function says that it takes any. A frame costs a
row for each line and gap instead of one for each background pixel, and a large blob costs its height, not its area.
Lines are the units of work: a window looks at one line of one mask at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from maskloom.functions.boxes import round_half_up
from maskloom.operators import masks as M
from maskloom.operators.connectivity import MIN_COMPONENT_AREA, ROW, contracted, united
from maskloom.session import cut_lineage

RUN = ["mask_id", "w", "h", "y", "x0", "x1"]
#: Lines labelled together, and columns in which runs of neighbouring bands, or runs and points, are matched.
BAND, CELL = 64, 64


def _length() -> Column:
    return F.col("x1") - F.col("x0") + 1


def _typed(runs: DataFrame) -> DataFrame:
    return runs.select("mask_id", *[F.col(c).cast("int").alias(c) for c in RUN[1:]])


def runs_of_pixels(pixels: DataFrame) -> DataFrame:
    """Distinct pixel rows ``(mask_id, w, h, x, y)`` as runs: pixels of a run have one difference of x and rank in the line."""
    line = Window.partitionBy("mask_id", "y").orderBy("x")
    return _typed(pixels.withColumn("_run", F.col("x") - F.row_number().over(line)).groupBy("mask_id", "w", "h", "y", "_run").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1")))


def runs_of_rasters(rasters: DataFrame, limit: float) -> DataFrame:
    """Runs of what exceeds ``limit`` in array rasters ``(mask_id, w, h, v)``; tasks shuffle runs, never pixels."""
    above = F.filter(F.sequence(F.lit(0), F.size("v") - 1), lambda i: F.get("v", i).cast("double") > F.lit(float(limit)))
    set_ = rasters.filter(F.size("v") > 0).select("mask_id", "w", "h", F.posexplode_outer(above).alias("_at", "_i")).filter("_i IS NOT NULL")
    return _typed(set_.withColumn("y", F.floor(F.col("_i") / F.col("w"))).groupBy("mask_id", "w", "h", "y", (F.col("_i") - F.col("_at")).alias("_run")).agg(
        F.min(F.col("_i") % F.col("w")).alias("x0"), F.max(F.col("_i") % F.col("w")).alias("x1")))


def pixels_of_runs(runs: DataFrame) -> DataFrame:
    return runs.select("mask_id", "w", "h", F.explode(F.sequence("x0", "x1")).alias("x"), "y").select(*M.PIXEL)


def merged(runs: DataFrame) -> DataFrame:
    """Maximal runs of any runs: those of a line that overlap or touch become one."""
    line = Window.partitionBy("mask_id", "y").orderBy("x0", "x1")
    before = F.max("x1").over(line.rowsBetween(Window.unboundedPreceding, -1))
    begins = runs.select(*RUN, (before.isNull() | (F.col("x0") > before + 1)).cast("int").alias("_begins"))
    return _typed(begins.withColumn("_run", F.sum("_begins").over(line.rowsBetween(Window.unboundedPreceding, 0))).groupBy(
        "mask_id", "w", "h", "y", "_run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")))


def united_runs(*tables: DataFrame) -> DataFrame:
    """Runs of the pixels set in any of the tables."""
    out = tables[0].select(*RUN)
    for t in tables[1:]:
        out = out.unionByName(t.select(*RUN))
    return merged(out)


def complement(masks: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs of what is not set in the frames ``(mask_id, w, h)``: the gaps before, between and after the runs of each line.

    Every line gets one empty run past its end, so lines without runs are there and the last gap closes.
    """
    lines = masks.select("mask_id", "w", "h").filter("w > 0 AND h > 0").select(
        "mask_id", "w", "h", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y"), F.col("w").alias("x0"), F.col("w").alias("x1"))
    line = Window.partitionBy("mask_id", "y").orderBy("x0")
    gap = runs.select(*RUN).unionByName(lines.select(*RUN)).withColumns(
        {"_from": F.coalesce(F.lag("x1").over(line) + 1, F.lit(0)), "_to": F.col("x0") - 1})
    return _typed(gap.filter("_from <= _to").select("mask_id", "w", "h", "y", F.col("_from").alias("x0"), F.col("_to").alias("x1")))


def _radius(r: Column | int) -> Column:
    return F.lit(r) if isinstance(r, int) else r


def dilated(runs: DataFrame, radius: Column | int) -> DataFrame:
    """Set what lies within ``radius`` (a number or an expression in ``w``, ``h``) of a run, by a square clipped to the frame."""
    r = _radius(radius)
    wide = runs.select("mask_id", "w", "h", F.col("y").alias("_y"), F.greatest(F.col("x0") - r, F.lit(0)).alias("x0"),
                       F.least(F.col("x1") + r, F.col("w") - 1).alias("x1"), r.alias("_r"))
    own_line = merged(wide.withColumn("y", F.col("_y"))).select(*RUN, r.alias("_r"))
    tall = own_line.withColumn("y", F.explode(F.sequence(
        F.greatest(F.col("y") - F.col("_r"), F.lit(0)).cast("int"), F.least(F.col("y") + F.col("_r"), F.col("h") - 1).cast("int"))))
    return merged(tall)


def eroded(runs: DataFrame, radius: Column | int = 1) -> DataFrame:
    """Keep what has its whole neighbourhood inside the frame set.

    A run shrinks at each end that is not at the frame. Then it is counted for every line it is needed in; of a line those
    stretches stay that all lines around it cover, found by adding up begins and ends from left to right.
    """
    r = _radius(radius)
    narrow = runs.select(
        "mask_id", "w", "h", "y", F.when(F.col("x0") == 0, 0).otherwise(F.col("x0") + r).alias("x0"),
        F.when(F.col("x1") == F.col("w") - 1, F.col("x1")).otherwise(F.col("x1") - r).alias("x1"), r.alias("_r")).filter("x0 <= x1")
    lines = F.sequence(F.greatest(F.col("y") - F.col("_r"), F.lit(0)).cast("int"), F.least(F.col("y") + F.col("_r"), F.col("h") - 1).cast("int"))
    edges = F.array(F.struct(F.col("x0").alias("x"), F.lit(1).alias("d")), F.struct((F.col("x1") + 1).alias("x"), F.lit(-1).alias("d")))
    events = narrow.withColumn("y", F.explode(lines)).select("mask_id", "w", "h", "y", "_r", F.explode(edges).alias("e")).select(
        "mask_id", "w", "h", "y", "_r", "e.x", "e.d")
    line = Window.partitionBy("mask_id", "y").orderBy("x")
    wanted = F.least(F.col("y") + F.col("_r"), F.col("h") - 1) - F.greatest(F.col("y") - F.col("_r"), F.lit(0)) + 1
    swept = events.withColumns({"_n": F.sum("d").over(line), "_next": F.lead("x").over(line), "_wanted": wanted})
    return _typed(swept.filter("_n = _wanted AND x < _next").select(
        "mask_id", "w", "h", "y", F.col("x").alias("x0"), (F.col("_next") - 1).alias("x1")))


def closed(runs: DataFrame, radius: Column | int = 2) -> DataFrame:
    return eroded(dilated(runs, radius), radius)


def opened(runs: DataFrame, radius: Column | int = 2) -> DataFrame:
    return dilated(eroded(runs, radius), radius)


def _labels(pdf: pd.DataFrame, band: int) -> pd.DataFrame:
    """Label whole bands; rows are sorted by mask, band, y, x0."""
    y, x0, x1 = (pdf[c].to_numpy(np.int64) for c in ("y", "x0", "x1"))
    span = int(x1.max()) + 2
    # One spare line per band keeps the last line of a band and the first of the next apart.
    line = (_starts(pdf).cumsum() * (band + 1) + y % band) * span
    low = np.searchsorted(line + x1, line + span + x0)
    high = np.searchsorted(line + x0, line + span + x1, side="right")
    n = np.maximum(high - low, 0)
    a = np.repeat(np.arange(len(y)), n)
    b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    return pdf.drop(columns=["band"]).assign(label=(y * ROW + x0)[united(len(y), a, b)])


def _starts(pdf: pd.DataFrame) -> np.ndarray:
    keys = pdf[["mask_id", "band"]]
    return (keys != keys.shift()).any(axis=1).to_numpy()


def _in_cells(runs: DataFrame) -> DataFrame:
    """Each run once for every cell of its line that it lies in."""
    return runs.withColumn("cell", F.explode(F.sequence(F.floor(F.col("x0") / CELL), F.floor(F.col("x1") / CELL))))


def labelled(runs: DataFrame, band: int = BAND) -> DataFrame:
    """Runs with ``label``, the first pixel (``y * 2^32 + x``) of their 4-connected component.

    Runs of neighbouring lines that share a column are connected. Lines are labelled band by band, in streams of sorted
    rows; what touches across bands is merged by star contraction. The result is materialised.
    """
    schema = T.StructType([*_typed(runs).schema.fields, T.StructField("label", T.LongType())])

    def label_batches(batches):
        open_band = None  # the last band of a batch may go on in the next one; never more than that
        for pdf in batches:
            if open_band is not None:
                pdf = pd.concat([open_band, pdf], ignore_index=True)
            if not len(pdf):
                continue
            cut = int(np.flatnonzero(_starts(pdf))[-1])
            open_band = pdf.iloc[cut:].reset_index(drop=True)
            if cut:
                yield _labels(pdf.iloc[:cut].reset_index(drop=True), band)
        if open_band is not None:
            yield _labels(open_band, band)

    banded = _typed(runs).withColumn("band", F.floor(F.col("y") / band))
    local = cut_lineage(banded.repartition("mask_id", "band").sortWithinPartitions("mask_id", "band", "y", "x0").mapInPandas(label_batches, schema))
    tall = local.filter(F.col("h") > band)
    if tall.isEmpty():
        return local
    last = _in_cells(tall.filter(F.col("y") % band == band - 1)).select(
        "mask_id", (F.col("y") + 1).alias("y"), "cell", F.col("x0").alias("a0"), F.col("x1").alias("a1"), F.col("label").alias("p"))
    first = _in_cells(tall.filter((F.col("y") % band == 0) & (F.col("y") > 0))).select("mask_id", "y", "cell", "x0", "x1", F.col("label").alias("q"))
    pairs = last.join(first, ["mask_id", "y", "cell"]).filter("a0 <= x1 AND x0 <= a1").select(
        "mask_id", F.greatest("p", "q").alias("u"), F.least("p", "q").alias("v")).filter("u <> v").distinct()
    return cut_lineage(local.join(contracted(pairs), ["mask_id", "label"], "left").withColumn(
        "label", F.coalesce("root", "label")).select(*RUN, "label"))


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("mask_id", "w", "h", "label").agg(F.sum(_length()).alias("area"))


def _keep(labels: DataFrame, which: DataFrame) -> DataFrame:
    return labels.join(which.select("mask_id", "label"), ["mask_id", "label"], "left_semi").select(*RUN)


def _limit(min_area: Column | int) -> Column:
    return F.lit(min_area) if isinstance(min_area, int) else min_area


def without_small(runs: DataFrame, min_area: Column | int = MIN_COMPONENT_AREA, band: int = BAND) -> DataFrame:
    """Drop components with fewer than ``min_area`` pixels (a number or an expression in ``w``, ``h``)."""
    labels = labelled(runs, band)
    return _keep(labels, component_sizes(labels).filter(F.col("area") >= _limit(min_area)))


def filled_holes(masks: DataFrame, runs: DataFrame, min_area: Column | int, band: int = BAND) -> DataFrame:
    """Set the components of the complement with fewer than ``min_area`` pixels."""
    around = labelled(complement(masks, runs), band)
    return united_runs(runs, _keep(around, component_sizes(around).filter(F.col("area") < _limit(min_area))))


def touching_points(runs: DataFrame, points: DataFrame, min_area: Column | int | None = None, band: int = BAND) -> DataFrame:
    """Keep components that hold one of the mask's ``points(mask_id, px, py)``, rounded to pixels.

    Where no point hits, the largest component stays (of equals the later in row order). Masks without any point are left
    whole. ``min_area`` then drops small components in the same pass.
    """
    labels = labelled(runs, band)
    spots = points.select("mask_id", round_half_up(F.col("px")).cast("int").alias("x"), round_half_up(F.col("py")).cast("int").alias("y")).distinct()
    hit = _in_cells(labels).join(spots.withColumn("cell", F.floor(F.col("x") / CELL)), ["mask_id", "y", "cell"]).filter(
        "x BETWEEN x0 AND x1").select("mask_id", "label").distinct()
    sizes = component_sizes(labels)
    asked = points.select("mask_id").distinct()
    missed = asked.join(hit.select("mask_id").distinct(), "mask_id", "left_anti")
    largest = sizes.join(missed, "mask_id", "left_semi").groupBy("mask_id").agg(F.max_by("label", F.struct("area", "label")).alias("label"))
    chosen = sizes.join(asked, "mask_id", "left_anti").unionByName(
        sizes.join(hit.unionByName(largest), ["mask_id", "label"], "left_semi"))
    if min_area is not None:
        chosen = chosen.filter(F.col("area") >= _limit(min_area))
    return _keep(labels, chosen)


def run_boxes(masks: DataFrame, runs: DataFrame) -> DataFrame:
    """Tight box and area per mask; an empty mask gets zeros."""
    found = runs.groupBy("mask_id").agg(F.min("x0").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), F.max("y").alias("y1"),
                                        F.sum(_length()).alias("n"))
    zero = F.lit(0)
    return masks.select("mask_id").join(found, "mask_id", "left").select(
        "mask_id", F.coalesce("x0", zero).alias("x"), F.coalesce("y0", zero).alias("y"), F.coalesce(F.col("x1") - F.col("x0") + 1, zero).alias("w"),
        F.coalesce(F.col("y1") - F.col("y0") + 1, zero).alias("h"), F.coalesce("n", zero).alias("area"))


def edge_coverage(runs: DataFrame, margin: Column | None = None) -> DataFrame:
    """Area share, box, and how full the strip along each side of the frame is."""
    m = M.edge_margin(F.col("w"), F.col("h")) if margin is None else margin
    top, left = F.least(m, F.col("h")), F.least(m, F.col("w"))
    bottom, right = F.greatest(F.lit(0), F.col("h") - m), F.greatest(F.lit(0), F.col("w") - m)

    def within(low: Column, high: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("x1"), high) - F.greatest(F.col("x0"), low) + 1)

    counted = runs.groupBy("mask_id", "w", "h").agg(
        F.sum(_length()).alias("area"), F.min("x0").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), F.max("y").alias("y1"),
        F.sum(F.when(F.col("y") < top, _length()).otherwise(0)).alias("n_top"), F.sum(F.when(F.col("y") >= bottom, _length()).otherwise(0)).alias("n_bottom"),
        F.sum(within(F.lit(0), left - 1)).alias("n_left"), F.sum(within(right, F.col("w") - 1)).alias("n_right"))
    return M.edge_shares(counted, m)
