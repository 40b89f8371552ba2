"""Greedy non-maximum suppression of scored boxes, per document.

Boxes are visited by falling score; a box stays when its IoU with every box kept so far is at
most the threshold. Two plans give the same result:

* documents of at most ``array_limit`` boxes are folded as one sorted array per document;
* larger documents never meet in one task. Boxes are grouped by the block of their document they begin in; a group
  also sees the boxes around it that may overlap its own, folds its leading boxes by score, and leaves open what
  hangs on a box that another group has yet to decide. What is left goes into larger blocks in the next round.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from maskloom.functions import boxes as B
from maskloom.session import cut_lineage

# Fixed value: overlap above which the lower-scored automatic segment goes.
AUTO_SEGMENT_IOU = 0.7

#: Leading boxes of a group that one round folds; sides of a block, in box sizes as a power of two, and its growth by round.
LEADING, BLOCK_SIDE, GROWTH = 2048, 4, 3

BOX_COLUMNS = ["document_id", "region_id", "x", "y", "w", "h", "score"]
_TILE = ["document_id", "level_x", "tile_x", "level_y", "tile_y"]


def keep_non_overlapping(
    regions: DataFrame,
    iou_threshold: float = AUTO_SEGMENT_IOU,
    array_limit: int = 512,
    frontier: int = LEADING,
) -> DataFrame:
    """Rows of ``regions`` that survive; ties in score go to the smaller ``region_id``."""
    kept = surviving_boxes(regions.select(*BOX_COLUMNS), iou_threshold, array_limit, frontier)
    return regions.join(kept.select("document_id", "region_id"), ["document_id", "region_id"], "left_semi")


def surviving_boxes(
    boxes: DataFrame, iou_threshold: float, array_limit: int = 512, frontier: int = LEADING
) -> DataFrame:
    """As :func:`keep_non_overlapping`, but with the box columns only and no join back."""
    if iou_threshold <= 0:
        raise ValueError("the IoU threshold must be positive")
    if iou_threshold >= 1:
        return boxes  # IoU never exceeds 1
    small, large = _by_size(boxes, array_limit)
    folded = _fold_arrays(small, iou_threshold)
    return folded if large is None else folded.unionByName(_group_rounds(large, iou_threshold, frontier))


def surviving_in_place(
    boxes: DataFrame, iou_threshold: float, again: bool, near: Column, far: Column, array_limit: int = 512, frontier: int = LEADING
) -> DataFrame:
    """:func:`surviving_boxes` where new boxes (``fresh``) meet those that stand, each box judged, dealt out and told apart in one shuffle.

    ``near`` is a place that follows from the document, ``far`` one that spreads a crowded document; rows are dealt out by ``place``.
    Documents without a new box stay as they are, and so do boxes that stand without a document. If there may be boxes that stand
    (``again``), a new box that goes but has the id of one that stays is returned too, as a ``copy``.
    """
    if iou_threshold <= 0:
        raise ValueError("the IoU threshold must be positive")
    if iou_threshold >= 1:
        return boxes.withColumns({"place": near, "copy": F.lit(False)}).repartition("place")
    small, large = _by_size(boxes, array_limit)
    folded = _fold_in_place(small, iou_threshold, again, near)
    return folded if large is None else folded.unionByName(_rounds_in_place(large, iou_threshold, again, far, frontier))


def _fold_in_place(boxes: DataFrame, t: float, again: bool, near: Column) -> DataFrame:
    apart = F.col("document_id").isNull() & ~F.col("fresh")
    arrays = boxes.withColumn("place", near).repartition("place").groupBy("place", "document_id", apart.alias("apart")).agg(_sorted_boxes("fresh").alias("b"))
    kept = arrays.select("place", "document_id", "b", F.when(F.exists("b", lambda e: e["fresh"]), _folded(t)).otherwise(F.col("b")).alias("kept"))

    def told(boxes: Column | str, copy: bool) -> Column:
        return F.transform(boxes, lambda k: F.struct(*[k[c].alias(c) for c in (*BOX_COLUMNS[1:], "fresh")], F.lit(copy).alias("copy")))

    out = told("kept", False)
    if again:
        copies = F.filter("b", lambda e: e["fresh"] & F.exists("kept", lambda k: k["region_id"] == e["region_id"])
                          & ~F.exists("kept", lambda k: k["n"] == e["n"]))
        repeated = F.size(F.array_distinct(F.col("b.region_id"))) < F.size("b")
        out = F.when(repeated, F.concat(out, told(copies, True))).otherwise(out)
    return kept.select("place", "document_id", F.explode_outer(out).alias("k")).select(
        "document_id", *[F.col(f"k.{c}").alias(c) for c in (*BOX_COLUMNS[1:], "fresh", "copy")], "place")


def _rounds_in_place(boxes: DataFrame, t: float, again: bool, far: Column, leading: int) -> DataFrame:
    cols, on, flags = BOX_COLUMNS, ["document_id", "region_id"], lambda fresh, copy: {"fresh": F.lit(fresh), "copy": F.lit(copy)}
    if not again:
        out = _group_rounds(boxes.select(*cols), t, leading).withColumns(flags(True, False))
    else:
        new = boxes.filter("fresh").select(*cols)
        mine = new.select("document_id").distinct()
        kept = cut_lineage(_group_rounds(boxes.select(*cols).join(mine, "document_id", "left_semi"), t, leading))
        out = kept.withColumns(flags(False, False)).unionByName(
            boxes.select(*cols).join(mine, "document_id", "left_anti").withColumns(flags(False, False))).unionByName(
            new.join(kept.select(*on), on, "left_semi").select(*cols).withColumns(flags(True, True)))
    return out.withColumn("place", far).repartition("place")


def _by_size(boxes: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Boxes of documents with at most ``limit`` boxes, and of the others if there are any."""
    big = boxes.groupBy("document_id").count().filter(F.col("count") > limit).select("document_id")
    if big.isEmpty():
        return boxes, None
    return boxes.join(big, "document_id", "left_anti"), boxes.join(big, "document_id", "left_semi")


def _sorted_boxes(*more: str) -> Column:
    """The boxes of a group in their order, with the columns ``more`` and their number ``n`` if there are any."""
    # What follows from a box is added behind the shuffle.
    entry = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("o"), "region_id", "x", "y", "w", "h", *more)))

    def whole(b: Column, *n: Column) -> Column:
        return F.struct(
            *[b[c].alias(c) for c in ("region_id", "x", "y", "w", "h")], (-b["o"]).alias("score"), (b["x"] + b["w"]).alias("right"),
            (b["y"] + b["h"]).alias("bottom"), (b["w"] * b["h"]).alias("area"), *[b[c].alias(c) for c in more], *[i.alias("n") for i in n])

    return F.transform(entry, (lambda b, i: whole(b, i)) if more else (lambda b: whole(b)))


def _folded(t: float) -> Column:
    """The boxes that stay of the sorted array ``b``."""
    def clash(a: Column, b: Column) -> Column:
        dx = F.least(a["right"], b["right"]) - F.greatest(a["x"], b["x"])
        dy = F.least(a["bottom"], b["bottom"]) - F.greatest(a["y"], b["y"])
        return (dx > 0) & (dy > 0) & (dx * dy / (a["area"] + b["area"] - dx * dy) > F.lit(t))

    return F.aggregate(
        "b",
        F.slice("b", 1, 0),
        lambda kept, b: F.when(F.exists(kept, lambda a: clash(a, b)), kept).otherwise(F.concat(kept, F.array(b))),
    )


def _fold_arrays(boxes: DataFrame, t: float) -> DataFrame:
    folded = boxes.groupBy("document_id").agg(_sorted_boxes().alias("b")).select("document_id", _folded(t).alias("kept"))
    # The outer explode keeps the optimizer from testing, and so computing, the folded array twice.
    return folded.select("document_id", F.explode_outer("kept").alias("k")).select(
        "document_id", *[F.col(f"k.{c}").alias(c) for c in BOX_COLUMNS[1:]]
    )


def _size_class(v: Column) -> Column:
    """floor(log2(v)) for v >= 1, else 0, from the bit length, so exact at powers of two."""
    return F.when(v >= 1, F.length(F.bin(F.floor(v))) - 1).otherwise(F.lit(0)).cast("int")


def _spread(df: DataFrame, t: float) -> DataFrame:
    """One row per tile a box takes part in.

    IoU > t bounds the ratio of widths and of heights by 1/t, so two such boxes differ by at most
    ``reach`` size classes per axis and meet in tiles of the larger class.
    """
    reach = math.ceil(math.log2(1 / t))

    def keys(lo: str, size: str, cls: str) -> Column:
        levels = F.sequence(F.col(cls), F.col(cls) + F.lit(reach))
        return F.flatten(F.transform(
            levels,
            lambda k: F.transform(
                F.sequence(
                    F.floor(F.col(lo) / F.pow(F.lit(2.0), k)),
                    F.floor((F.col(lo) + F.col(size)) / F.pow(F.lit(2.0), k)),
                ),
                lambda i: F.struct(k.alias("level"), i.alias("tile")),
            ),
        ))

    return (
        df.withColumn("kx", keys("x", "w", "class_x"))
        .withColumn("ky", keys("y", "h", "class_y"))
        .withColumn("n_tiles", F.size("kx") * F.size("ky"))
        .withColumn("kx", F.explode("kx"))
        .withColumn("ky", F.explode("ky"))
        .select(
            "*", F.col("kx.level").alias("level_x"), F.col("kx.tile").alias("tile_x"),
            F.col("ky.level").alias("level_y"), F.col("ky.tile").alias("tile_y"),
        )
        .drop("kx", "ky")
    )


def _box(p: str) -> Column:
    return B.box(F.col(f"{p}.x"), F.col(f"{p}.y"), F.col(f"{p}.w"), F.col(f"{p}.h"))


def _meet(t: float) -> Column:
    """Boxes ``a`` and ``b`` share a tile and overlap by more than ``t``; true in exactly one tile."""
    same_tile = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in _TILE]
    cond = same_tile[0]
    for c in same_tile[1:]:
        cond = cond & c
    for axis in ("x", "y"):
        level = F.greatest(F.col(f"a.class_{axis}"), F.col(f"b.class_{axis}"))
        corner = F.greatest(F.col(f"a.{axis}"), F.col(f"b.{axis}"))
        cond = cond & (F.col(f"a.level_{axis}") == level)
        cond = cond & (F.col(f"a.tile_{axis}") == F.floor(corner / F.pow(F.lit(2.0), level)))
    return cond & (B.iou(_box("a"), _box("b")) > F.lit(t))


def _in_groups(df: DataFrame, t: float, side: int) -> DataFrame:
    """One row per group a box is in: its own (``own``), and those whose boxes it may overlap by more than ``t``.

    A group is the boxes of one size class per axis that begin in one block of ``2^side`` box sizes. Boxes that overlap by more
    than ``t`` differ by at most ``reach`` classes per axis, and a box of class k is less than ``2^(k + 1)`` wide.
    """
    reach = math.ceil(math.log2(1 / t))

    def keys(lo: str, size: str, cls: str) -> Column:
        levels = F.sequence(F.greatest(F.col(cls) - reach, F.lit(0)), F.col(cls) + reach)
        return F.flatten(F.transform(levels, lambda k: F.transform(
            F.sequence(F.floor((F.col(lo) - F.pow(F.lit(2.0), k + 1)) / F.pow(F.lit(2.0), k + side)),
                       F.floor((F.col(lo) + F.col(size)) / F.pow(F.lit(2.0), k + side))),
            lambda i: F.struct(k.alias("level"), i.alias("tile")))))

    def own(axis: str, cls: str) -> Column:
        return (F.col(f"level_{axis}") == F.col(cls)) & (F.col(f"tile_{axis}") == F.floor(F.col(axis) / F.pow(F.lit(2.0), F.col(cls) + side)))

    return (
        df.withColumn("kx", F.explode(keys("x", "w", "class_x"))).withColumn("ky", F.explode(keys("y", "h", "class_y")))
        .select("*", F.col("kx.level").alias("level_x"), F.col("kx.tile").alias("tile_x"), F.col("ky.level").alias("level_y"), F.col("ky.tile").alias("tile_y"))
        .drop("kx", "ky").withColumn("own", own("x", "class_x") & own("y", "class_y"))
    )


def _folding(t: float):
    """Fold one group's leading boxes, rows sorted by ``r``; returns the own boxes that are surely kept.

    A box goes if a kept one overlaps it. It waits if it is not the group's own, or if a waiting one before it overlaps it: that one
    may yet be kept. Otherwise all before it that overlap it are gone, and it is kept.
    """
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("r")
        x, y, w, h = (pdf[c].to_numpy(float) for c in ("x", "y", "w", "h"))
        own = pdf["own"].to_numpy(bool)
        held = {True: np.zeros((5, len(x))), False: np.zeros((5, len(x)))}  # kept, waiting: left, top, right, bottom, area
        count, keep = {True: 0, False: 0}, np.zeros(len(x), bool)

        def meets(kind: bool, i: int) -> bool:
            left, top, right, bottom, area = held[kind][:, :count[kind]]
            dx = np.minimum(right, x[i] + w[i]) - np.maximum(left, x[i])
            dy = np.minimum(bottom, y[i] + h[i]) - np.maximum(top, y[i])
            hit = (dx > 0) & (dy > 0)
            inter = dx[hit] * dy[hit]
            return bool((inter / (area[hit] + w[i] * h[i] - inter) > t).any())

        for i in range(len(x)):
            if meets(True, i):
                continue
            keep[i] = own[i] and not meets(False, i)
            held[bool(keep[i])][:, count[bool(keep[i])]] = x[i], y[i], x[i] + w[i], y[i] + h[i], w[i] * h[i]
            count[bool(keep[i])] += 1
        return pdf.loc[keep, ["document_id", "region_id"]]
    return fold


def _group_rounds(boxes: DataFrame, t: float, leading: int) -> DataFrame:
    """Rounds over groups of boxes; the number of rounds grows with the longest chain of decisions divided by ``leading``."""
    whole = (F.col("w") > 0) & (F.col("h") > 0) & F.col("x").isNotNull() & F.col("y").isNotNull()
    flat = ~F.coalesce(whole, F.lit(False))
    kept = [boxes.filter(flat)]  # a box without area, or with an unknown side, overlaps nothing
    # Of equal boxes only the leading one can stay; this also dissolves heaps of copies early.
    geometry = ["document_id", "x", "y", "w", "h"]
    open_boxes = cut_lineage(
        boxes.filter(~flat)
        .groupBy(*geometry)
        .agg(F.min(F.struct((-F.col("score")).alias("o"), "region_id")).alias("ord"))
        .withColumn("class_x", _size_class(F.col("w")))
        .withColumn("class_y", _size_class(F.col("h")))
    )
    ident, side = ["document_id", "ord"], BLOCK_SIDE
    schema = boxes.select("document_id", "region_id").schema
    while not open_boxes.isEmpty():
        # The rank limit is applied before the shuffle as well, so a crowded group sends few rows per map task.
        in_group = Window.partitionBy(*_TILE).orderBy("ord")
        lead = _in_groups(open_boxes, t, side).withColumn("r", F.row_number().over(in_group)).filter(F.col("r") <= leading)
        sure = lead.select(*_TILE, "r", "own", *geometry[1:], F.col("ord.region_id").alias("region_id")).groupBy(
            *_TILE).applyInPandas(_folding(t), schema)
        won = cut_lineage(open_boxes.withColumn("region_id", F.col("ord.region_id")).join(
            sure, ["document_id", "region_id"], "left_semi").drop("region_id"))
        kept.append(won.select(
            "document_id", F.col("ord.region_id").alias("region_id"), "x", "y", "w", "h",
            (-F.col("ord.o")).alias("score"),
        ))
        # Kept boxes hardly overlap each other, so few of them share a tile; the crowded side of
        # this join is only probed, never multiplied.
        beaten = (
            _spread(open_boxes, t).alias("a")
            .join(_spread(won, t).alias("b"), _meet(t), "left_semi")
            .select(*ident).distinct()
        )
        open_boxes = cut_lineage(
            open_boxes.join(won.select(*ident), ident, "left_anti").join(beaten, ident, "left_anti")
        )
        side += GROWTH
    out = kept[0]
    for k in kept[1:]:
        out = out.unionByName(k)
    return out


def pair_with_keeper(
    regions: DataFrame, kept: DataFrame, iou_threshold: float, array_limit: int = 512
) -> DataFrame:
    """For every dropped box the leading kept box that overlaps it too much, with their IoU.

    Small documents join on the document. In crowded ones both sides are spread over tiles; kept
    boxes hardly overlap, so a tile holds few of them and a dropped box meets few.
    """
    kept = cut_lineage(kept.select(*BOX_COLUMNS))

    def lost(df: DataFrame) -> DataFrame:
        return df.join(kept.select("document_id", "region_id"), ["document_id", "region_id"], "left_anti")

    small, large = _by_size(regions.select(*BOX_COLUMNS), array_limit)
    overlap = B.iou(_box("a"), _box("b"))
    pairs = [lost(small).alias("a").join(
        kept.alias("b"), (F.col("a.document_id") == F.col("b.document_id")) & (overlap > F.lit(iou_threshold)))]
    if large is not None:
        def spread(df):
            sized = df.filter("w > 0 AND h > 0").withColumn("class_x", _size_class(F.col("w")))
            return _spread(sized.withColumn("class_y", _size_class(F.col("h"))), iou_threshold)

        near = kept.join(large.select("document_id").distinct(), "document_id", "left_semi")
        pairs.append(spread(lost(large)).alias("a").join(spread(near).alias("b"), _meet(iou_threshold)))

    def best(p: DataFrame) -> DataFrame:
        lead = F.min_by(
            F.struct(F.col("b.region_id").alias("keeper_id"), overlap.alias("iou")),
            F.struct((-F.col("b.score")).alias("o"), F.col("b.region_id").alias("i")),
        )
        return (
            p.groupBy(F.col("a.document_id").alias("document_id"), F.col("a.region_id").alias("region_id"))
            .agg(lead.alias("k")).select("document_id", "region_id", "k.keeper_id", "k.iou")
        )

    out = best(pairs[0])
    return out if len(pairs) == 1 else out.unionByName(best(pairs[1]))
