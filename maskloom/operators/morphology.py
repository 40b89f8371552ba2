"""Dilation and erosion of pixel tables by a square, in two passes along lines.

A pass works on one line of one mask at a time, so its window partitions are bounded by the frame
side. Only set pixels are shuffled: dilation grows spans after the shuffle and without
duplicates, erosion counts neighbours instead of visiting the background.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from maskloom.operators.masks import PIXEL


def _radius(r: Column | int) -> Column:
    return F.lit(r) if isinstance(r, int) else r


def _dilated_line(pixels: DataFrame, along: str, across: str, size: str, r: Column) -> DataFrame:
    line = Window.partitionBy("mask_id", across).orderBy(along)
    covered = F.coalesce(F.lag(along).over(line) + r + 1, F.lit(0))  # where the previous pixel's span ended
    spread = (
        pixels.withColumn("_from", F.greatest(F.col(along) - r, covered, F.lit(0)))
        .withColumn("_to", F.least(F.col(along) + r, F.col(size) - 1))
        .filter("_from <= _to")
        .withColumn(along, F.explode(F.sequence(F.col("_from").cast("int"), F.col("_to").cast("int"))))
    )
    return spread.select(*PIXEL)


def dilated(pixels: DataFrame, radius: Column | int) -> DataFrame:
    """Set all frame pixels within ``radius`` of a set one. ``radius`` may be an expression in ``w``, ``h``."""
    r = _radius(radius)
    rows = _dilated_line(pixels.select(*PIXEL), "x", "y", "w", r)
    return _dilated_line(rows, "y", "x", "h", r)


def _eroded_line(pixels: DataFrame, along: str, across: str, size: str, radius: Column | int) -> DataFrame:
    line = Window.partitionBy("mask_id", across).orderBy(along)
    if isinstance(radius, int):
        present = F.count("*").over(line.rangeBetween(-radius, radius))
        wanted = F.least(F.col(along) + radius, F.col(size) - 1) - F.greatest(F.col(along) - radius, F.lit(0)) + 1
        return pixels.withColumn("_n", present).filter(F.col("_n") == wanted).select(*PIXEL)
    # A radius that differs per mask cannot bound a window frame: measure the run a pixel is in.
    run = F.col(along) - F.row_number().over(line)
    spans = Window.partitionBy("mask_id", across, "_run")
    kept = (
        pixels.withColumn("_run", run)
        .withColumn("_lo", F.min(along).over(spans)).withColumn("_hi", F.max(along).over(spans))
        .filter((F.col("_lo") <= F.greatest(F.col(along) - radius, F.lit(0)))
                & (F.col("_hi") >= F.least(F.col(along) + radius, F.col(size) - 1)))
    )
    return kept.select(*PIXEL)


def eroded(pixels: DataFrame, radius: Column | int = 1) -> DataFrame:
    """Keep pixels whose whole neighbourhood inside the frame is set."""
    rows = _eroded_line(pixels.select(*PIXEL), "x", "y", "w", radius)
    return _eroded_line(rows, "y", "x", "h", radius)


def closed(pixels: DataFrame, radius: Column | int = 2) -> DataFrame:
    return eroded(dilated(pixels, radius), radius)


def opened(pixels: DataFrame, radius: Column | int = 2) -> DataFrame:
    return dilated(eroded(pixels, radius), radius)
