"""Positions, slices, grids and reading order."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import TimestampType

# Rows closer than this read as one line; colours in the palette; points per batch
# and per side of the automatic segmentation grid.
LINE_HEIGHT = 10
PALETTE_SIZE = 8
POINTS_PER_BATCH = 8
POINTS_PER_SIDE = 8

#: Rows drawn to find where to cut an order into slices.
SAMPLE = 4096


def split_points(df: DataFrame, order: Sequence[Column], slices: int, sample: int = SAMPLE) -> list:
    """At most ``slices - 1`` rows of ``order`` values, ascending, that cut ``df`` into slices of about one size.

    One pass picks the row with the least hash in each of ``sample`` buckets, so at most so many are sorted and
    ``slices`` are collected, whatever the size of ``df``.
    """
    along = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(order)])
    hashed = df.select(along.alias("at"), F.xxhash64(*order).alias("h"))
    drawn = hashed.groupBy(F.pmod("h", F.lit(sample)).alias("bucket")).agg(F.min_by("at", "h").alias("at"), F.count("*").alias("n"))
    # Few rows a bucket: one task orders the sample, and every so manyth row of it is a split point.
    placed = drawn.select("at", F.row_number().over(Window.orderBy("at")).alias("nth"), F.count("*").over(Window.partitionBy()).alias("all"))
    step = F.greatest(F.lit(1), F.ceil(F.col("all") / slices))
    return [r["at"] for r in placed.filter((F.col("nth") % step == 0) & (F.col("nth") < F.col("all"))).orderBy("at").select("at").collect()]


def slice_number(df: DataFrame, order: Sequence[Column], points: list) -> Column:
    """How many of ``points`` lie at or before a row's ``order``, by halving: a few comparisons a row."""
    if not points:
        return F.lit(0)
    kinds = [f.dataType for f in df.select(*[c.alias(f"c{i}") for i, c in enumerate(order)]).schema]
    along = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(order)])
    fixed = [F.struct(*[F.lit(v).cast(t).alias(f"c{i}") for i, (v, t) in enumerate(zip(p, kinds))]) for p in points]

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(along < fixed[mid], between(low, mid)).otherwise(between(mid + 1, high))

    return between(0, len(points))


def _as_constants(df: DataFrame, order: Sequence[Column]) -> list[Column]:
    """``order`` with time stamps as numbers: as constants on the driver they would pass through its time zone."""
    fields = df.select(*[c.alias(f"c{i}") for i, c in enumerate(order)]).schema
    return [F.unix_micros(c) if isinstance(f.dataType, TimestampType) else c for c, f in zip(order, fields)]


def ordinal(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], coarse: Sequence[Column] | None = None,
    name: str = "position", slices: int | None = None,
) -> DataFrame:
    """Add the 1-based position of every row within ``keys`` along the ascending columns ``order``.

    Split points sampled from the whole of ``keys`` and ``order`` (by default one for each shuffle partition) cut the table
    into slices of about one size. Rows are numbered inside a slice; then the slices' counts, not the rows, are summed per
    key. A key that holds most of the table is so numbered in many tasks, also where its rows share all but the last
    column of ``order``. Only rows that are equal in all of ``order`` stay together, so end it with an id. Null keys are a group.

    Where the caller knows columns that grow with ``order`` and are fine enough, ``coarse`` names them and nothing is sampled.
    """
    if coarse is None:
        n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        whole = _as_constants(df, [*[F.col(k) for k in keys], *order])
        coarse = [slice_number(df, whole, split_points(df, whole, min(n, SAMPLE // 4)))]
    cuts = [f"_slice{i}" for i in range(len(coarse))]
    by = [*keys, *cuts]
    keyed = df.withColumns(dict(zip(cuts, coarse)))
    before = Window.partitionBy(*keys).orderBy(*cuts).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy(*by).agg(F.count("*").alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(by)], "_offset")
    )
    local = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_o{i}")) for i, c in enumerate(by)])
    return (
        keyed.withColumn("_local", local).join(offsets, same)
        .withColumn(name, F.col("_local") + F.col("_offset"))
        .drop("_local", "_offset", *cuts, *[f"_o{i}" for i in range(len(by))])
    )


def reading_order(regions: DataFrame, line_height: float = LINE_HEIGHT) -> DataFrame:
    """Number regions per document line by line, left to right.

    Lines are bands of ``line_height``: a pairwise "closer than ten pixels" rule is not transitive
    and would leave the order to the sort algorithm.
    """
    band = F.floor(F.col("y") / line_height)
    return ordinal(regions, ["document_id"], [band, F.col("x"), F.col("y"), F.col("region_id")], name="reading_position")


def top_to_bottom(regions: DataFrame) -> DataFrame:
    return ordinal(regions, ["document_id"], [F.col("y"), F.col("region_id")], name="layer_position")


def palette_index(regions: DataFrame, order: Sequence[Column], coarse: Sequence[Column] | None = None) -> DataFrame:
    """Colour slot by order of appearance, wrapping around the palette."""
    return ordinal(regions, ["document_id"], order, coarse, "appearance").withColumn(
        "colour", F.pmod(F.col("appearance") - 1, F.lit(PALETTE_SIZE))
    )


def point_grid(frames: DataFrame, side: int = POINTS_PER_SIDE) -> DataFrame:
    """``side`` x ``side`` evenly inset points per frame ``(width, height)``, in row order."""
    cells = F.sequence(F.lit(0), F.lit(side * side - 1))
    step = F.lit(side + 1)
    return (
        frames.withColumn("cell", F.explode(cells))
        .withColumn("px", (F.col("cell") % side + 1) * (F.col("width") / step))
        .withColumn("py", (F.floor(F.col("cell") / side) + 1) * (F.col("height") / step))
    )


def box_grid(boxes: DataFrame, side: int = 3) -> DataFrame:
    """Prompt points at equal fractions (25, 50, 75 %) of a dragged box, in row order."""
    return (
        boxes.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(side * side - 1))))
        .withColumn("px", F.col("x") + F.col("w") * ((F.col("cell") % side + 1) / F.lit(side + 1)))
        .withColumn("py", F.col("y") + F.col("h") * ((F.floor(F.col("cell") / side) + 1) / F.lit(side + 1)))
    )


def point_batches(points: DataFrame, total: Column, size: int = POINTS_PER_BATCH) -> DataFrame:
    """Batch number, batch count and progress of grid points processed in order of ``cell``."""
    return (
        points.withColumn("batch", F.floor(F.col("cell") / size))
        .withColumn("batches", F.ceil(total / size))
        .withColumn("progress", (F.col("cell") + 1) / total)
    )
