"""Region tables laid out so that a window reads few row groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Side of a cell of the curve in pixels, bits a coordinate has on it, and bytes of a row group.
CELL, BITS, ROW_GROUP = 16, 16, 8 << 20


def _spread(v: Column) -> Column:
    """The low 16 bits of ``v`` with a zero between any two."""
    out = v.cast("long").bitwiseAND(F.lit((1 << BITS) - 1))
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        out = out.bitwiseOR(F.shiftleft(out, shift)).bitwiseAND(F.lit(mask))
    return out


def morton_key(x: Column, y: Column, cell: int = CELL) -> Column:
    """Place on the space-filling curve of the cell that holds ``(x, y)``: the bits of both cell numbers in turn.

    Cells near each other are mostly near on the curve. Numbers beyond the curve's square are put at its edge; a null coordinate
    gives the first cell.
    """
    def number(v: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit((1 << BITS) - 1), F.coalesce(F.floor(v / cell), F.lit(0))))

    return _spread(number(x)).bitwiseOR(F.shiftleft(_spread(number(y)), 1))


def write_regions(regions: DataFrame, path: str, files: int | None = None, row_group: int = ROW_GROUP) -> None:
    """Write regions ``(document_id, region_id, x, y, w, h, ...)`` in the order of their centres on the curve.

    ``right`` and ``bottom`` are added, so that every side of a box has statistics. Ranges end in a hash of the ids: a crowded cell is
    cut into several files. ``files`` is their number (by default the shuffle partitions).
    """
    boxed = regions.withColumns({"right": F.col("x") + F.col("w"), "bottom": F.col("y") + F.col("h"),
                                 "morton": morton_key(F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2)})
    cut = F.xxhash64("document_id", "region_id")
    ranged = boxed.repartitionByRange(files, "morton", cut) if files else boxed.repartitionByRange("morton", cut)
    ranged.sortWithinPartitions("morton").write.mode("overwrite").option("parquet.block.size", row_group).parquet(path)


def regions_in_frame_window(spark: SparkSession, path: str, x: float, y: float, w: float, h: float) -> DataFrame:
    """Regions of any document that meet one window, edges included; all four conditions reach the scan and its statistics."""
    return spark.read.parquet(path).filter(
        (F.col("x") <= x + w) & (F.col("right") >= x) & (F.col("y") <= y + h) & (F.col("bottom") >= y)).drop("right", "bottom", "morton")
