"""Kernels on whole rasters in Arrow batches: blur, scores, bilinear upsampling to row runs, packed bits.

A raster ``v`` is an array in row order of ``w`` x ``h`` values in its record, so none of these shuffles anything. Rasters of one
size are handled together, ``VALUES`` numbers at a time. A missing value (null, or an array that is too short) is below
every limit; NaN is above, as Spark orders it. Values beyond ``w * h`` are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType, IntegerType, StructField, StructType

from maskloom.functions import rasters as R

#: Values held at a time in double precision; what stands for a missing one (finite, so that a weight of 0 takes it out).
VALUES, MISSING = 1 << 20, -1e300


def _stacks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of a batch and their rasters as one array ``(rows, h, w)``, size by size; rows without a size are left out."""
    v = batch.column(batch.schema.get_field_index("v"))
    flat = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
    if v.values.null_count:
        flat[v.values.is_null().to_numpy(zero_copy_only=False)] = MISSING
    starts, lengths = v.offsets.to_numpy()[:-1].astype(np.int64), np.diff(v.offsets.to_numpy())
    lengths = np.where(v.is_valid().to_numpy(zero_copy_only=False), lengths, 0)
    sides = [batch.column(batch.schema.get_field_index(c)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("w", "h")]
    sizes = np.stack(sides, axis=1)
    for w, h in np.unique(sizes[(sizes > 0).all(axis=1)], axis=0).tolist():
        rows = np.flatnonzero((sizes == (w, h)).all(axis=1))
        step = max(VALUES // (w * h), 1)
        for at in range(0, len(rows), step):
            part = rows[at:at + step]
            index = np.arange(w * h)
            there = index < lengths[part][:, None]
            place = np.where(there, starts[part][:, None] + index, 0)
            values = np.where(there, flat[place] if len(flat) else 0.0, MISSING)
            yield part, values.reshape(len(part), h, w)


def _mapped(rasters: DataFrame, new: list[StructField], kernel: Callable[[np.ndarray], list[np.ndarray]], drop: tuple[str, ...] = ("v",)) -> DataFrame:
    """``rasters`` without ``drop`` and with the columns that ``kernel`` makes of a stack of rasters; rows without a size get nulls."""
    kept = [f for f in rasters.schema if f.name not in (*drop, *(n.name for n in new))]
    schema = StructType([*kept, *new])
    types = [pa.binary() if isinstance(f.dataType, BinaryType) else None for f in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list] = [[None] * batch.num_rows for _ in new]
            for rows, stack in _stacks(batch):
                for column, values in zip(found, kernel(stack)):
                    for r, value in zip(rows.tolist(), values):
                        column[r] = value
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            made = [pa.array(c, t) if t else pa.array(c, _arrow(f)) for c, t, f in zip(found, types, new)]
            yield pa.RecordBatch.from_arrays([*columns, *made], names=schema.names)

    return rasters.mapInArrow(run, schema)


def _arrow(field: StructField) -> pa.DataType:
    kinds = {IntegerType: pa.int32(), DoubleType: pa.float64(), FloatType: pa.float32()}
    if isinstance(field.dataType, ArrayType):
        return pa.list_(kinds[type(field.dataType.elementType)])
    return kinds[type(field.dataType)]


def _above(stack: np.ndarray, limit: float) -> np.ndarray:
    return (stack > limit) | np.isnan(stack)


def _blurred_rows(stack: np.ndarray, weights: list[float]) -> np.ndarray:
    """Weighted neighbours along the last axis; beyond the edge the edge value repeats. Sums are double, results single precision."""
    r, n = len(weights) // 2, stack.shape[-1]
    padded = np.concatenate([np.repeat(stack[..., :1], r, axis=-1), stack, np.repeat(stack[..., -1:], r, axis=-1)], axis=-1)
    total = padded[..., :n] * weights[0]
    for k in range(1, len(weights)):
        total += padded[..., k:k + n] * weights[k]
    with np.errstate(over="ignore"):
        return total.astype(np.float32)


def blurred(rasters: DataFrame, sigma: float = R.BLUR_SIGMA) -> DataFrame:
    """Gaussian blur of array rasters ``(w, h, v, ...)``, along rows, then along columns; other columns stay."""
    weights = R.kernel(sigma)

    def kernel(stack: np.ndarray) -> list[np.ndarray]:
        along = _blurred_rows(stack, weights).astype(np.float64)
        down = _blurred_rows(np.ascontiguousarray(along.transpose(0, 2, 1)), weights).transpose(0, 2, 1)
        return [down.reshape(len(stack), -1)]

    return _mapped(rasters, [StructField("v", ArrayType(FloatType()))], kernel).select(*rasters.columns)


def raster_scores(rasters: DataFrame, offset: float = R.STABILITY_OFFSET) -> DataFrame:
    """``stability``, ``flips``, ``positives``, ``coverage`` and ``compactness`` in place of ``v``.

    Stability is the share of the loose mask (above ``-offset``) that stays in the strict one (above ``offset``), 0 without one.
    Flips are neighbours, along rows and along columns, on different sides of zero. Compactness is 1 less flips over four times
    the positives, 0 at least and for none.
    """
    def kernel(stack: np.ndarray) -> list[np.ndarray]:
        n, size = len(stack), stack[0].size
        on = _above(stack, 0.0)
        strict, loose, positives = (_above(stack, x).reshape(n, -1).sum(axis=1) for x in (offset, -offset, 0.0))
        flips = (on[:, :, 1:] != on[:, :, :-1]).reshape(n, -1).sum(axis=1) + (on[:, 1:] != on[:, :-1]).reshape(n, -1).sum(axis=1)
        stability = np.where(loose > 0, strict / np.maximum(loose, 1), 0.0)
        compactness = np.where(positives > 0, 1 - np.minimum(1.0, flips / np.maximum(positives * 4, 1)), 0.0)
        return [stability, flips, positives, positives / size, compactness]

    kinds = [("stability", DoubleType()), ("flips", IntegerType()), ("positives", IntegerType()), ("coverage", DoubleType()), ("compactness", DoubleType())]
    return _mapped(rasters, [StructField(n, k) for n, k in kinds], kernel)


def packed(rasters: DataFrame, limit: float) -> DataFrame:
    """``bits`` and ``n_set`` in place of ``v``: a bit for each pixel, set above ``limit``, in row order from the highest bit of a byte.

    A 256 x 256 raster has 8 KB of bits instead of 256 KB of values; :func:`maskloom.functions.rasters.bit_at` reads one.
    """
    def kernel(stack: np.ndarray) -> list:
        on = _above(stack, limit).reshape(len(stack), -1)
        return [[row.tobytes() for row in np.packbits(on, axis=1)], on.sum(axis=1)]

    return _mapped(rasters, [StructField("bits", BinaryType()), StructField("n_set", IntegerType())], kernel)


def summed_lines(rasters: DataFrame) -> DataFrame:
    """Summed-area table of array rasters by line: ``(mask_id, y, sums)``, where ``sums[x]`` adds up all values left of x in lines up to y.

    The sum over a box is ``sums[x1 + 1] - sums[x0]`` of its last line less that of the line above it. Missing values count 0.
    """
    schema = StructType([rasters.schema["mask_id"], StructField("y", IntegerType()), StructField("sums", ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("mask_id"))
            for rows, stack in _stacks(batch):
                n, h, w = stack.shape
                table = np.zeros((n, h, w + 1))
                table[:, :, 1:] = np.where(stack == MISSING, 0.0, stack).cumsum(axis=1).cumsum(axis=2)
                ends = pa.array(np.arange(n * h + 1, dtype=np.int32) * (w + 1))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(np.repeat(rows, h))), pa.array(np.tile(np.arange(h, dtype=np.int32), n)),
                     pa.ListArray.from_arrays(ends, pa.array(table.ravel()))], names=schema.names)

    return rasters.select("mask_id", "w", "h", "v").mapInArrow(run, schema)


def upsampled_runs(rasters: DataFrame, limit: float) -> DataFrame:
    """Bilinear upsampling of ``(mask_id, w, h, v, out_w, out_h)`` and threshold, as row runs ``(mask_id, w, h, y, x0, x1)``.

    Pixel x of the output lies at ``x / out_w * w`` of the input, and so for y. Output lines are made ``VALUES`` pixels at a time.
    """
    id_field = rasters.schema["mask_id"]
    schema = StructType([id_field, *[StructField(n, IntegerType()) for n in ("w", "h", "y", "x0", "x1")]])

    def lines(v: np.ndarray, width: int, height: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        h, w = v.shape
        at = np.arange(width) / width * w
        x0 = np.floor(at).astype(np.int64)
        x1, fx = np.minimum(x0 + 1, w - 1), at - x0
        step = max(VALUES // width, 1)
        for first in range(0, height, step):
            y = np.arange(first, min(first + step, height))
            at = y / height * h
            y0 = np.floor(at).astype(np.int64)
            y1, fy = np.minimum(y0 + 1, h - 1), (at - y0)[:, None]
            upper, lower = v[y0], v[y1]
            value = (upper[:, x0] * (1 - fx) + upper[:, x1] * fx) * (1 - fy) + (lower[:, x0] * (1 - fx) + lower[:, x1] * fx) * fy
            edge = np.diff(np.pad(_above(value, limit), ((0, 0), (1, 1))).astype(np.int8), axis=1)
            row, begins = np.nonzero(edge == 1)
            yield y[row], begins, np.nonzero(edge == -1)[1] - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("mask_id"))
            sides = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("out_w", "out_h")]
            for rows, stack in _stacks(batch):
                for r, v in zip(rows.tolist(), stack):
                    width, height = (int(s[r] or 0) for s in sides)
                    if width <= 0 or height <= 0:
                        continue
                    for y, x0, x1 in lines(v, width, height):
                        n = len(y)
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(pa.array(np.full(n, r))), *[pa.array(a.astype(np.int32)) for a in (np.full(n, width), np.full(n, height), y, x0, x1)]],
                            names=schema.names)

    return rasters.select("mask_id", "w", "h", "v", "out_w", "out_h").mapInArrow(run, schema)
