"""Constants and column expressions for rasters held in one record, row-major ``y * w + x``.

What goes over all values of a raster is in :mod:`maskloom.operators.raster_kernels`.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, functions as F

# Binarization of probabilities and logits, blur strength, offset of the stability
# measure, and the weights and limits of mask selection.
TEXT_PROBABILITY = 0.5
LOGIT_THRESHOLD = 1.0
BLUR_SIGMA = 1.0
STABILITY_OFFSET = 1.0
STABILITY_WEIGHT = 0.4
COMPACTNESS_WEIGHT = 0.4
MIN_COVERAGE = 0.001
SPARSE_FACTOR = 0.5
MIN_IOU = 0.65
MIN_STABILITY = 0.88
MIN_COMPACTNESS = 0.85

# Channel statistics of the models' training images, and luminance weights.
CHANNEL_MEAN = [0.485, 0.456, 0.406]
CHANNEL_STD = [0.229, 0.224, 0.225]
LUMINANCE = [0.299, 0.587, 0.114]


def quality(iou: Column, stable: Column, compact: Column, covered: Column) -> Column:
    whole = F.when(covered > MIN_COVERAGE, 1.0).otherwise(SPARSE_FACTOR)
    return iou * (1 + stable * STABILITY_WEIGHT + compact * COMPACTNESS_WEIGHT) * whole


def kernel(sigma: float) -> list[float]:
    """Normalized Gaussian weights for offsets ``-r .. r`` with ``r = ceil(3 sigma)``, in single precision."""
    r = math.ceil(3 * sigma)
    raw = np.exp(-(np.arange(-r, r + 1, dtype=float) ** 2) / (2 * sigma * sigma)).astype(np.float32)
    return [float(k) for k in (raw / raw.astype(float).sum()).astype(np.float32)]


def bit_at(bits: Column, i: Column) -> Column:
    """Is pixel ``i`` of packed bits set? Reads one byte."""
    byte = F.conv(F.hex(F.substring(bits, (F.floor(i / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (F.lit(7) - i % 8).cast("int")) == 1


def normalized_channel(value: Column, channel: int) -> Column:
    """(value / 255 - mean) / std of channel 0, 1, 2 = red, green, blue."""
    return (value / 255.0 - F.lit(CHANNEL_MEAN[channel])) / F.lit(CHANNEL_STD[channel])


def luminance(r: Column, g: Column, b: Column) -> Column:
    return F.floor(r * F.lit(LUMINANCE[0]) + g * F.lit(LUMINANCE[1]) + b * F.lit(LUMINANCE[2]) + F.lit(0.5))


def opacity(value: Column) -> Column:
    """Alpha of a mask value: opaque where the mask is set."""
    return F.when(value > 0, 255).otherwise(0)
