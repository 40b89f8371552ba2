"""Text quality by naive Bayes support vectors: log-count ratios scale n-gram indicators of a linear margin."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from maskloom.llm.records import LOWER, REGION_ID, TEXT, mixed, slices, span_hashes, word_spans

#: Log2 of the number of hashed n-gram features; bounds everything that reaches the driver.
FEATURE_BITS = 18
#: At most about this many labelled texts fit the margin. Counts use all labelled texts.
SAMPLE = 8000

_FORM = np.full(256, ord("?"), dtype=np.uint8)  # other signs, see below
_FORM[ord("0"):ord("9") + 1] = ord("0")
_FORM[ord("a"):ord("z") + 1] = ord("a")
_FORM[ord("A"):ord("Z") + 1] = ord("A")
_FORM[0x80:] = ord("a")
for _sign in b".,!?|#*$%&<>-_:;/@'\"()":
    _FORM[_sign] = _sign


def features(data: np.ndarray, bounds: np.ndarray, bits: int = FEATURE_BITS) -> list[np.ndarray]:
    """The distinct hashed n-grams of each text: words (n = 1, 2) and word forms (n = 1, 2, 3).

    The form of a word is its run of character kinds (``Aa``, ``a,``, ``a###``), or a mark of its own where
    the word equals the one before.
    """
    starts, ends, at = word_spans(data, bounds)
    words = span_hashes(LOWER[data], starts, ends)
    kinds = _FORM[data]
    new = np.ones(len(data), bool)
    new[1:] = kinds[1:] != kinds[:-1]
    new[starts] = True
    place = np.concatenate([[0], np.cumsum(new)])
    forms = span_hashes(kinds[new], place[starts], place[ends])
    first = np.zeros(len(starts), bool)
    first[at[:-1][at[:-1] < at[1:]]] = True
    again = np.zeros(len(starts), bool)
    again[1:] = words[1:] == words[:-1]
    forms[again & ~first] = np.uint64(1)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        w, f = words[a:b], forms[a:b]
        grams = np.concatenate([
            _salted(w, 1), _salted(_joined(w, 2), 2), _salted(f, 3), _salted(_joined(f, 2), 4), _salted(_joined(f, 3), 5)])
        out.append(np.unique(grams >> np.uint64(64 - bits)).astype(np.int64))
    return out


def _salted(x: np.ndarray, salt: int) -> np.ndarray:
    return mixed(x + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


def _joined(x: np.ndarray, n: int) -> np.ndarray:
    if len(x) < n:
        return x[:0]
    out = x[:len(x) - n + 1].copy()
    for k in range(1, n):
        out = out * np.uint64(0xD1342543DE82EF95) + x[k:len(x) - n + 1 + k]
    return out


@dataclass(frozen=True)
class QualityModel:
    """``ratios`` scale the indicators, ``weights`` and ``bias`` are the margin's, ``slope`` and ``shift`` its sigmoid's."""
    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, grams: np.ndarray) -> float:
        z = self.slope * _margin(self.ratios, self.weights, self.bias, grams) + self.shift
        return 1.0 / (1.0 + math.exp(-min(max(z, -500.0), 500.0)))


def _margin(ratios, weights, bias, grams) -> float:
    r = ratios[grams]
    norm = math.sqrt(float(r @ r))
    return bias + (float(r @ weights[grams]) / norm if norm else 0.0)


def fit_margin(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, cost: float = 1.0, epochs: int = 12) -> tuple:
    """Dual coordinate descent for the hinge loss with an L2 penalty; classes weigh the same in total."""
    w, bias = np.zeros(len(ratios)), 0.0
    y = np.where(labels == 1, 1.0, -1.0)
    upper = np.where(y > 0, cost * len(y) / (2 * max((y > 0).sum(), 1)), cost * len(y) / (2 * max((y < 0).sum(), 1)))
    x = []
    for grams in rows:
        r = ratios[grams]
        norm = math.sqrt(float(r @ r))
        x.append(r / norm if norm else r)
    alpha, order = np.zeros(len(rows)), np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            g, v = rows[i], x[i]
            square = float(v @ v) + 1.0
            step = min(max(alpha[i] - (y[i] * (float(v @ w[g]) + bias) - 1.0) / square, 0.0), upper[i]) - alpha[i]
            if step:
                alpha[i] += step
                w[g] += step * y[i] * v
                bias += step * y[i]
    return w, bias


def fit_sigmoid(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through margins, by Newton steps with smoothed targets."""
    up, down = float((labels == 1).sum()), float((labels != 1).sum())
    target = np.where(labels == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -50, 50)))
        d, h = p - target, p * (1 - p) + 1e-9
        g = np.array([d @ margins, d.sum()]) + np.array([1e-6 * a, 0])
        step = np.linalg.solve(np.array([[h @ margins ** 2 + 1e-6, h @ margins], [h @ margins, h.sum()]]), g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def fit_quality(labelled: DataFrame, sample: int = SAMPLE, bits: int = FEATURE_BITS) -> QualityModel:
    """Learn from ``region_id``, ``original_text``, ``quality`` (0 or 1); rows with another label are left out.

    Counts of all labelled rows give the log-count ratios: each task adds up its own texts and the sums are
    at most ``2 ** bits`` rows. The margin is fitted by one task on about ``sample`` texts, chosen by the hash
    of their id. Without both classes every score is the share of label 1, or 0.5 without any label.
    """
    spark = labelled.sparkSession
    rows = labelled.filter("quality IN (0, 1)").select(REGION_ID, TEXT, F.col("quality").cast("int").alias("quality"))
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, size + 1), dtype=np.int64)
        for part, data, bounds in slices(batches, TEXT):
            for label, grams in zip(part.column(2).to_pylist(), features(data, bounds, bits)):
                sums[label, grams] += 1
                sums[label, size] += 1
        for at in range(0, size + 1, 1 << 16):
            used = at + np.flatnonzero(sums[:, at:at + (1 << 16)].any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[0, used]), pa.array(sums[1, used])],
                                             names=["gram", "n0", "n1"])

    counted = (rows.mapInArrow(count, "gram long, n0 long, n1 long")
               .groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow())
    sums = np.zeros((2, size + 1))
    gram = counted.column("gram").to_numpy()
    sums[0, gram], sums[1, gram] = counted.column("n0").to_numpy(), counted.column("n1").to_numpy()
    texts, sums = sums[:, size], sums[:, :size]
    if not texts.all():
        share = (texts[1] + 1e-3) / (texts.sum() + 2e-3)
        return QualityModel(np.zeros(size), np.zeros(size), 0.0, 0.0, math.log(share / (1 - share)))
    smooth = sums + 1.0
    ratios = np.log(smooth[1] / smooth[1].sum()) - np.log(smooth[0] / smooth[0].sum())

    share = sample / texts.sum()
    draw = rows.select("quality", REGION_ID).filter(F.pmod(F.xxhash64(REGION_ID, F.lit(1)), F.lit(1 << 30)) < share * (1 << 30))
    drawn = F.broadcast(draw.limit(2 * sample).select(REGION_ID).distinct())
    shared = spark.sparkContext.broadcast(ratios)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, grams = [], []
        for part, data, bounds in slices(batches, TEXT):
            labels += part.column(2).to_pylist()
            grams += features(data, bounds, bits)
        ids = np.array(labels)
        margins = np.zeros(len(ids))
        for k in (0, 1):
            there, rest = np.flatnonzero(np.arange(len(ids)) % 2 == k), np.flatnonzero(np.arange(len(ids)) % 2 != k)
            w, bias = fit_margin([grams[i] for i in rest], ids[rest], shared.value)
            margins[there] = [_margin(shared.value, w, bias, grams[i]) for i in there]
        slope, shift = fit_sigmoid(margins, ids)
        w, bias = fit_margin(grams, ids, shared.value)
        used = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([[-3, -2, -1], used])), pa.array(np.concatenate([[bias, slope, shift], w[used]]))],
            names=["gram", "weight"])

    fitted = (rows.join(drawn, REGION_ID, "left_semi").select(REGION_ID, TEXT, "quality")
              .repartition(1).sortWithinPartitions(F.xxhash64(REGION_ID, F.lit(2)), TEXT, "quality")
              .mapInArrow(fit, "gram long, weight double").toArrow())
    gram, weight = fitted.column("gram").to_numpy(), fitted.column("weight").to_numpy()
    w = np.zeros(size)
    w[gram[3:]] = weight[3:]
    return QualityModel(ratios, w, *map(float, weight[:3]))


def score_quality(regions: DataFrame, model: QualityModel) -> DataFrame:
    """``region_id`` and ``score`` double: how likely the whole ``original_text`` has label 1, from 0 to 1.

    One row per row. A null or empty text scores what the margin's bias alone gives. Only the text counts.
    """
    from pyspark.sql.types import DoubleType, StructField, StructType

    shared = regions.sparkSession.sparkContext.broadcast(model)
    bits = int(math.log2(len(model.ratios)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part, data, bounds in slices(batches, TEXT):
            scores = [own.score(g) for g in features(data, bounds, bits)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], names=[REGION_ID, "score"])

    schema = StructType([regions.select(REGION_ID).schema[0], StructField("score", DoubleType(), False)])
    return regions.select(REGION_ID, TEXT).mapInArrow(score, schema)
