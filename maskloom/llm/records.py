"""The library's own records, as the given tables hold them, and helpers for Arrow batches of texts.

A *text region* is a detected region of type ``text``: ``region_id`` names it and ``original_text`` (an
entry of its metadata) is what was read. ``source_domain`` is the domain of its document. Operators take
a DataFrame of text regions, read only the columns they name and ignore every other column, so extra
columns may bear any name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from maskloom.session import fresh_dir

REGION_ID, TEXT = "region_id", "original_text"

#: ASCII white space, the separators of a word: blank, tab, line feed, vertical tab, form feed, return.
BLANKS = b" \t\n\x0b\x0c\r"
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_IS_BLANK = np.zeros(256, dtype=bool)
_IS_BLANK[list(BLANKS)] = True


def text_regions(documents: DataFrame) -> DataFrame:
    """Rows of the ``documents`` table as text regions."""
    return documents.select(F.col("doc_id").cast("bigint").alias(REGION_ID), F.col("text").alias(TEXT))


def texts_of_regions(detected_regions: DataFrame) -> DataFrame:
    """Rows of the library's region table as text regions: those of type ``text``, with what was read in them."""
    return detected_regions.filter(F.col("type") == "text").select(
        REGION_ID, F.try_element_at("metadata", F.lit("original_text")).alias(TEXT))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the folder all executors share and read it back: lineage ends at a durable table."""
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = 1 << 20) -> Iterator[tuple]:
    """Cut Arrow batches into row ranges whose texts hold about ``max_bytes`` (one row at least).

    Yields ``(rows, data, bounds)``: the rows as a RecordBatch, the bytes of their texts in one array and
    the ``len(rows) + 1`` places where each text begins and ends in it. A null text has no bytes.
    """
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
        n = len(texts)
        if not n:
            continue
        if texts.null_count:
            texts = texts.fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + n + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
        at = 0
        while at < n:
            to = int(np.searchsorted(offsets, offsets[at] + max_bytes, side="right")) - 1
            to = min(max(to, at + 1), n)
            yield batch.slice(at, to - at), data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
            at = to


def texts_of(data: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in ``data``, and where each text's words begin among them."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    blank = _IS_BLANK[data]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, blank[:-1]
    before[inner] = True
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, blank[1:]
    after[inner - 1] = True
    starts = np.flatnonzero(~blank & before)
    return starts, np.flatnonzero(~blank & after) + 1, np.searchsorted(starts, bounds)


_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; a bijection."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from one running polynomial over ``data``."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _power_table(len(data) + 1)
    run = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=run[1:])
    return mixed((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64))
