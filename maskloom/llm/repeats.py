"""Repeated passages: content-defined chunks by a gear hash, deduplicated by digest, cut from later texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from maskloom.llm.records import REGION_ID, TEXT, slices, span_hashes, word_spans, _IS_BLANK

#: The hash of the last 16 bytes decides on a cut: the least of any nine word ends in a row, so one in five, and one byte in 512.
WINDOW, WORD_ENDS, BYTE_SHARE = 16, 9, 512
#: A run of repeated chunks with fewer words stays.
MIN_WORDS = 20

_GEAR = np.random.default_rng(16091990).integers(0, 1 << 16, 256, dtype=np.uint16)


def _least_ends(h: np.ndarray, owner: np.ndarray, width: int = WORD_ENDS) -> np.ndarray:
    """Which word ends have the least hash, ties included, of some ``width`` ends in a row of one text."""
    n = len(h) - width + 1
    if n < 1:
        return np.zeros(len(h), bool)
    least = h[:n].astype(np.int32)
    for k in range(1, width):
        np.minimum(least, h[k:k + n], out=least)
    least[owner[:n] != owner[width - 1:]] = -1
    most = np.full(len(h), -1, np.int32)
    for k in range(width):
        np.maximum(most[k:k + n], least, out=most[k:k + n])
    return most == h


def chunk_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the chunks of each text, and where each text's chunks begin among them.

    Bit j of the 16-bit gear hash ``h = 2 h + gear[byte]`` depends on the last j + 1 bytes, so a cut depends on
    16 bytes and its neighbours only and chunks fall into step again right after an insertion. Of any ``WORD_ENDS``
    word ends in a row one at least is a cut, in periodic text too, where equal hashes are all cuts; the first and last such
    cut inside a passage, and all between, are the same wherever it stands. The rarer cuts elsewhere bound chunks of
    texts without white space. No cut parts a character.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    h, reach = _GEAR[data], 1
    while reach < WINDOW:
        h[reach:] += h[:-reach] << np.uint16(reach)
        reach *= 2
    cut = h < 65536 // BYTE_SHARE
    blank = _IS_BLANK[data]
    ends = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    owner = np.searchsorted(bounds, ends, side="right") - 1
    full = ends - bounds[owner] >= WINDOW - 1
    ends, owner = ends[full], owner[full]
    cut[ends[_least_ends(h[ends], owner)]] = True
    cut[:-1] &= (data[1:] & 0xC0) != 0x80
    begins = bounds[:-1][bounds[:-1] < bounds[1:]]
    for k in range(WINDOW - 1):  # the first bytes of a text have no full window of their own
        early = begins + k
        cut[early[early < len(data)]] = False
    cut[bounds[1:][bounds[:-1] < bounds[1:]] - 1] = True
    ends = np.flatnonzero(cut) + 1
    starts = np.concatenate([[0], ends[:-1]])
    return starts, ends, np.searchsorted(starts, bounds)


def _digests(data: np.ndarray, bounds: np.ndarray) -> tuple:
    starts, ends, at = chunk_spans(data, bounds)
    return starts, ends, at, span_hashes(data, starts, ends).view(np.int64)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, bounds in slices(batches, TEXT):
        _, _, at, digests = _digests(data, bounds)
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(at))
        order = np.lexsort((digests, owner))
        owner, digests = owner[order], digests[order]
        new = np.ones(len(digests), bool)
        new[1:] = (digests[1:] != digests[:-1]) | (owner[1:] != owner[:-1])
        yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(owner[new])), pa.array(digests[new])], names=["id", "digest"])


def repeated_runs(digests: np.ndarray, words: np.ndarray, elsewhere: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """Chunk ranges to cut from one text: runs of chunks seen before, here or in an earlier text, long enough."""
    _, first = np.unique(digests, return_index=True)
    seen = np.ones(len(digests), bool)
    seen[first] = False
    seen |= np.isin(digests, elsewhere)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], seen.astype(np.int8), [0]])))
    total = np.concatenate([[0], np.cumsum(words)])
    return [(a, b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()) if total[b] - total[a] >= min_words]


def cut_repeats(regions: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``regions`` with repeated passages cut from ``original_text``, and ``cuts`` array of (first, last).

    Each text is cut into chunks. The text with the smallest ``region_id`` keeps a chunk, and in it the first
    place; every other place is a repeat. A run of repeats that hold ``min_words`` words in all is cut; shorter
    runs, such as a common phrase or one shared line, stay. A passage loses at its two ends the chunk it shares
    with other words, some five words each. ``first`` and ``last`` count the characters of the text given.

    Every other column stays as it is; a column named ``cuts`` is replaced. A null or empty text stays. Rows with
    a null id are compared with nothing but themselves; ids are ordered as their type orders them. Rows that share an id are one text: they do not
    repeat each other. No rows give no rows.

    Digests have 64 bits; a false cut would take several equal digests in a row. The first text of a
    digest is a partial aggregate, and its join has one row per digest on that side, so a passage that a third
    of all texts share is split among tasks.
    """
    fields = [f for f in regions.schema if f.name != "cuts"]
    regions = regions.select(*[f"`{f.name}`" for f in fields])
    listed = regions.filter(F.col(REGION_ID).isNotNull()).select(REGION_ID, TEXT).mapInArrow(
        _listed, f"id {regions.schema[REGION_ID].dataType.simpleString()}, digest long")
    firsts = listed.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").drop("last")
    own = [f.name for f in fields]
    of = "_" * max(len(n) for n in own) + "of"  # no given column bears this name
    repeats = listed.join(firsts, "digest").filter("id > first").groupBy(F.col("id").alias(of)).agg(F.collect_set("digest").alias(f"{of}_"))
    joined = regions.join(repeats, F.col(REGION_ID) == F.col(of), "left").drop(of)
    place, names = own.index(TEXT), own + ["cuts"]
    pair = pa.struct([("first", pa.int64()), ("last", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, bounds in slices(batches, TEXT):
            starts, ends, at, digests = _digests(data, bounds)
            word_starts, _, _ = word_spans(data, bounds)
            words = np.diff(np.searchsorted(word_starts, np.concatenate([starts, ends[-1:]])))
            texts, cuts = rows.column(place).to_pylist(), []
            known = rows.column(len(fields))
            for i in range(len(texts)):
                a, b = at[i], at[i + 1]
                other = known[i].values.to_numpy() if known[i].is_valid else np.zeros(0, np.int64)
                runs = repeated_runs(digests[a:b], words[a:b], other, min_words) if b > a else []
                spans = [(int(starts[a + x]), int(ends[a + y - 1])) for x, y in runs]
                if spans:
                    kept, done, own = [], int(bounds[i]), []
                    for s, e in spans:
                        kept.append(data[done:s].tobytes())
                        done = e
                    kept.append(data[done:bounds[i + 1]].tobytes())
                    texts[i] = b"".join(kept).decode("utf-8", "replace")
                    letter = np.cumsum((data[bounds[i]:bounds[i + 1]] & 0xC0) != 0x80)
                    own = [{"first": int(letter[s - bounds[i]]) - 1, "last": int(letter[e - bounds[i] - 1])} for s, e in spans]
                    cuts.append(own)
                else:
                    cuts.append([])
            columns = rows.columns[:len(fields)]
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cuts, pa.list_(pair))], names=names)

    span = StructType([StructField("first", LongType()), StructField("last", LongType())])
    schema = StructType([StructField(f.name, StringType() if f.name == TEXT else f.dataType) for f in fields]
                        + [StructField("cuts", ArrayType(span))])
    return joined.mapInArrow(cut, schema)
