"""Periodic stretches in the text of regions: suffix classes united by falling common prefix."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from maskloom.llm.records import REGION_ID, TEXT, mixed, slices, span_hashes, texts_of, word_spans

#: Positions in one block of an ordered set.
BLOCK = 1024


class Positions:
    """An ordered set of positions in blocks, so that an insertion moves one block's entries at most."""

    def __init__(self, values: list[int]):
        self.blocks, self.heads, self.size = [values], [values[0]], len(values)

    def add(self, value: int) -> None:
        k = max(bisect_left(self.heads, value) - 1, 0)
        block = self.blocks[k]
        insort(block, value)
        self.heads[k] = block[0]
        self.size += 1
        if len(block) > BLOCK:
            self.blocks.insert(k + 1, block[BLOCK // 2:])
            self.heads.insert(k + 1, block[BLOCK // 2])
            del block[BLOCK // 2:]

    def around(self, value: int) -> tuple[int | None, int | None]:
        """The neighbours of ``value``, which is in the set."""
        k = bisect_left(self.heads, value)
        if k == len(self.heads) or self.heads[k] != value:
            k -= 1
        block = self.blocks[k]
        at = bisect_left(block, value)
        before = block[at - 1] if at else self.blocks[k - 1][-1] if k else None
        after = block[at + 1] if at + 1 < len(block) else self.heads[k + 1] if k + 1 < len(self.heads) else None
        return before, after

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block


def repeated_windows(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Texts (places in ``at``) in which some window of ``width`` words stands twice, by 64-bit hashes of windows.

    ``width`` is a power of two. Hashes can only say too much: what they name is looked at exactly.
    """
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    window, step = words, 1
    while step < width and len(window) > step:
        window = mixed(window[:-step] * np.uint64(0x9E3779B97F4A7C15) + window[step:])
        step *= 2
    if step < width:
        return np.zeros(0, np.int64)
    own = owner[:len(window)] == owner[len(words) - len(window):]
    owner = owner[:len(window)][own]
    key = window[own] ^ mixed(owner.astype(np.uint64) + np.uint64(1))
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    return np.unique(owner[np.isin(key, twice)])


def suffix_order(words: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes of one text in an order in which common prefixes stand together, by prefix doubling.

    Also the class of every position at each width 1, 2, 4, ...: two positions have one class if their next ``width``
    words are the same. Only positions that still share a class are sorted again.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    sorted_words = words[order]
    fresh = np.concatenate([[True], sorted_words[1:] != sorted_words[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    levels, width = [rank.astype(np.int32)], 1
    while True:
        sizes = np.bincount(rank, minlength=n)
        open_ = np.flatnonzero(sizes[rank[order]] > 1)  # places in the order whose class has others
        if not len(open_):
            return order, levels
        subject = order[open_]
        behind = np.full(len(subject), -1, np.int64)
        inside = subject + width < n
        behind[inside] = rank[subject[inside] + width]
        head = rank[subject]
        new = np.lexsort((behind, head))
        subject, head, behind = subject[new], head[new], behind[new]
        order[open_] = subject
        fresh = np.concatenate([[True], (head[1:] != head[:-1]) | (behind[1:] != behind[:-1])])
        rank = rank.copy()
        rank[subject] = open_[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        levels.append(rank.astype(np.int32))
        width *= 2


def common_prefixes(order: np.ndarray, levels: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places k where suffixes k and k + 1 of ``order`` share ``least`` words or more, and how many they share."""
    n = len(order)
    first, second = order[:-1].astype(np.int64), order[1:].astype(np.int64)
    place = np.arange(n - 1)
    shared = np.zeros(n - 1, np.int64)
    floor = min(int(least).bit_length() - 1, len(levels) - 1)
    same = levels[floor][first] == levels[floor][second]  # drops nearly all pairs before the search
    first, second, place, shared = first[same], second[same], place[same], shared[same]
    for k in range(len(levels) - 1, -1, -1):
        p, q = first + shared, second + shared
        fits = (p < n) & (q < n)
        fits[fits] = levels[k][p[fits]] == levels[k][q[fits]]
        shared[fits] += 1 << k
    enough = shared >= least
    return place[enough], shared[enough]


def runs_of_words(words: np.ndarray, least_length: int = 24, least_exponent: int = 3) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run of the text ``words`` (equal numbers are equal words), by start and period.

    Suffixes that share a prefix are a class. Classes are united by falling length l of what they share
    (Kruskal's order, with union-find), and each keeps its positions in order, the smaller set being
    put into the larger. Two positions i < j that become neighbours in a class at a distance q <= l begin a stretch
    of period q which ends after l + q words: q is its smallest period, as a smaller one would have put a position
    between them earlier, and l is exact, so it cannot go on at the right. It is a run if it cannot go on at the left either.
    """
    least = max(least_length - least_length // least_exponent, 1)
    if len(words) < least_length:
        return []
    order, levels = suffix_order(words)
    place, shared = common_prefixes(order, levels, least)
    if not len(place):
        return []
    falling = np.argsort(-shared, kind="stable")
    names = levels[0].tolist()
    # Only suffixes at either side of such a place belong to a class of more than one.
    members = np.unique(np.concatenate([place, place + 1]))
    left = np.searchsorted(members, place)[falling].tolist()
    positions = order[members].tolist()
    parent = list(range(len(members)))
    sets: list = [None] * len(members)
    found = []

    def seed(i: int, j: int, l: int) -> None:
        q = j - i
        if q <= l and l + q >= least_length and l + q >= least_exponent * q and (i == 0 or names[i - 1] != names[j - 1]):
            found.append((i, l + q, q))

    for k, l in zip(left, shared[falling].tolist()):
        a, b = k, k + 1
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        large, small = sets[a], sets[b]
        if large is None and small is None:  # two single positions, by far the most frequent case
            i, j = positions[a], positions[b]
            if i > j:
                i, j = j, i
            parent[b] = a
            sets[a] = Positions([i, j])
            seed(i, j, l)
            continue
        large = large or Positions([positions[a]])
        small = small or Positions([positions[b]])
        if large.size < small.size:
            a, b, large, small = b, a, small, large
        parent[b] = a
        sets[a], sets[b] = large, None
        moved = list(small)
        for x in moved:
            large.add(x)
        last = None
        for x in moved:
            before, after = large.around(x)
            if before is not None and before != last:
                seed(before, x, l)
            last = x
            if after is not None and not (len(moved) > 1 and _holds(moved, after)):
                seed(x, after, l)
    return sorted((s, n, q) for s, n, q in found)


def _holds(values: list[int], value: int) -> bool:
    at = bisect_left(values, value)
    return at < len(values) and values[at] == value


def periodic_runs(regions: DataFrame, least_length: int = 24, least_exponent: int = 3) -> DataFrame:
    """``region_id``, ``n_words``, ``runs`` and ``collapsed`` for each row of ``regions(region_id, original_text)``.

    Words are what stands between ASCII blanks of the whole ``original_text``, numbered from 0. ``runs`` holds
    ``(start, length, period)`` of every stretch that repeats its first ``period`` words (its smallest period),
    has at least ``least_length`` words and ``least_exponent`` periods, and cannot be made longer at either end; in order
    of start, then period. ``collapsed`` is the text with one blank between words and without those that
    any run contains after its first period: a banner or caption read over and over stays once.

    One row per row; rows are not compared. A null or empty text has no words, no runs and an empty ``collapsed``. Ids
    may be null or repeat; other columns are ignored. Rows are dealt as they are read, with no shuffle; a task holds
    about 1 MB of text, or its longest text with some 4 bytes a word and doubling. Texts in which no window as
    long as a run must share with itself comes twice are settled by hashes of windows alone.
    """
    width = 1 << (max(least_length - least_length // least_exponent, 1).bit_length() - 1)
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, bounds in slices(batches, TEXT):
            starts, ends, at = word_spans(data, bounds)
            words = span_hashes(data, starts, ends)
            texts = texts_of(data, bounds)
            split = [t.split() for t in texts]
            runs: list = [[]] * len(texts)
            for k in repeated_windows(words, at, width).tolist():
                runs[k] = found = runs_of_words(words[at[k]:at[k + 1]], least_length, least_exponent)
                if found:
                    edges = np.zeros(len(split[k]) + 1, np.int64)
                    for start, length, period in found:
                        edges[start + period] += 1
                        edges[start + length] -= 1
                    split[k] = list(compress(split[k], (np.cumsum(edges[:-1]) == 0).tolist()))
            flat = [r for found in runs for r in found]
            columns = np.array(flat, np.int64).reshape(-1, 3)
            values = pa.StructArray.from_arrays([pa.array(columns[:, c]) for c in range(3)], fields=list(run))
            offsets = np.concatenate([[0], np.cumsum([len(found) for found in runs])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(offsets), values),
                 pa.array([b" ".join(own) for own in split], pa.binary()).cast(pa.string())],
                names=[REGION_ID, "n_words", "runs", "collapsed"])

    id_type = regions.select(REGION_ID).schema[0].dataType.simpleString()
    return regions.select(REGION_ID, TEXT).mapInArrow(
        scan, f"{REGION_ID} {id_type}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
