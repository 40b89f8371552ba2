"""Near copies among the texts of regions: MinHash signatures, banding, exact checks, components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegralType

from maskloom.llm.linking import components
from maskloom.llm.records import LOWER, REGION_ID, TEXT, mixed, slices, span_hashes, stored, word_spans

SHINGLE = 5
#: Probability with which a pair at the threshold may agree in no band, or have too few equal minima for its sets to be checked.
MISS, MISS_EQUAL = 4.5e-7, 1e-6
#: Minima of a band at most, of a text at most, and the share of equal ones with which two texts count as one family.
ROWS, MOST, FAMILY_SHARE = 5, 256, 0.4
#: Members and shingles of a family that are compared together.
BLOCK, BLOCK_SHINGLES = 64, 1 << 18

_rng = np.random.default_rng(20240229)
_PLACES = _rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_FACTORS = _rng.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Plan:
    """Bands and minima a band of a threshold; equal minima from which a pair is checked on its sets, or is of one family."""
    bands: int
    rows: int
    least: int
    family: int

    def functions(self) -> tuple[np.ndarray, np.ndarray]:
        """Factors and shifts of the universal hash functions."""
        drawn = np.random.default_rng(20240301).integers(0, 1 << 63, (self.bands * self.rows, 2), dtype=np.uint64)
        return drawn[:, 0] * np.uint64(2) + np.uint64(1), drawn[:, 1]


def planned(percent: int) -> Plan:
    """The longest bands with which pairs at ``percent`` keep to ``MISS`` and ``MISS_EQUAL`` with ``MOST`` minima.

    85 gives 25 bands of 5, and 80 gives 37 of 5.
    """
    share = min(max(percent / 100, 1e-3), 1 - 1e-9)
    for rows in range(ROWS, 0, -1):
        bands = math.ceil(math.log(MISS) / math.log1p(-share ** rows))
        if bands * rows <= MOST:
            break
    n, below, least = bands * rows, 0.0, 0
    while least < n:
        below += math.comb(n, least) * share ** least * (1 - share) ** (n - least)
        if below > MISS_EQUAL:
            break
        least += 1
    return Plan(bands, rows, least, min(int(FAMILY_SHARE * n), least))


def shingle_sets(data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The distinct 64-bit shingle hashes of each text, sorted.

    A shingle is five consecutive words of the text with A-Z lower-cased; a text of fewer words is one
    shingle, hashed with its number of words; a text without words has none.
    """
    data = LOWER[data]
    starts, ends, at = word_spans(data, bounds)
    words = span_hashes(data, starts, ends)
    n = max(len(words) - SHINGLE + 1, 0)
    rolled = np.zeros(n, dtype=np.uint64)
    for k in range(SHINGLE):
        rolled += words[k:k + n] * _PLACES[k]
    rolled = mixed(rolled)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= SHINGLE:
            out.append(np.unique(rolled[a:b - SHINGLE + 1]))
        else:
            short = (words[a:b] * _PLACES[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mixed(np.array([short], np.uint64)) if b > a else words[a:b])
    return out


def signatures(sets: list[np.ndarray], plan: Plan) -> np.ndarray:
    """Minima of all universal hash functions of ``plan``, a row for each set; sets must not be empty."""
    factors, shifts = plan.functions()
    flat = np.concatenate(sets)
    begins = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), len(factors)), dtype=np.uint64)
    for k in range(len(factors)):
        out[:, k] = np.minimum.reduceat(flat * factors[k] + shifts[k], begins)
    return out


def _signed(plan: Plan):
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for rows, data, bounds in slices(batches, TEXT):
            sets = shingle_sets(data, bounds)
            used = [i for i, s in enumerate(sets) if len(s)]
            digests, bands, signs = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            if used:
                minima = signatures([sets[i] for i in used], plan)
                keys = np.zeros((len(used), plan.bands), dtype=np.uint64)
                grouped = minima.reshape(len(used), plan.bands, plan.rows)
                for k in range(plan.rows):
                    keys += mixed(grouped[:, :, k] * _BAND_FACTORS[k])
                keys = mixed(keys + np.arange(plan.bands, dtype=np.uint64)).view(np.int64)
                low = (minima >> np.uint64(48)).astype(np.uint16)
                for k, i in enumerate(used):
                    digests[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
                    bands[i], signs[i] = keys[k], low[k].tobytes()
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(signs, pa.binary())],
                names=[REGION_ID, "n_shingles", "digest", "bands", "minima"])
    return signed


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, bounds in slices(batches, TEXT):
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), pa.array([s.tobytes() for s in shingle_sets(data, bounds)], pa.binary())], names=[REGION_ID, "shingles"])


def _compared(plan: Plan):
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for k in (2, 3))
            equal = (a == b).sum(axis=1)
            near = pa.array(equal >= plan.family)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(near), batch.column(1).filter(near), pa.array(equal, pa.int64()).filter(near)], names=["a", "b", "equal"])
    return compared


def _linked(percent: int):
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for at in range(batch.num_rows):
                a, b = (np.frombuffer(batch.column(k)[at].as_buffer(), np.uint64) for k in (2, 3))
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1)], names=["a", "b"])
    return linked


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """How many values each sorted set of ``left`` shares with each of ``right``."""
    common = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    for at in range(0, len(common), width):
        part = common[at:at + width]
        sides = []
        for sets in (left, right):
            held = np.zeros((len(sets), len(part)), dtype=np.float32)
            for i, s in enumerate(sets):
                own = s[np.searchsorted(s, part[0]):np.searchsorted(s, part[-1], side="right")]
                place = np.searchsorted(part, own)
                held[i, place[part[place] == own]] = 1
            sides.append(held)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    return out


def _block_links(percent: int):
    def links(rows: pa.Table) -> pa.Table:
        x, y = rows.column("x")[0].as_py(), rows.column("y")[0].as_py()
        block = rows.column("block").to_numpy()
        node, component = rows.column("node").to_pylist(), rows.column("component").to_pylist()
        sets = [np.frombuffer(v, np.uint64) for v in rows.column("shingles").to_pylist()]
        left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
        found = []
        if len(left) and len(right):
            both = shared_counts([sets[i] for i in left], [sets[i] for i in right])
            size = np.array([len(s) for s in sets])
            near = 100 * both >= percent * (size[left][:, None] + size[right][None, :] - both)
            root = {c: c for c in component}

            def top(c):
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            for i, j in zip(*np.nonzero(near)):
                a, b = top(component[left[i]]), top(component[right[j]])
                if a != b:
                    root[max(a, b)] = min(a, b)
                    found.append((node[left[i]], node[right[j]]))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})
    return links


def _with_both(pairs: DataFrame, values: DataFrame, value: str) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(values.select(F.col(REGION_ID).alias(side), F.col(value).alias(f"{value}_{side}")), side)
    return pairs.select("a", "b", f"{value}_a", f"{value}_b")


def _near(pairs: DataFrame, minima: DataFrame, plan: Plan) -> DataFrame:
    """The pairs ``(a, b)`` whose signatures say they may be of one family, with how many minima are equal."""
    return stored(_with_both(pairs, minima, "minima").mapInArrow(_compared(plan), "a long, b long, equal long"), "near")


def _shingles(regions: DataFrame, pairs: DataFrame) -> DataFrame:
    """The full shingle sets of all ids in ``pairs``."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias(REGION_ID)).distinct()
    return stored(regions.join(ids, REGION_ID, "left_semi").select(REGION_ID, TEXT).mapInArrow(
        _sets, f"{REGION_ID} long, shingles binary").distinct(), "sets")


def _confirmed(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    pairs = near.filter(F.col("equal") >= planned(percent).least)
    return stored(_with_both(pairs, sets, "shingles").mapInArrow(_linked(percent), "a long, b long").distinct(), "linked")


def _family_links(families: DataFrame, links: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that join components inside families which ``links`` leave in several parts, block by block.

    A family is cut into blocks of a bounded number of members and shingles; every two blocks meet once. Of
    the links of two blocks only those that join two components are returned.
    """
    parts = families.withColumnRenamed("component", "family").join(components(links), "node", "left").select(
        "node", "family", F.coalesce("component", "node").alias("component"))
    sized = parts.join(sets.select(F.col(REGION_ID).alias("node"), (F.length("shingles") / 8).cast("bigint").alias("n")), "node")
    open_ = sized.groupBy("family").agg(
        F.min("component").alias("low"), F.max("component").alias("high"),
        F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")).filter("low < high")
    dealt = parts.join(open_, "family").select(
        "family", "node", "component", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "blocks")
    met = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "family", "node", "component", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    # The exchange is asked for: with a broadcast of ``sets`` Spark would group on the exchange by family, and not split it.
    return met.join(sets.withColumnRenamed(REGION_ID, "node"), "node").repartition("family", "x", "y").groupBy("family", "x", "y").applyInArrow(
        _block_links(percent), "a long, b long")


def near_copies(regions: DataFrame, percent: int = 85) -> DataFrame:
    """``region_id``, ``n_shingles``, ``component_id``, ``kept`` for each row of ``region_id``, ``original_text``.

    Regions are linked if their shingle sets share at least ``percent`` of their union; bands and the least number
    of equal minima follow from it. ``component_id`` is the
    smallest id reachable over links, ``kept`` marks the region that bears it.

    Equal sets form a class and its smallest id stands for it. Classes that agree in a band are candidates.
    In each bucket all members are compared with its smallest one, on signatures and, where these are close,
    on the full sets. Members whose signatures resemble the smallest one's are its family. Thousands
    of near copies mostly become one component by this alone; a family left in several components is then
    compared block by block on full sets. Members of one bucket that are of different families
    are compared one by one, so no two texts that share a bucket stay unchecked.

    Texts without words, null or empty, have an empty set and link with nothing. Rows with a null id take no
    part: their component is null and they are kept. Rows that share an id are one node, which links as any
    of its texts does. Other columns are ignored; no rows give no rows. Ids may be whole numbers or text such as
    ``7-text-0``, which is ordered as text; text ids are numbered first and their components named last, in joins by id.
    """
    if not isinstance(regions.schema[REGION_ID].dataType, IntegralType):
        return _by_number(regions, percent)
    plan = planned(percent)
    regions = regions.select(F.col(REGION_ID).cast("bigint").alias(REGION_ID), TEXT)
    signed = stored(regions.mapInArrow(
        _signed(plan), f"{REGION_ID} long, n_shingles long, digest binary, bands array<long>, minima binary"), "signatures")
    named = signed.filter(F.col(REGION_ID).isNotNull() & F.col("digest").isNotNull())
    classes = stored(named.groupBy("digest").agg(F.min(REGION_ID).alias("leader")), "classes")
    leaders = named.select(REGION_ID, "digest", "bands", "minima").join(
        classes.withColumnRenamed("leader", REGION_ID), [REGION_ID, "digest"]).dropDuplicates([REGION_ID, "digest"])
    minima = leaders.select(REGION_ID, "minima")

    placed = leaders.select(F.explode("bands").alias("bucket"), F.col(REGION_ID).alias("id"))
    shared = placed.groupBy("bucket").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    members = stored(placed.join(shared, "bucket").filter("id <> first"), "members")
    near = _near(members.select(F.col("first").alias("a"), F.col("id").alias("b")).distinct(), minima, plan)
    sets = _shingles(regions, near)
    links = _confirmed(near, sets, percent)
    families = components(near)
    links = links.union(stored(_family_links(families, links, sets, percent), "links"))

    family = families.select(F.col("node").alias("id"), F.col("component").alias("family"))
    grouped = members.join(family, "id", "left").select("bucket", "first", "id", F.coalesce("family", "id").alias("family"))
    strays = grouped.join(family.select(F.col("id").alias("first"), F.col("family").alias("own")), "first", "left").filter(
        F.col("family") != F.coalesce("own", "first")).select("bucket", F.col("id").alias("stray"), F.col("family").alias("other"))
    pairs = strays.join(grouped, "bucket").filter("family <> other").select(
        F.least("id", "stray").alias("a"), F.greatest("id", "stray").alias("b")).distinct()
    late = _near(pairs, minima, plan)
    if not late.filter(F.col("equal") >= plan.least).isEmpty():
        links = links.union(_confirmed(late, _shingles(regions, late), percent))

    reached = classes.join(components(links).withColumnRenamed("node", "leader"), "leader", "left").select(
        "digest", F.coalesce("component", "leader").alias("component_id"))
    component = F.coalesce("component_id", REGION_ID)
    return signed.select(REGION_ID, "n_shingles", "digest").join(reached, "digest", "left").select(
        REGION_ID, "n_shingles", F.when(F.col(REGION_ID).isNotNull(), component).alias("component_id"),
        F.coalesce(F.col(REGION_ID) == component, F.lit(True)).alias("kept"))


def _by_number(regions: DataFrame, percent: int) -> DataFrame:
    """:func:`near_copies` of regions whose ids are no numbers."""
    texts = regions.select(F.col(REGION_ID).alias("name"), TEXT)
    names = stored(texts.select("name").filter("name IS NOT NULL").distinct().select("name", F.monotonically_increasing_id().alias("node")), "names")
    numbered = stored(texts.join(names, "name", "left").select("name", F.col("node").alias(REGION_ID), TEXT), "numbered")
    found = stored(near_copies(numbered, percent), "found")
    of_node = found.select(F.col(REGION_ID).alias("node"), "component_id").filter("node IS NOT NULL").distinct()
    least = names.join(of_node, "node").groupBy("component_id").agg(F.min("name").alias("least"))
    named = names.join(of_node, "node").join(least, "component_id").select("node", "name", "least")
    return found.join(named, F.col(REGION_ID) == F.col("node"), "left").select(
        F.col("name").alias(REGION_ID), "n_shingles", F.col("least").alias("component_id"), F.coalesce(F.col("name") == F.col("least"), F.lit(True)).alias("kept"))
