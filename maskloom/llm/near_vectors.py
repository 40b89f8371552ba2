"""Near-equal embeddings of captured images: binary codes of a randomised rotation, bounds, exact products."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from maskloom.llm.linking import components
from maskloom.llm.records import stored

ID, VECTOR = "document_id", "embedding"
#: Bits of a code, and standard errors of the estimate within which a pair is computed exactly.
BITS, ERRORS = 256, 6.0
#: Probability to miss a link at the threshold, vectors a bucket should hold, vectors compared together.
MISS, BUCKET, BLOCK = 1e-6, 256, 512


@lru_cache(maxsize=8)
def rotation(dims: int, salt: int = 0) -> np.ndarray:
    """``dims`` orthonormal directions in a space of at least ``BITS`` dimensions: a random rotation of a vector with zeros added."""
    rows = max(BITS, dims)
    q, r = np.linalg.qr(np.random.default_rng([20240521, dims, salt]).standard_normal((rows, dims)))
    return q * np.sign(np.diag(r))


def coded(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (one bit a direction) and correction factors, the product of each rotated vector with its own code."""
    turned = unit @ rotation(unit.shape[1]).T
    factor = np.abs(turned).sum(axis=1) / math.sqrt(turned.shape[1])
    return np.packbits(turned >= 0, axis=1), factor


def table_plan(rows: int, least: float) -> tuple[int, int]:
    """Bits of a bucket key and number of tables, so that a pair at ``least`` is missed with probability ``MISS``."""
    bits = min(max(math.ceil(math.log2(max(rows, 2) / BUCKET)), 6), 28)
    agree = 1 - math.acos(least) / math.pi
    return bits, math.ceil(math.log(MISS) / math.log1p(-agree ** bits))


def bucket_keys(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """A bucket in each table: signs after further rotations, ``bits`` of them a table."""
    dims, signs = unit.shape[1], []
    for salt in range(1, math.ceil(bits * tables / max(dims, 1)) + 1):
        directions = np.linalg.qr(np.random.default_rng([7, dims, salt]).standard_normal((dims, dims)))[0]
        signs.append(unit @ directions.T >= 0)
    signs = np.concatenate(signs, axis=1)[:, :bits * tables].reshape(len(unit), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def near_pairs(a: tuple, b: tuple, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of pairs of ``a`` and ``b`` with product >= ``least``; each is (unit vectors, codes, factors).

    The distance of two codes bounds the angle and drops most pairs. For the rest the code of one side and
    the rotated vector of the other give ``code . vector / factor``, an unbiased estimate whose error has the
    standard deviation ``sqrt((1 - f^2) / f^2 / (bits - 1))``; only pairs within ``ERRORS`` of it are
    computed, in double precision.
    """
    (x, cx, fx), (y, cy, fy) = a, b
    bits = cx.shape[1] * 8
    turn = math.acos(least) / math.pi
    far = bits * turn + ERRORS * math.sqrt(bits * turn * (1 - turn))
    distance = np.zeros((len(x), len(y)), dtype=np.uint16)
    wide_x, wide_y = (np.ascontiguousarray(c).view(np.uint64) for c in (cx, cy))
    for k in range(wide_x.shape[1]):
        distance += np.bitwise_count(wide_x[:, k][:, None] ^ wide_y[:, k][None, :])
    i, j = np.nonzero(distance <= far)
    turned = y @ rotation(y.shape[1]).T
    found_i, found_j = [], []
    for at in range(0, len(i), 1 << 14):
        p, q = i[at:at + (1 << 14)], j[at:at + (1 << 14)]
        signs = np.unpackbits(cx[p], axis=1)[:, :turned.shape[1]].astype(np.float64) * 2 - 1
        estimate = np.einsum("nd,nd->n", signs, turned[q]) / math.sqrt(turned.shape[1]) / fx[p]
        error = ERRORS * np.sqrt(np.maximum(1 - fx[p] ** 2, 0) / fx[p] ** 2 / (turned.shape[1] - 1))
        p, q = p[estimate + error >= least], q[estimate + error >= least]
        exact = np.einsum("nd,nd->n", x[p], y[q]) >= least
        found_i.append(p[exact])
        found_j.append(q[exact])
    return np.concatenate([np.zeros(0, int), *found_i]), np.concatenate([np.zeros(0, int), *found_j])


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _sides(rows: pa.Table, kind: str) -> tuple:
    block, ids = rows.column("block").to_numpy(), rows.column("id").to_numpy()
    unit = _unit(rows.column("vector").to_pylist(), kind)
    codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
    factor = rows.column("factor").to_numpy()
    x, y = rows.column("x")[0].as_py(), rows.column("y")[0].as_py()
    left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
    return ids, left, right, (unit[left], codes[left], factor[left]), (unit[right], codes[right], factor[right])


def _spanning(kind: str, least: float):
    def links(rows: pa.Table) -> pa.Table:
        ids, left, right, a, b = _sides(rows, kind)
        i, j = near_pairs(a, b, least) if len(left) and len(right) else (left[:0], right[:0])
        i, j = left[i], right[j]
        label = np.arange(len(ids))
        while len(i):
            low = np.minimum(label[i], label[j])
            new = label.copy()
            np.minimum.at(new, i, low)
            np.minimum.at(new, j, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        moved = np.flatnonzero(label != np.arange(len(ids)))
        return pa.table({"a": pa.array(ids[label[moved]], pa.int64()), "b": pa.array(ids[moved], pa.int64())})
    return links


def _counting(kind: str, least: float):
    def counts(rows: pa.Table) -> pa.Table:
        ids, left, right, a, b = _sides(rows, kind)
        weight = rows.column("weight").to_numpy()
        total = np.zeros(len(ids), dtype=np.int64)
        if len(left) and len(right):
            i, j = near_pairs(a, b, least)
            i, j = left[i], right[j]
            i, j = i[ids[i] != ids[j]], j[ids[i] != ids[j]]
            np.add.at(total, i, weight[j])
            if rows.column("x")[0].as_py() != rows.column("y")[0].as_py():
                np.add.at(total, j, weight[i])
        return pa.table({"id": pa.array(ids, pa.int64()), "n": pa.array(total, pa.int64())})
    return counts


def _in_blocks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Deal the rows of each key into blocks of about ``BLOCK``; every two blocks of a key meet once as (x, y).

    The exchange by key and blocks is asked for: where the sizes are joined by an exchange on the key, Spark would take that one as
    good enough to group by, and all blocks of a key would stay in one task.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(
        *keys, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = rows.join(sizes, keys).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    met = dealt.select("*", other).withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")}).drop("other", "blocks")
    return met.repartition(*keys, "x", "y")


def near_vectors(images: DataFrame, least: float = 0.9) -> DataFrame:
    """``document_id``, ``n_links``, ``component_id``, ``kept`` for each row of ``document_id``, ``embedding``.

    The embedding is the one kept for each captured image. Two images are linked if the cosine of their
    embeddings, in double precision, is at least ``least``. ``n_links`` counts the other ids linked directly,
    ``component_id`` is the smallest id reachable, ``kept`` marks the image that bears it.

    Equal vectors form a class that its smallest id stands for, with its number of ids as weight. Tables of
    random signs bring near classes into common buckets; there, codes and their bounds decide which pairs are
    computed exactly, and the links found connect classes into components. Inside each component every two
    blocks of classes then meet once, by the same bounds, to count links. Large buckets and components are cut
    into blocks; pairs are never rows.

    A vector that is null, empty or zero, or holds a null or a non-finite number, links with nothing. Vectors of
    different length are not compared. Rows with a null id are kept, have no links and no component. An id counts
    once, with the greatest of its usable vectors if it has several; each of its rows gets its result. No rows give
    no rows.
    """
    kind = "<f4" if dict(images.dtypes)[VECTOR] == "array<float>" else "<f8"
    images = images.select(F.col(ID).cast("bigint").alias("id"), F.col(VECTOR).alias("v") if kind == "<f4" else F.col(VECTOR).cast("array<double>").alias("v"))
    sound = ~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists("v", lambda e: e != 0)
    usable = images.filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(sound).groupBy("id").agg(F.max("v").alias("v"))
    classes = usable.groupBy("v").agg(F.min("id").alias("leader"), F.count("*").alias("weight"))
    spread = stored(classes.select(F.col("leader").alias("id"), "weight", F.size("v").alias("dims"), "v"), "classes")
    bits, tables = table_plan(spread.count(), least)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for d in np.unique(dims):
                rows = batch.filter(pa.array(dims == d))
                for at in range(0, rows.num_rows, 4096):
                    part = rows.slice(at, 4096)
                    raw = [v.values.to_numpy(zero_copy_only=False).astype(kind).tobytes() for v in part.column(3)]
                    unit = _unit(raw, kind)
                    codes, factor = coded(unit)
                    pad = -codes.shape[1] % 8
                    codes = np.pad(codes, ((0, 0), (0, pad)))
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns[:3], pa.array(raw, pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()),
                         pa.array(factor), pa.array(list(bucket_keys(unit, bits, tables)), pa.list_(pa.int64()))],
                        names=["id", "weight", "dims", "vector", "code", "factor", "buckets"])

    vectors = stored(spread.mapInArrow(
        code, "id long, weight long, dims int, vector binary, code binary, factor double, buckets array<long>"), "codes")
    placed = vectors.select("id", "dims", "vector", "code", "factor", F.posexplode("buckets").alias("table", "bucket"))
    found = _in_blocks(placed, ["dims", "table", "bucket"]).groupBy("dims", "table", "bucket", "x", "y").applyInArrow(
        _spanning(kind, least), "a long, b long").distinct()
    reached = stored(components(found), "reached")
    together = vectors.drop("buckets").join(reached.withColumnRenamed("node", "id"), "id")
    counted = _in_blocks(together, ["dims", "component"]).groupBy("dims", "component", "x", "y").applyInArrow(
        _counting(kind, least), "id long, n long").groupBy("id").agg(F.sum("n").alias("others"))

    own = stored(spread.join(reached.withColumnRenamed("node", "id"), "id", "left").join(counted, "id", "left").select(
        "v", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("component", "id").alias("component")), "own")
    by_id = usable.join(own, "v").select("id", "n", "component")
    component = F.coalesce("component", "id")
    return images.select("id").join(by_id, "id", "left").select(
        F.col("id").alias(ID), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
