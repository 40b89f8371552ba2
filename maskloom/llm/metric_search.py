"""Images with the greatest inner products to given ones, exactly: best-first search of paged metric trees."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from maskloom.llm.near_vectors import ID, VECTOR
from maskloom.llm.records import stored

#: Vectors of one tree, entries of one of its pages, query vectors of one block, roots of one page of roots.
TREE, PAGE, QUERIES, ROOTS = 2048, 64, 512, 1024
#: Most vectors that space is divided by at first (a sample chosen by hash), and parts that a hot join key is dealt over.
PIVOTS, SALTS = 256, 16
#: Part of a distance that rounding may take; no node is left out within it.
SLACK = 1e-6


def _whole(raw: list[bytes], dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), "<i8").reshape(len(raw), dims)


def lifted(vectors: np.ndarray) -> tuple[np.ndarray, float]:
    """Vectors with one coordinate more, so that all have the greatest norm, and that norm squared.

    With a query lifted by 0, the squared distance is then ``norm^2 + |query|^2 - 2 * product``: the nearest one has the
    greatest inner product, and the triangle inequality holds.
    """
    squares = np.einsum("nd,nd->n", vectors.astype(np.float64), vectors.astype(np.float64))
    most = float(squares.max(initial=0.0))
    if most >= 2.0 ** 61:
        raise ValueError("inner products of these vectors do not fit into 64 bits")
    return np.column_stack([vectors.astype(np.float64), np.sqrt(most - squares)]), most


def _distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(points - centre).sum(axis=1))


def build_tree(vectors: np.ndarray) -> dict:
    """A metric tree of two levels over the rows of ``vectors``: a root over pages, pages over entries.

    ``order`` puts rows into page order. A page begins at ``starts``; its routing object is row ``centres`` (in that order), all
    its entries lie between ``inner`` and ``outer`` from it, and ``to_root`` is the distance of the routing object to the
    root. ``to_centre`` keeps each entry's distance to the routing object of its page.
    """
    points, most = lifted(vectors)
    n = len(points)
    root = int(np.argmin(_distances(points, points.mean(axis=0))))
    from_root = _distances(points, points[root])
    centres, owner, nearest = [root], np.zeros(n, np.int64), from_root.copy()
    while len(centres) < -(-n // PAGE):
        far = int(np.argmax(nearest))
        if nearest[far] == 0:
            break
        own = _distances(points, points[far])
        closer = own < nearest
        owner[closer], nearest[closer] = len(centres), own[closer]
        centres.append(far)
    order = np.lexsort((nearest, owner))
    owner, to_centre = owner[order], nearest[order]
    first = np.searchsorted(owner, np.arange(len(centres)))
    starts = np.flatnonzero((np.arange(n) - first[owner]) % PAGE == 0)
    ends = np.append(starts[1:], n)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    routing = np.array(centres)[owner[starts]]
    return {"order": order, "starts": starts, "centres": place[routing], "inner": to_centre[starts], "outer": to_centre[ends - 1],
            "to_root": from_root[routing], "to_centre": to_centre, "root": int(place[root]), "reach": float(from_root.max()), "most": most}


def reach_of(bound: int | None, most: float, square: float) -> float:
    """Within which distance of the query a vector must lie for its product to be ``bound`` at least."""
    if bound is None:
        return float("inf")
    return float(np.sqrt(max(most + square - 2.0 * bound, 0.0)) + SLACK * np.sqrt(most + square))


def search_tree(tree: dict, vectors: np.ndarray, ids: list[list[int]], query: np.ndarray, k: int, bound: int | None) -> tuple[list, int]:
    """The ``k`` greatest ``(product, id)`` of the tree, ties to smaller ids, and how many products were taken.

    ``vectors`` and ``ids`` (of all images with that vector) are in page order. Products under ``bound`` are not looked for. Pages
    are visited by falling upper bound. What is stored about distances to the root and to the routing object leaves out
    pages and entries before any product is taken.
    """
    square, most = float(query.astype(np.float64) @ query.astype(np.float64)), tree["most"]
    best: list[tuple[int, int]] = []
    near = reach_of(bound, most, square)

    def away(rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(most + square - 2.0 * (vectors[rows] @ query), 0.0))

    to_root = float(away(np.array([tree["root"]]))[0])
    taken = 1
    if to_root - tree["reach"] > near:
        return best, taken
    gap = np.abs(to_root - tree["to_root"]) - tree["outer"]
    pages = np.flatnonzero(gap <= near)
    to_page = away(tree["centres"][pages])
    taken += len(pages)
    least = np.maximum(np.maximum(to_page - tree["outer"][pages], tree["inner"][pages] - to_page), 0.0)
    heap = list(zip(least.tolist(), pages.tolist(), to_page.tolist()))
    heapq.heapify(heap)
    starts, n = tree["starts"], len(vectors)
    while heap:
        low, page, own = heapq.heappop(heap)
        if low > near:
            break
        a, b = int(starts[page]), int(starts[page + 1]) if page + 1 < len(starts) else n
        rows = a + np.flatnonzero(np.abs(own - tree["to_centre"][a:b]) <= near)
        if not len(rows):
            continue
        products = vectors[rows] @ query
        taken += len(rows)
        if bound is not None:
            rows, products = rows[products >= bound], products[products >= bound]
        if len(rows):
            best += [(-p, i) for p, r in zip(products.tolist(), rows.tolist()) for i in ids[r]]
            best = sorted(best)[:k]
            if len(best) == k and (bound is None or -best[-1][0] > bound):
                bound = -best[-1][0]
                near = reach_of(bound, most, square)
    return [(-p, i) for p, i in best], taken


def _usable(images: DataFrame) -> DataFrame:
    rows = images.select(F.col(ID).cast("bigint").alias("id"), F.col(VECTOR).cast("array<bigint>").alias("v"))
    return rows.filter("id IS NOT NULL AND v IS NOT NULL").filter(~F.exists("v", F.isnull)).groupBy("id").agg(F.max("v").alias("v"))


_TREE = ("shard long, dims int, vectors binary, ids binary, ends binary, starts binary, centres binary, inner binary, outer binary, "
         "to_root binary, to_centre binary, root int, reach double, most double")


def _grown(rows: pa.Table) -> pa.Table:
    """One shard's vectors as one row that holds their tree."""
    dims = rows.column("dims")[0].as_py()
    vectors = _whole(rows.column("vector").to_pylist(), dims)
    tree = build_tree(vectors)
    ids = [rows.column("ids")[int(i)].as_py() for i in tree["order"]]
    parts = {"vectors": vectors[tree["order"]].astype("<i8"), "ids": np.array([i for own in ids for i in own], "<i8"),
             "ends": np.cumsum([len(own) for own in ids]).astype("<i8"),
             **{k: tree[k].astype("<i8") for k in ("starts", "centres")},
             **{k: tree[k].astype("<f8") for k in ("inner", "outer", "to_root", "to_centre")}}
    return pa.table({"shard": pa.array([rows.column("shard")[0].as_py()], pa.int64()), "dims": pa.array([dims], pa.int32()),
                     **{k: pa.array([v.tobytes()], pa.binary()) for k, v in parts.items()}, "root": pa.array([tree["root"]], pa.int32()),
                     "reach": [tree["reach"]], "most": [tree["most"]]})


def _read_tree(row: dict) -> tuple[dict, np.ndarray, list[list[int]]]:
    whole = {k: np.frombuffer(row[k], "<i8") for k in ("ids", "ends", "starts", "centres")}
    ids, ends = whole["ids"].tolist(), whole["ends"].tolist()
    tree = {k: np.frombuffer(row[k], "<f8") for k in ("inner", "outer", "to_root", "to_centre")}
    tree |= {k: row[k] for k in ("root", "reach", "most")} | {k: whole[k] for k in ("starts", "centres")}
    vectors = np.frombuffer(row["vectors"], "<i8").reshape(len(ends), row["dims"])
    return tree, vectors, [ids[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(c)[k].as_py() for c, name in enumerate(batch.schema.names)}


def _searching(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            tree, vectors, ids = _read_tree(row)
            queries = _whole(row["queries"], row["dims"])
            names = ("block", "place", "score", "id")
            out: dict[str, list] = {c: [] for c in names}
            for pick in row["picks"]:
                best, _ = search_tree(tree, vectors, ids, queries[pick["place"]], k, pick["bound"])
                for score, i in best:
                    for c, value in zip(names, (row["block"], pick["place"], score, i)):
                        out[c].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[c], pa.int32() if c == "place" else pa.int64()) for c in names], names=list(names))
    return search


def _bounding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For a block and a page of roots: the trees that may still hold something for a query, and for which ones."""
    pick = pa.list_(pa.struct([("place", pa.int32()), ("bound", pa.int64())]))
    for row in _rows(batches):
        queries = _whole(row["queries"], row["dims"])
        squares = np.einsum("nd,nd->n", queries.astype(np.float64), queries.astype(np.float64))
        homes = np.array(row["homes"], np.int64)
        bounds = [None] * len(queries)
        for b in row["bounds"] or []:
            bounds[b["place"]] = b["bound"]
        shards, picks = [], []
        for root in row["roots"]:
            if root["dims"] != row["dims"]:
                continue
            centre = np.frombuffer(root["centre"], "<i8")
            away = np.sqrt(np.maximum(root["most"] + squares - 2.0 * (queries @ centre), 0.0))
            near = np.array([reach_of(b, root["most"], s) for b, s in zip(bounds, squares.tolist())])
            open_ = np.flatnonzero((homes != root["shard"]) & (away - root["reach"] <= near)).tolist()
            if open_:
                shards.append(root["shard"])
                picks.append([{"place": i, "bound": bounds[i]} for i in open_])
        yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * len(shards), pa.int64()), pa.array(shards, pa.int64()), pa.array(picks, pick)],
                                         names=["block", "shard", "picks"])


def _dealt(plan: dict[int, tuple], vector: str) -> tuple[Column, Column]:
    """Shard and query block, as expressions of ``pivot`` and ``vector``."""
    rows = [(p, *v) for p, v in plan.items()]
    maps = [F.map_from_arrays(F.array(*[F.lit(r[0]).cast("long") for r in rows]), F.array(*[F.lit(r[c]).cast("long") for r in rows])) for c in (1, 2, 3)]
    parts, base, blocks = (F.coalesce(F.try_element_at(m, F.col("pivot")), F.lit(1 if c != 1 else -1)) for c, m in enumerate(maps))
    shard = F.col("pivot") * (1 << 32) + F.pmod(F.xxhash64(vector, F.lit(1)), parts)
    return shard, base + F.pmod(F.xxhash64(vector, F.lit(2)), blocks)


def _plan(sizes: dict[int, tuple[int, int, int]]) -> dict[int, tuple[int, int, int]]:
    """For each pivot: parts of its vectors, first block of its queries and number of blocks; neighbouring pivots share a block."""
    plan, block, room, at_dims = {}, -1, 0, None
    for pivot, (dims, vectors, queries) in sorted(sizes.items(), key=lambda s: (s[1][0], s[0])):
        parts = -(-vectors // TREE) or 1
        if queries > QUERIES:
            own = -(-queries // QUERIES)
            plan[pivot] = (parts, block + 1, own)
            block, room = block + own, 0
            continue
        if at_dims != dims or queries > room or block < 0:
            block, room, at_dims = block + 1, QUERIES, dims
        room -= queries
        plan[pivot] = (parts, block, 1)
    return plan


def top_products(images: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``document_id``, ``score``: the ``k`` images with the greatest inner products to each query.

    Both tables hold ``document_id`` and ``embedding``, the one kept for each captured image, in whole numbers. ``score`` is
    the inner product as a 64-bit number. A query's own ``document_id`` is no candidate; equal scores go to smaller ids; with
    fewer candidates all are returned. Vectors of different lengths are not compared.

    Null ids, null vectors and vectors with a null take no part. An id counts once, with the greatest of its vectors if it
    has several. Other columns are ignored. Products of 2^61 and more raise an error. No rows give no rows.

    Equal vectors are searched and found once: of each distinct vector the ``k + 1`` smallest ids matter. Distinct vectors are divided
    by the nearest of ``PIVOTS`` sampled ones and by hash into shards of about ``TREE``, and each shard becomes a
    metric tree of pages in one row. Query vectors travel in blocks. Each first visits the tree of its own neighbourhood;
    then pages of roots tell, by the bound it has won there, which other trees may hold anything for it, and only those
    are visited. Every vector is in a tree, and a tree is left out only if no entry can reach the bound: results are exact.
    """
    spark = images.sparkSession
    first = Window.partitionBy("v").orderBy("id")
    classes = _usable(images).withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= k + 1).groupBy("v").agg(
        F.sort_array(F.collect_list("id")).alias("ids"))
    asked = _usable(queries)
    entries = stored(classes.select("v", "ids", F.size("v").alias("dims")), "entries")
    sample = entries.select("v", "dims").orderBy(F.xxhash64("v"), "v").limit(min(PIVOTS, -(-entries.count() // TREE))).collect()
    pivots = {d: (np.array([n for n, r in enumerate(sample) if r.dims == d]), np.array([r.v for r in sample if r.dims == d], np.float64).reshape(-1, d))
              for d in {r.dims for r in sample}}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(0)
            dims = np.diff(vectors.offsets.to_numpy())
            flat, starts = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
            pivot = -1 - dims.astype(np.int64)  # where no pivot has this length
            for d, (numbers, points) in pivots.items():
                rows = np.flatnonzero(dims == d)
                own = flat[starts[rows][:, None] + np.arange(d)].astype(np.float64)
                for at in range(0, len(rows), 4096):
                    x = own[at:at + 4096]
                    pivot[rows[at:at + 4096]] = numbers[np.argmin(np.square(points).sum(axis=1) - 2 * x @ points.T, axis=1)]
            raw = [flat[a:b].astype("<i8").tobytes() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(dims.astype(np.int32)), pa.array(pivot), pa.array(raw, pa.binary())],
                                             names=[*batch.schema.names[1:], "dims", "pivot", "vector"])

    placed_entries = stored(entries.select("v", "ids").mapInArrow(placed, "ids array<long>, dims int, pivot long, vector binary"), "placed")
    wanted = stored(asked.select("v").distinct().mapInArrow(placed, "dims int, pivot long, vector binary"), "wanted")
    sizes: dict[int, list[int]] = {}
    for c, rows in enumerate((placed_entries, wanted)):  # a row for each pivot, or length without one
        for r in rows.groupBy("pivot", "dims").agg(F.count("*").alias("n")).collect():
            sizes.setdefault(r.pivot, [r.dims, 0, 0])[1 + c] = r.n
    if not sizes:
        return spark.createDataFrame([], f"query_id long, rank int, {ID} long, score long")
    plan = _plan({p: tuple(v) for p, v in sizes.items()})

    shard, block = _dealt(plan, "vector")
    trees = stored(placed_entries.select(shard.alias("shard"), "dims", "vector", "ids").repartition("shard").groupBy("shard").applyInArrow(_grown, _TREE), "trees")
    blocks = stored(wanted.select(block.alias("block"), "dims", shard.alias("home"), "vector").repartition("block").groupBy("block", "dims").agg(
        F.sort_array(F.collect_list(F.struct("vector", "home"))).alias("own")).select(
        "block", "dims", F.col("own.vector").alias("queries"), F.col("own.home").alias("homes")), "blocks")

    def salt(of: str) -> Column:
        return F.pmod(F.xxhash64(of), F.lit(SALTS)).cast("int").alias("salt")

    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")

    def searched(pairs: DataFrame) -> DataFrame:
        with_queries = pairs.select("block", "shard", "picks", salt("shard")).join(blocks.select("block", "queries", every), ["block", "salt"]).drop("salt")
        whole = with_queries.select("*", salt("block")).join(trees.select("*", every), ["shard", "salt"]).drop("salt")
        return whole.mapInArrow(_searching(k + 1), "block long, place int, score long, id long")

    no_bound = F.lit(None).cast("long").alias("bound")
    at_home = blocks.select("block", F.posexplode("homes").alias("place", "shard")).groupBy("block", "shard").agg(
        F.collect_list(F.struct("place", no_bound)).alias("picks"))
    near = stored(searched(at_home), "near")
    best = Window.partitionBy("block", "place").orderBy(F.desc("score"), "id")
    lowest = near.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") == k + 1).groupBy("block").agg(
        F.collect_list(F.struct("place", F.col("score").alias("bound"))).alias("bounds"))

    pages = -(-trees.count() // ROOTS)
    centre = F.substring("vectors", 1 + F.col("root") * F.col("dims") * 8, F.col("dims") * 8)
    roots = trees.select("shard", F.struct("shard", "dims", centre.alias("centre"), "reach", "most").alias("root")).groupBy(
        F.pmod(F.xxhash64("shard"), F.lit(max(pages, 1))).cast("int").alias("page")).agg(F.collect_list("root").alias("roots"))
    bounded = blocks.join(lowest, "block", "left").select("*", F.explode(F.sequence(F.lit(0), F.lit(max(pages - 1, 0)))).alias("page"), salt("block"))
    pairs = stored(bounded.join(roots.select("*", every), ["page", "salt"]).select("block", "dims", "queries", "homes", "bounds", "roots").mapInArrow(
        _bounding, "block long, shard long, picks array<struct<place: int, bound: long>>"), "pairs")
    far = searched(pairs)

    top = near.unionByName(far).withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k + 1).groupBy("block", "place").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("low"), "id"))).alias("found"))
    answers = blocks.select("block", F.posexplode("queries").alias("place", "vector")).join(top, ["block", "place"]).select("vector", "found", every)
    raw = asked.mapInArrow(_packed, "id long, vector binary").select("id", "vector", salt("id"))
    mine = raw.join(answers, ["vector", "salt"]).select(
        "id", F.slice(F.filter("found", lambda f: f["id"] != F.col("id")), 1, k).alias("found"))
    return mine.select(F.col("id").alias("query_id"), F.posexplode("found").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.id").alias(ID), (-F.col("hit.low")).alias("score"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat, starts = batch.column(1).values.to_numpy(zero_copy_only=False), batch.column(1).offsets.to_numpy()
        raw = [flat[a:b].astype("<i8").tobytes() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["id", "vector"])
