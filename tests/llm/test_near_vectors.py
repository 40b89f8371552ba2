import numpy as np

from pyspark.sql import functions as F

from maskloom.llm.near_vectors import BLOCK, _in_blocks, coded, near_pairs, near_vectors, table_plan
from maskloom.llm.queries import op6_near_vectors


def brute(vectors, least=0.9):
    ids = sorted(vectors)
    usable = {i: np.array(vectors[i], float) for i in ids if vectors[i] and all(e is not None and np.isfinite(e) for e in vectors[i]) and any(vectors[i])}
    links = {i: set() for i in ids}
    for i in usable:
        for j in usable:
            a, b = usable[i], usable[j]
            if i < j and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= least:
                links[i].add(j)
                links[j].add(i)
    comp = {i: i for i in ids}
    for _ in ids:
        comp = {i: min([comp[i], *(comp[j] for j in links[i])]) for i in ids}
    return {i: (len(links[i]), comp[i], comp[i] == i) for i in ids}


def rows(df, name="document_id"):
    return {r[name]: (r.n_links, r.component_id, r.kept) for r in df.collect()}


def test_bounds_keep_every_near_pair():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 64))
    y = x + rng.standard_normal((400, 64)) * 0.42
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    i, j = near_pairs((x, *coded(x)), (y, *coded(y)), 0.9)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(k.tolist() for k in np.nonzero(x @ y.T >= 0.9))))
    assert table_plan(10 ** 9, 0.9)[0] > table_plan(10 ** 5, 0.9)[0]


def test_groups_and_odd_vectors(spark):
    rng = np.random.default_rng(5)
    vectors = {1: None, 2: [], 3: [0.0] * 8, 4: [1.0, None] + [0.0] * 6, 5: [float("nan")] + [1.0] * 7, 6: [float("inf")] * 8, 7: [1.0, 2.0]}
    centre = rng.standard_normal(8)
    for i in range(10, 700):  # one crowded group, chained at its edge
        vectors[i] = (centre + rng.standard_normal(8) * 0.35).tolist()
    for i in range(700, 760):
        vectors[i] = rng.standard_normal(8).tolist()
    for i in range(760, 800):
        vectors[i] = vectors[700]
    vectors[800] = [2 * e for e in vectors[700]]
    df = spark.createDataFrame([(i, v, 9) for i, v in vectors.items()] + [(760, vectors[760], 9), (None, vectors[760], 9)],
                               "document_id long, embedding array<double>, component_id int")
    got = near_vectors(df)
    assert got.count() == len(vectors) + 2
    assert {i: r for i, r in rows(got).items() if i is not None} == brute(vectors)
    assert rows(got)[None] == (0, None, True)
    assert near_vectors(df.limit(0)).count() == 0


def test_query_against_all_pairs(spark):
    sf = "/root/testdata/sf0.01"
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    assert rows(op6_near_vectors(spark, sf), "vec_id") == brute(vectors)


def test_blocks_of_one_key_spread_without_broadcasts(spark):
    """All rows under one key and no broadcast: the pairs of blocks are dealt by key and blocks, not by the key alone."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(20 * BLOCK).select("id", F.lit(3).alias("component"))
        dealt = _in_blocks(rows, ["component"])
        sizes = dealt.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(sizes) > 1 and dealt.select("x", "y").distinct().count() == 20 * 21 // 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
