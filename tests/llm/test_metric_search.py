import numpy as np
import pytest

from maskloom.llm import metric_search
from maskloom.llm.metric_search import build_tree, search_tree, top_products
from maskloom.llm.queries import op12_metric_search


def plain_top(vectors, queries, k):
    """Every candidate of every query, sorted."""
    out = []
    for q, v in queries.items():
        near = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors.items() if i != q and len(w) == len(v))
        out += [(q, n, i, -s) for n, (s, i) in enumerate(near[:k], 1)]
    return sorted(out)


def rows(df):
    return sorted((r.query_id, r["rank"], r.document_id, r.score) for r in df.collect())


@pytest.mark.parametrize("spread", [3, 60])
def test_tree_finds_the_same_and_takes_fewer_products(spread):
    rng = np.random.default_rng(spread)
    centres = rng.integers(-120, 120, (30, 16))
    vectors = centres[rng.integers(0, 30, 2_000)] + rng.integers(-spread, spread, (2_000, 16))
    tree = build_tree(vectors)
    ordered, ids = vectors[tree["order"]], [[int(i)] for i in tree["order"]]
    work = 0
    for q in np.concatenate([vectors[:40], rng.integers(-120, 120, (20, 16)), np.zeros((1, 16), int)]):
        products = vectors @ q
        want = sorted((-int(p), i) for i, p in enumerate(products))[:6]
        got, taken = search_tree(tree, ordered, ids, q, 6, None)
        assert [(-s, i) for s, i in got] == want
        for bound in (want[-1][0], want[0][0] - 1):
            limited, _ = search_tree(tree, ordered, ids, q, 6, -bound)
            assert [(-s, i) for s, i in limited] == [w for w in want if -w[0] >= -bound]
        work += taken
    assert spread > 3 or work < 0.5 * 61 * 2_000


def test_odd_vectors_ties_and_several_trees(spark, monkeypatch):
    monkeypatch.setattr(metric_search, "TREE", 64)
    monkeypatch.setattr(metric_search, "QUERIES", 8)
    monkeypatch.setattr(metric_search, "ROOTS", 4)
    rng = np.random.default_rng(4)
    vectors = {i: rng.integers(-9, 10, 6).tolist() for i in range(600)}
    for i in range(600, 900):  # a third are copies of one
        vectors[i] = [3, -2, 5, 0, 1, 1]
    vectors |= {1000: [0] * 6, 1001: [1, 2], 1050: [2, 1], 1100: [4], 1150: []}
    given = [(i, v, "x", 0) for i, v in vectors.items()] + [(700, vectors[700], "y", 1), (None, [9] * 6, "z", 2), (2000, None, "z", 2), (2050, [1, None, 1, 1, 1, 1], "z", 2)]
    df = spark.createDataFrame(given, "document_id long, embedding array<long>, rank string, score int")
    asked = {i: v for i, v in vectors.items() if i % 50 == 0}
    assert rows(top_products(df, df.filter("document_id % 50 = 0"), 5)) == plain_top(vectors, asked, 5)
    assert top_products(df.limit(0), df.limit(0)).count() == 0
    assert top_products(df, df.limit(0)).count() == 0


def test_products_beyond_64_bits_are_refused():
    with pytest.raises(ValueError, match="64 bits"):
        build_tree(np.array([[1 << 31, 1 << 31]]))


def test_query_against_all_rows(spark):
    sf = "/root/testdata/sf0.01"
    vectors = {r.vec_id: [int(np.floor(256 * float(e))) for e in r.embedding] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    want = plain_top(vectors, {i: v for i, v in vectors.items() if i % 50 == 0}, 5)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in op12_metric_search(spark, sf).collect()) == want
