import random

import numpy as np

from maskloom.llm.queries import op7_cut_repeats
from maskloom.llm.repeats import chunk_spans, cut_repeats, repeated_runs


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(n))


def test_chunks_cover_texts_and_resist_shifts():
    rng = random.Random(1)
    long = words(rng, 3000)
    texts = [b"", long.encode(), ("é ü " + long).encode(), b"x" * 100000, "日本語テキスト".encode() * 2000, b"a"]
    data, bounds = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    starts, ends, at = chunk_spans(data, bounds)
    chunks = [[data[s:e].tobytes() for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(at[:-1], at[1:])]
    assert [b"".join(c) for c in chunks] == texts
    assert all(p.decode() is not None for c in chunks for p in c)
    assert len(set(chunks[1]) - set(chunks[2])) <= 1
    alone = chunk_spans(np.frombuffer(texts[1], np.uint8), np.array([0, len(texts[1])]))[0]
    assert len(alone) == len(chunks[1])


def test_runs():
    d = np.array([1, 2, 3, 4, 2, 3, 9])
    assert repeated_runs(d, np.full(7, 5), np.array([], int), 10) == [(4, 6)]
    assert repeated_runs(d, np.full(7, 5), np.array([], int), 11) == []
    assert repeated_runs(d, np.full(7, 5), np.array([1, 9]), 10) == [(4, 7)]


def test_passages_are_cut_and_clean_texts_stay(spark):
    rng = random.Random(2)
    passage, phrase = words(rng, 60), words(rng, 12)
    clean = {i: f"{phrase} {words(rng, 80)}" for i in range(5, 25)}
    texts = {**clean, 30: words(rng, 50) + " " + passage + " " + words(rng, 50)}
    for i in range(31, 60):
        texts[i] = words(rng, rng.randrange(0, 90)) + ("\n" if i % 2 else " ") + passage + " " + words(rng, 40)
    texts[70] = passage + " " + words(rng, 30) + " " + passage
    odd = [(1, None), (2, ""), (3, "  \n"), (None, passage), (30, texts[30])]
    df = spark.createDataFrame([(i, t, 1, i) for i, t in [*texts.items(), *odd]], "region_id long, original_text string, cuts int, id long")
    got = cut_repeats(df)
    assert got.columns == ["region_id", "original_text", "id", "cuts"]
    got = [(r.region_id, r) for r in got.collect()]
    assert len(got) == len(texts) + len(odd)
    for i, r in got:
        if i in clean or i in (1, 2, 3, 30, None):
            assert r.original_text == ({**dict(odd), **texts}[i]) and r.cuts == []
        else:
            assert passage not in r.original_text
            whole, cut = texts[i], sum(c["last"] - c["first"] for c in r.cuts)
            assert len(r.original_text) == len(whole) - cut
            own = "".join(whole[a:b] for a, b in zip([0] + [c["last"] for c in r.cuts], [c["first"] for c in r.cuts] + [len(whole)]))
            assert own == r.original_text
    assert cut_repeats(df.limit(0)).count() == 0


def test_query_leaves_no_long_repeat(spark):
    sf = "/root/testdata/sf0.01"
    rows = op7_cut_repeats(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    seen, left = set(), 0
    for r in sorted(rows, key=lambda r: r.doc_id):
        w = (r.text or "").split()
        windows = {tuple(w[i:i + 50]) for i in range(len(w) - 49)}
        left += bool(windows & seen)
        seen |= windows
    assert left <= 0.005 * len(rows)


def test_periodic_texts_have_short_chunks_and_are_cut(spark):
    rng, texts = random.Random(5), {}
    for i in range(40):  # one word or one line of five words again and again, in two documents each
        line = words(rng, 1 if i % 2 else 5)
        for k, times in enumerate((120, 100)):
            texts[2 * i + k] = words(rng, 30) + "\n" + (line + (" " if i % 4 < 2 else "\n")) * times + words(rng, 30)
    data = np.frombuffer("".join(texts.values()).encode(), np.uint8)
    starts, ends, _ = chunk_spans(data, np.concatenate([[0], np.cumsum([len(t) for t in texts.values()])]))
    assert max(len(data[s:e].tobytes().split()) for s, e in zip(starts, ends)) <= 20
    df = spark.createDataFrame(list(texts.items()), "region_id long, original_text string")
    for r in cut_repeats(df).collect():
        w = r.original_text.split()
        assert len(w) < 60 + 40 if r.region_id % 2 == 0 else len(w) < 60 + 25


def test_query_leaves_no_window_of_fifty_words(spark):
    seen, left = set(), []
    for r in sorted(op7_cut_repeats(spark, "/root/testdata/sf0.01").collect(), key=lambda r: r.doc_id):
        w = (r.text or "").split()
        windows = {tuple(w[i:i + 50]) for i in range(len(w) - 49)}
        left += [r.doc_id] if windows & seen or len(windows) < len(w) - 49 else []
        seen |= windows
    assert left == []
