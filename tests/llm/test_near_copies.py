import math
import random
import re
from itertools import combinations

from corpus_pipeline import STAGES
from maskloom.llm.linking import components
from maskloom.llm.near_copies import near_copies, planned
from maskloom.llm.queries import op2_minhash_near_copies

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {i: (len(sets[i]), top(i), top(i) == i) for i in texts}


def rows(df):
    return {r.region_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(6, 40)] + [(70, 39), (8, 8), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 5 for i in [*range(5, 40), 70]}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_families_chains_and_odd_rows(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(9999)}" for _ in range(120)]
    texts = {0: None, 1: "", 2: " \n", 3: "one two", 4: "ONE  two", 5: "one two three four five", 6: "ä Ä b c d", 7: "Ä ä b c d"}
    for i in range(10, 150):  # a family most of whose pairs fall just short
        own = list(base)
        for _ in range(rng.randrange(1, 4)):
            own[rng.randrange(120)] = f"x{i}"
        texts[i] = " ".join(own)
    drift = [f"d{i}" for i in range(200)]
    for i in range(200, 230):  # each links with the next, the ends do not
        drift = drift[2:] + [f"n{i}", f"m{i}"]
        texts[i] = "\t".join(drift)
    long = " ".join(f"v{rng.randrange(500)}" for _ in range(20000))
    texts[300], texts[301] = long, long + " end"
    df = spark.createDataFrame([(i, t, True) for i, t in texts.items()] + [(3, "one two", None), (300, long, None)],
                               "region_id long, original_text string, kept boolean")
    assert rows(near_copies(df)) == brute(texts)
    assert near_copies(df).count() == len(texts) + 2
    none = near_copies(spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f")], df.schema[:2])).collect()
    assert [(r.component_id, r.kept) for r in none] == [(None, True)] * 2
    assert near_copies(df.limit(0)).count() == 0


def test_query_against_all_pairs(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert rows(op2_minhash_near_copies(spark, sf).withColumnRenamed("doc_id", "region_id")) == brute(texts)


def test_stage_at_eighty_against_all_pairs(spark):
    rng = random.Random(8)
    texts, n = {}, 0
    for _ in range(150):  # pairs whose best link lies in [0.80, 0.85) mostly: one replaced stretch of a text of 200 words
        base = [f"w{rng.randrange(10 ** 6)}" for _ in range(200)]
        own, width = list(base), rng.randrange(12, 20)
        own[50:50 + width] = [f"x{rng.randrange(10 ** 6)}" for _ in range(width)]
        texts[n], texts[n + 1] = " ".join(base), " ".join(own)
        n += 2
    sets = {i: shingles(t) for i, t in texts.items()}
    share = {i: len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, n, 2)}
    assert sum(0.80 <= s < 0.85 for s in share.values()) > 50 and sum(s < 0.80 for s in share.values()) > 10
    want = sorted(i for i in texts if i % 2 == 0 or share[i - 1] < 0.80)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(r.doc_id for r in dict(STAGES)["near copies"](spark, docs, "").collect()) == want


def test_bands_and_least_equal_follow_the_threshold():
    for percent in (50, 70, 80, 85, 95):
        plan, share = planned(percent), percent / 100
        n = plan.bands * plan.rows
        assert (1 - share ** plan.rows) ** plan.bands < 5e-7
        assert sum(math.comb(n, k) * share ** k * (1 - share) ** (n - k) for k in range(plan.least)) <= 1e-6
        assert plan.family <= plan.least
