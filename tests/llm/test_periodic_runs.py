import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from maskloom.llm.periodic_runs import Positions, periodic_runs, runs_of_words
from maskloom.llm.queries import op11_periodic_runs


def plain_runs(words, least_length=24, least_exponent=3):
    """Every stretch of equal words q apart, as long as it goes, whose smallest period is q."""
    found, n = [], len(words)
    for q in range(1, n // least_exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            own = words[start:i + q]
            if len(own) >= max(least_length, least_exponent * q) and not any(own[p:] == own[:-p] for p in range(1, q)):
                found.append((start, len(own), q))
    return sorted(found)


def kept_words(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def test_positions_keep_order():
    rng, own, held = random.Random(3), {50_000}, Positions([50_000])
    for value in rng.sample(range(100_000), 5_000):
        if value not in own:
            own.add(value)
            held.add(value)
    ordered = sorted(own)
    assert list(held) == ordered
    for k in [0, 1, 1023, 1024, 2500, len(ordered) - 1]:
        assert held.around(ordered[k]) == (ordered[k - 1] if k else None, ordered[k + 1] if k + 1 < len(ordered) else None)


def test_runs_against_all_periods():
    rng = random.Random(1)
    for _ in range(400):
        length, exponent = rng.choice([(24, 3), (6, 3), (4, 2), (24, 2)])
        n = rng.randint(0, 120)
        words = [rng.randint(0, rng.choice([1, 2, 5])) for _ in range(n)]
        if n and rng.random() < 0.6:
            a = rng.randrange(n)
            p = 1 + rng.randrange((n - a) // 3 + 1)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
        assert runs_of_words(np.array(words, np.uint64), length, exponent) == plain_runs(words, length, exponent)


def test_long_periodic_texts():
    assert runs_of_words(np.zeros(100_000, np.uint64)) == [(0, 100_000, 1)]
    line = np.random.default_rng(0).integers(0, 50, 4_001).astype(np.uint64)
    assert runs_of_words(np.tile(line, 5)) == [(0, 20_005, 4_001)]


def test_regions_odd_rows_and_clashing_columns(spark):
    caption = "breaking news at nine "
    texts = {"7-text-0": caption * 10 + "and then the weather", "7-text-1": caption * 5, "7-text-2": None, "7-text-3": "",
             "7-text-4": " \t\n", "7-text-5": "wórd x\tone\n" * 13, "7-text-6": "a " * 100 + "b " * 100}
    rows = [(i, t, "x", 1) for i, t in texts.items()] + [("7-text-0", texts["7-text-0"], "y", 2), (None, "b " * 30, "z", 3)]
    df = spark.createDataFrame(rows, "region_id string, original_text string, runs string, n_words int")
    got = periodic_runs(df).collect()
    assert len(got) == len(rows)
    own = {(r.region_id, r.collapsed): r for r in got}
    for i, t in [*texts.items(), (None, "b " * 30)]:
        words = re.findall(r"[^\x20\x09-\x0d]+", t or "")
        runs = plain_runs(words)
        r = own[(i, " ".join(kept_words(words, runs)))]
        assert r.n_words == len(words) and [tuple(x) for x in r.runs] == runs
    assert own[("7-text-0", "breaking news at nine and then the weather")].runs[0].period == 4
    assert periodic_runs(df.limit(0)).count() == 0


def test_query_against_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in op11_periodic_runs(spark, sf).collect()}
    documents = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").filter(F.length("text") < 9000).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    several = 0
    for d in documents:
        words = re.findall(r"[^\x20\x09-\x0d]+", d.text or "")
        h, n = zlib.crc32(str(d.doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words)
        r = got[d.doc_id]
        assert r.n_runs == len(runs)
        assert r.runs_sha256 == sha("".join(f"{s},{m},{q}\n" for s, m, q in runs))
        assert r.collapsed_sha256 == sha(" ".join(kept_words(words, runs)))
        if runs:
            several += 1
            s, m, q = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]))
            assert (r.start, r.length, r.period, r.exponent_milli) == (s, m, q, 1000 * m // q)
        else:
            assert (r.start, r.length, r.period, r.exponent_milli) == (None,) * 4
    assert several > 5 and len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
