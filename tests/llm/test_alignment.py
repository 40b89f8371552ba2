import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from maskloom.llm.alignment import Aligner, aligned_texts, link_counts, overlaps, read_model, successors, terminals, with_counts
from maskloom.llm.queries import op13_token_alignment

A, B = (read_model(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def plain(texts):
    """Whole texts through both tokenizers, groups by a walk over common ends, every overlap counted."""
    own, out = Aligner(A, B), {}
    counts, linked = Counter(), {}
    for name, text in texts.items():
        a = own.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = own.b.encode(text) if text else []
        joined = [b"".join(x) for x in ([own.bytes_a[i] for i in a], [own.bytes_b[i] for i in b])]
        if not text or joined != [(" " + text).encode()] * 2:
            linked[name], out[name] = [], (0, 0, 0, "")
            continue
        spans = [list(zip(np.cumsum([0] + w).tolist(), np.cumsum(w).tolist())) for w in ([len(own.bytes_a[i]) for i in a], [len(own.bytes_b[i]) for i in b])]
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = [([i for i, (s, e) in zip(a, spans[0]) if low < e <= high], [i for i, (s, e) in zip(b, spans[1]) if low < e <= high])
                  for low, high in zip([0] + ends, ends)]
        linked[name] = [(i, j) for i, (s, e) in zip(a, spans[0]) for j, (t, f) in zip(b, spans[1]) if s < f and t < e]
        counts.update(linked[name])
        out[name] = (len(a), len(b), len(groups), ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups))
    most = {}
    for (i, j), n in counts.items():
        most[j] = max(most.get(j, 0), n)
    return {k: (*v[:3], len(linked[k]), sum(counts[p] == most[p[1]] for p in linked[k]), sum(counts[p] for p in linked[k]), v[3]) for k, v in out.items()}


def test_pointers_lead_to_the_last_token():
    rng = np.random.default_rng(1)
    for _ in range(200):
        total = int(rng.integers(1, 200))
        a, b = (np.unique(np.append(rng.integers(1, total + 1, int(rng.integers(0, 60))), total)) for _ in range(2))
        label = terminals(successors(a, b))
        common = np.intersect1d(a, b)
        assert (np.searchsorted(common, np.concatenate([a, b])) == np.searchsorted(common, b[label - len(a)])).all()
        i, j = overlaps(a, b)
        start_a, start_b = np.concatenate([[0], a[:-1]]), np.concatenate([[0], b[:-1]])
        assert sorted(zip(i.tolist(), j.tolist())) == sorted(
            (x, y) for x in range(len(a)) for y in range(len(b)) if start_a[x] < b[y] and start_b[y] < a[x])


def test_regions_odd_texts_and_rare_pairs(spark):
    texts = {"7-text-0": "SALE  ends\n\n soon \t now", "7-text-1": "naïve café 中文 \U0001f600 x", "7-text-2": None, "7-text-3": "",
             "7-text-4": "</s> <|endoftext|> <0x41> a▁b", "7-text-5": " lead and trail ", "7-text-6": "word " * 3_000, "7-text-7": "  　wide  ",
             "7-text-8": "</s> <|endoftext|> <0x41> [INST]", "7-text-9": "\x00\x01 ctrl", "8-text-0": "SALE ends now", "8-text-1": "x" * 5_000}
    rows = [(i, t, "y", 3) for i, t in texts.items()] + [("8-text-0", texts["8-text-0"], "z", 4), (None, "SALE", "z", 4)]
    df = spark.createDataFrame(rows, "region_id string, original_text string, groups string, n_links int")
    want = plain(texts | {"again": texts["8-text-0"], "none": "SALE"})
    aligned = aligned_texts(df, A, B).cache()
    counts = link_counts(aligned).cache()
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
    for held in (0, 40, 1 << 20):  # all pairs joined, some, none
        got = with_counts(aligned, counts, held).collect()
        assert len(got) == len(rows)
        for r in got:
            assert tuple(r[n] for n in names) == want["none" if r.region_id is None else r.region_id], r.region_id
    empty = aligned_texts(df.limit(0), A, B)
    assert with_counts(empty, link_counts(empty)).count() == 0


def test_query_against_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    small = {k: v for k, v in texts.items() if len(v or "") < 1_500}
    got = {r.doc_id: r for r in op13_token_alignment(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for k, v in plain(small).items():
        r, digest = got[k], hashlib.sha256(v[6].encode()).hexdigest() if v[6] else ""
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256) == (*v[:4], digest)
    # Counts over all texts: by the counting definition, from what each text returns.
    aligned = aligned_texts(spark.createDataFrame(list(texts.items()), "region_id long, original_text string"), A, B).collect()
    counts = Counter()
    for r in aligned:
        counts.update({(x.a, x.b): x.times for x in r.links})
    most = {}
    for (i, j), n in counts.items():
        most[j] = max(most.get(j, 0), n)
    for r in aligned:
        assert got[r.region_id].n_links == sum(x.times for x in r.links)
        assert got[r.region_id].count_sum == sum(x.times * counts[x.a, x.b] for x in r.links)
        assert got[r.region_id].n_best == sum(x.times for x in r.links if counts[x.a, x.b] == most[x.b])
