import re

from maskloom.llm.licences import BASE_PHRASES, scan_licences, settled, signature_rules
from maskloom.llm.queries import op1_license_scans

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base_of(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for phrase, label in BASE_PHRASES.items() for i in range(len(words))
              if words[i:i + len(phrase.split())] == phrase.split()]
    return len(words), sorted(places)


def test_every_rule_compiles_and_names_are_unique():
    rules = signature_rules()
    assert len(rules) > 300 and len({r.rule for r in rules}) == len(rules)
    for r in rules:
        re.compile(r.pattern)
        assert r.keywords


def test_contained_detections_give_way():
    assert settled([(50, 0, 10, 0), (80, 0, 12, 1), (80, 3, 9, 2), (90, 20, 25, 3), (50, 20, 26, 4), (50, 20, 26, 5)]) == [
        (80, 0, 12, 1), (90, 20, 25, 3), (50, 20, 26, 4)]


def test_labels_places_and_edges(spark):
    texts = [None, "", "...", "Under the MIT License.", "under-the mit\nlicense under the mit license", "MITx under the mit licensed",
             "Apache License, Version 2.0; Apache License Version 2x", "CC-BY-NC 4.0", "SPDX-License-Identifier: GPL-2.0-only",
             "Licensed under the BSD 3-Clause license", "cc by nc sa 4.0", "é " * 4000 + "cc by nc", "under the mit licenseé"]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(texts)], "region_id long, original_text string, n_words int, detections string")
    got = {r.region_id: r for r in scan_licences(df.union(df)).collect()}
    assert scan_licences(df.union(df)).count() == 2 * len(texts)
    for i, t in enumerate(texts):
        n, places = base_of(t)
        assert got[i].n_words == n
        assert sorted((d["first"], d["label"]) for d in got[i].detections if d.base) == places
    assert [d.label for d in got[8].detections] == ["gpl-2"]
    assert [(d.label, d.first, d.last) for d in got[9].detections] == [("bsd-3", 0, 6)]
    assert {d.label for d in got[10].detections} == {"cc-by-nc", "cc-by-nc-sa"}
    assert scan_licences(df.limit(0)).count() == 0


def test_query_against_plain_scan(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in op1_license_scans(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        n, places = base_of(r.text)
        g = got[r.doc_id]
        starts = [p for p, _ in places]
        assert (g.n_words, g.n_base, g.first_word, g.last_word) == (n, len(places), min(starts, default=None), max(starts, default=None))
        assert g.base_labels == ",".join(sorted({label for _, label in places}))
        assert {label for _, label in places} <= set(g.labels.split(",")) and 0 <= g.score <= 1
