"""Every text operator on the library's own region table, whose ids are text such as ``7-text-0``."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from maskloom.llm import alignment, byte_bpe, language_model, licences, mixing, near_copies, periodic_runs, quality_classifier, quality_rules, repeats
from maskloom.llm.records import REGION_ID, TEXT, texts_of_regions
from maskloom.operators import regions as R


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(7)
    word = lambda: rng.choice(["sale", "menu", "open", "daily", "bread", "news", "at", "nine", "under", "the"]) + str(rng.randrange(30))
    long = [" ".join(word() for _ in range(80)) for _ in range(40)]
    said = long + [long[3], long[3] + " more", long[5], None, "", "under the MIT license", "stop " * 40]
    rows = [(i % 9, f"{i % 9}-text-{i // 9}", t, 0.5) for i, t in enumerate(said)]
    new = spark.createDataFrame(rows, "document_id long, region_id string, original_text string, confidence double").withColumns(
        {"bbox": F.lit(None).cast("struct<x:double,y:double,w:double,h:double>"), "polygon": F.lit(None).cast("array<struct<x:double,y:double>>")})
    table = R.text_regions(new, [F.col("region_id")])
    other = R.mask_views(table).select("region_id", F.lit("object").alias("type"), F.create_map(F.lit("original_text"), F.lit("no text")).alias("metadata"))
    whole = table.select("region_id", "type", "metadata").unionByName(other)
    out = texts_of_regions(whole).cache()
    assert out.count() == len(rows)
    return out, {r[1]: r[2] for r in rows}


def test_operators_row_by_row(spark, texts):
    df, said = texts
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    a, b = (alignment.read_model(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    results = [
        byte_bpe.encode_texts(df, ranks, public_tokenizers.PATTERN), licences.scan_licences(df), quality_rules.text_statistics(df),
        language_model.score(df, language_model.learn(df)), periodic_runs.periodic_runs(df),
        alignment.aligned_texts(df, a, b), near_copies.near_copies(df), repeats.cut_repeats(df)]
    for got in results:
        assert dict(got.dtypes)[REGION_ID] == "string" and {r[REGION_ID] for r in got.select(REGION_ID).collect()} == said.keys()


def test_copies_are_named_by_the_least_id(spark, texts):
    df, said = texts
    got = {r.region_id: (r.component_id, r.kept) for r in near_copies.near_copies(df).collect()}
    for i, t in said.items():
        same = [k for k, v in said.items() if t and v and (v == t or v == t + " more" or v + " more" == t)]
        assert got[i] == (min(same or [i]), i == min(same or [i])), i


def test_the_least_id_keeps_a_passage(spark, texts):
    df, said = texts
    got = {r.region_id: r for r in repeats.cut_repeats(df).collect()}
    copies = sorted(k for k, v in said.items() if v == next(t for k, t in said.items() if k == "3-text-0"))
    assert len(copies) == 2 and not got[copies[0]].cuts and got[copies[1]].cuts and got[copies[0]][TEXT] == said[copies[0]]


def test_labelled_operators(spark, texts):
    df, said = texts
    ids = sorted(said)
    labels = spark.createDataFrame([(i, n % 2, "ab"[n % 2]) for n, i in enumerate(ids)], "region_id string, quality int, domain string")
    model = quality_classifier.fit_quality(df.join(labels.select(REGION_ID, "quality"), REGION_ID))
    assert quality_classifier.score_quality(df, model).count() == len(said)
    members, _, rates = mixing.mixed_rates(df, labels.select(REGION_ID, "domain"), {"a": 1, "b": 1})
    assert members.select(rates.column()).count() == len(said)
    rules = quality_rules.learn_rules(quality_rules.text_statistics(df).join(labels.select(REGION_ID, "quality"), REGION_ID))
    assert quality_rules.text_statistics(df).filter(quality_rules.verdict(rules)).count() <= len(said)
