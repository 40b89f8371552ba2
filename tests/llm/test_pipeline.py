from collections import Counter

import corpus_pipeline as cp
from maskloom.llm.queries import op2_minhash_near_copies, op3_quality_rules

SF = "/root/testdata/sf0.001"


def test_stages_one_after_the_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    passed = cp.quality_stage(spark, docs, SF)
    assert passed.columns == docs.columns
    want = sorted(r.doc_id for r in op3_quality_rules(spark, SF).collect() if r.kept)
    assert sorted(r.doc_id for r in passed.collect()) == want
    single = cp.near_copy_stage(spark, docs, SF)
    assert sorted(r.doc_id for r in single.collect()) == sorted(r.doc_id for r in op2_minhash_near_copies(spark, SF).collect() if r.kept)
    assert cp.run(spark, SF).count() > 0


def test_odd_rows_and_clashing_columns(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, words, "en", None, 5, "a", 1, "r"), (2, words.upper(), None, "s", None, "b", 2, "r"), (3, None, "en", "s", 0, None, 3, None),
            (3, None, "en", "s", 0, None, 3, None), (None, words, "de", "s", 7, "c", 4, "r"), (4, "x y " * 9000, "fr", "s", 1, "d", 5, "r"),
            (5, "", "es", "s", 0, "e", 6, "r"), (6, " ".join(f"v{i}" for i in range(40)), "en", "s", 1, "f", 7, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, region_id string, copies int, row string")
    for table in (docs, docs.limit(0)):
        for name, stage in cp.STAGES:
            got = stage(spark, table, SF)
            assert name == "byte-level BPE" or got.schema.simpleString() == docs.schema.simpleString()
            found = got.collect()
            ids = Counter(r.doc_id for r in found)
            if table is not docs:
                assert not found
            elif name == "near copies":
                assert ids == {1: 1, 3: 2, None: 1, 4: 1, 5: 1, 6: 1}
            elif name == "repeated passages":
                assert len(found) == len(rows) and {r.doc_id: r.text for r in found}[2] == words.upper()
            elif name == "byte-level BPE":
                assert Counter((r.doc_id, r.text) for r in found) == Counter((r[0], r[1] or "") for r in rows)


def test_the_token_stage_has_one_step_in_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tokens = cp.token_stage(spark, docs, SF)
    assert tokens._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted((r.doc_id, r.text) for r in tokens.collect()) == sorted((r.doc_id, r.text or "") for r in docs.collect())
