import numpy as np

from maskloom.llm.queries import op10_quality_classifier
from maskloom.llm.quality_classifier import features, fit_quality, score_quality


def test_features_are_indicators_of_ngrams():
    texts = [b"a b a b", b"", b"A b", b"x x x"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = features(data, bounds)
    alone = [features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    assert all((a == b).all() for a, b in zip(got, alone))
    assert len(got[1]) == 0 and len(set(got[0]) & set(got[2])) >= 2


def test_empty_tables_nulls_and_one_class(spark):
    schema = "region_id long, original_text string, quality int, score string"
    none = spark.createDataFrame([], schema)
    rows = spark.createDataFrame([(1, None, 1, ""), (2, "", 1, ""), (2, "a " * 9000, None, ""), (None, "b", 7, "")], schema)
    for labelled, low, high in ((none, 0.5, 0.5), (rows, 0.9, 1.0)):
        model = fit_quality(labelled)
        got = score_quality(rows, model).collect()
        assert len(got) == 4 and all(low <= r.score <= high for r in got)
        assert score_quality(none, model).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = op10_quality_classifier(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    both = got[got.held_out].merge(labels, on="doc_id")
    good, bad = both[both.quality == 1].score.to_numpy(), both[both.quality == 0].score.to_numpy()
    auc = (good[:, None] > bad[None, :]).mean() + 0.5 * (good[:, None] == bad[None, :]).mean()
    assert auc > 0.97 and (both.predicted == both.quality).mean() > 0.95
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
