import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskloom.llm import mixing
from maskloom.llm.queries import MIX, op8_soft_mixing


def test_rates_meet_targets_like_a_plain_solver(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.4, 0.3, 0.2], 500)
    t = rng.integers(1, 2000, 500)
    df = spark.createDataFrame([(i, int(t[i]), p[i].tolist()) for i in range(500)], "region_id long, n_tokens long, posterior array<double>")
    model = mixing.DomainModel(["a", "b", "c"], [], [])
    rates = mixing.fit_rates(df, model, {"a": 0.2, "b": 0.7, "c": 0.1}, float(t.sum()), steps=60)
    got = df.select("region_id", rates.column().alias("r")).toPandas().sort_values("region_id").r.to_numpy()
    assert (got >= 0).all()
    assert np.abs((got * t) @ p - np.array([0.2, 0.7, 0.1]) * t.sum()).max() < 2e-4 * t.sum()
    drop = mixing.fit_rates(df, model, {"a": 1.0}, float(t.sum()), steps=20)
    r = df.select(drop.column().alias("r"), "n_tokens", "posterior").toPandas()
    assert (r.r >= 0).all() and (r.r == 0).any()


def test_memberships_and_odd_rows(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["sun", "sea", "sky"] if i % 2 else ["law", "tax", "fee"]) for _ in range(20)), 1) for i in range(200)]
    rows += [(1000, None, 1), (1001, "", 1), (1002, " \n", 1), (1003, "sun " * 20000, 1), (None, "tax tax", 1), (1, rows[1][1], 1)]
    df = spark.createDataFrame(rows, "region_id long, original_text string, posterior int")
    labels = spark.createDataFrame([(i, "air" if i % 2 else "money") for i in range(100)] + [(150, None)], "region_id long, domain string")
    members, model, rates = mixing.mixed_rates(df, labels, {"air": 1, "money": 1})
    assert model.domains == ["air", "money"] and members.count() == len(rows)
    got = {r.region_id: r for r in members.collect()}
    assert all(math.isclose(sum(r.posterior), 1) for r in got.values())
    assert all(got[i].posterior[1 - i % 2] > 0.9 for i in range(200)) and got[1003].n_tokens == 20000
    assert np.allclose(got[1000].posterior, [0.5, 0.5]) and got[1001].n_tokens == 0
    none = df.limit(0)
    assert mixing.mixed_rates(none, labels, {"air": 1})[0].count() == 0
    assert mixing.fit_domains(labels.limit(0), df).domains == ["all"]


def test_query_meets_the_mix(spark):
    got = op8_soft_mixing(spark, "/root/testdata/sf0.1").toPandas()
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "lang").toPandas()
    assert len(got) == len(documents)
    expected = {d: (got.rate * got.n_tokens * got[f"p_{d}"]).sum() for d in MIX}
    total = sum(expected.values())
    assert all(abs(expected[d] / total - share) < 1e-3 for d, share in MIX.items())
    assert abs((got.copies * got.n_tokens).sum() - total) < 0.02 * total
    assert (got.copies >= 1).mean() > 0.999  # the default budget loses nothing
    both = got.merge(documents, on="doc_id")
    both = both[both.n_tokens >= 20]
    best = both[[f"p_{d}" for d in sorted(MIX)]].to_numpy().argmax(axis=1)
    assert (np.array(sorted(MIX))[best] == both.lang).mean() > 0.95


def test_default_budget_meets_skewed_targets_and_loses_nothing(spark):
    rng = np.random.default_rng(6)
    names, n = ["a", "b", "c", "d"], 4000
    for prior, crisp in (([0.62, 0.145, 0.13, 0.105], 0.05), ([0.8, 0.1, 0.06, 0.04], 0.4)):
        own = rng.choice(4, n, p=prior)
        p = np.array([rng.dirichlet(np.where(np.arange(4) == k, 3.0, crisp)) for k in own])
        p[:400] = rng.dirichlet([1.0] * 4, 400)  # texts that belong to several
        t = np.where(rng.random(n) < 0.3, rng.integers(1, 5, n), rng.integers(5, 2000, n))
        df = spark.createDataFrame([(i, int(t[i]), p[i].tolist()) for i in range(n)], "region_id long, n_tokens long, posterior array<double>")
        model = mixing.DomainModel(names, [], [])
        for weights in ({"a": 0.50, "b": 0.18, "c": 0.18, "d": 0.14}, {"a": 0.5, "b": 0.2}):
            rates = mixing.fit_rates(df, model, weights)
            got = df.select("region_id", rates.column().alias("r"), mixing.copies(rates.column(), F.col("region_id")).alias("c")).toPandas().sort_values("region_id")
            totals, present = (got.r.to_numpy() * t) @ p, t @ p
            rest = sum(present[k] for k, d in enumerate(names) if d not in weights) / present.sum()
            want = [weights[d] / sum(weights.values()) * (1 - rest) if d in weights else present[k] / present.sum() for k, d in enumerate(names)]
            assert (got.r >= 1).all() and (got.c >= 1).all()
            assert np.abs(totals / totals.sum() - want).max() < 5e-4 and rates.missed <= 1e-4


def test_targets_out_of_reach_are_reported(spark):
    df = spark.createDataFrame([(i, 10, [0.6, 0.4]) for i in range(20)], "region_id long, n_tokens long, posterior array<double>")
    with pytest.warns(UserWarning, match="miss their targets"):
        rates = mixing.fit_rates(df, mixing.DomainModel(["a", "b"], [], []), {"a": 0.1, "b": 0.9})
    assert rates.missed > 0.1 and df.select(rates.column().alias("r")).agg({"r": "min"}).first()[0] >= 1


def test_a_rare_domain_is_sampled_too(spark):
    rows = [(i, "sun sea sky " * 5) for i in range(3000)] + [(i, "law tax fee " * 5) for i in range(3000, 3010)]
    df = spark.createDataFrame(rows, "region_id long, original_text string")
    model = mixing.fit_domains(df.select("region_id", F.when(F.col("region_id") < 3000, "air").otherwise("money").alias("domain")), df, sample=40)
    got = {r.region_id: r.posterior for r in mixing.memberships(df, model).collect()}
    assert all(got[i][1] > 0.5 for i in range(3000, 3010)) and all(got[i][0] > 0.5 for i in range(3000))


def plain_least_squares(t, p, targets, least, rounds):
    """The same loss by plain steps on whole arrays."""
    r, size = np.ones(len(t)), np.maximum(t @ p, targets)
    for _ in range(rounds):
        r = np.maximum(least, r - p @ (((r * t) @ p - targets) / size))
    return r


@pytest.mark.parametrize("kind", ["reachable", "skewed", "unreachable"])
def test_rates_are_the_least_squares_ones(spark, kind):
    rng = np.random.default_rng(2)
    prior = {"reachable": [3.0, 2.0, 2.0], "skewed": [6.0, 1.5, 1.0], "unreachable": [2.0, 2.0, 2.0]}[kind]
    p = rng.dirichlet(prior, 300)
    if kind == "unreachable":
        p = 0.8 / 3 + 0.2 * p  # every text is a blend, no domain can have nearly all tokens
    t = np.where(rng.random(300) < 0.1, 0, rng.integers(1, 900, 300))
    shares = np.array([0.9, 0.05, 0.05]) if kind == "unreachable" else np.array([0.5, 0.3, 0.2])
    df = spark.createDataFrame([(i, int(t[i]), p[i].tolist()) for i in range(300)], "region_id long, n_tokens long, posterior array<double>")
    budget = 1.3 * float(t.sum())
    rates = mixing.fit_rates(df, mixing.DomainModel(["a", "b", "c"], [], []), dict(zip("abc", shares)), budget)
    got = df.select("region_id", rates.column().alias("r")).toPandas().sort_values("region_id").r.to_numpy()
    assert (got[t == 0] == 1).all() and (got >= 0).all() and got.max() < 1000
    here, size = (got * t) @ p, np.maximum(t @ p, shares * budget)
    assert np.allclose(here, rates.totals) and math.isclose(rates.missed, np.abs(here - shares * budget).max() / budget, rel_tol=1e-6)
    loss = lambda r: (((r * t) @ p - shares * budget) ** 2 / size).sum()
    if kind == "unreachable":
        assert rates.missed > 0.2 and loss(plain_least_squares(t, p, shares * budget, 0.0, 20_000)) * 0.99 <= loss(got)
        assert loss(got) <= loss(plain_least_squares(t, p, shares * budget, 0.0, 200))
    else:
        assert rates.missed <= 1e-4 and np.abs(here - (plain_least_squares(t, p, shares * budget, 0.0, 20_000) * t) @ p).max() < 3e-4 * budget


def test_rates_stay_finite_where_a_language_has_two_texts(spark):
    words = {"en": "the law of tax", "de": "das recht der steuer", "fr": "la loi de impot", "es": "ley del tributo"}
    rows = [(i, (words["en"] if i % 2 else words["de"]) + f" {i}", "en" if i % 2 else "de") for i in range(2000)]
    rows += [(2000, words["fr"], "fr"), (2001, words["es"], "es"), (2002, "", "es"), (2003, None, "fr")]
    df = spark.createDataFrame(rows, "region_id long, original_text string, domain string")
    members, _, rates = mixing.mixed_rates(df, df.select("region_id", "domain"), MIX)
    got = members.select("region_id", "n_tokens", rates.column().alias("r")).toPandas()
    assert got.r.min() >= 1 and (got[got.n_tokens == 0].r == 1).all()
    # The scarce languages need some 4,000 tokens each and have one text of three or four.
    assert got.r.max() < 5_000 and (got.r * got.n_tokens).sum() < 3 * got.n_tokens.sum()
