import math
import re
import zlib
from collections import Counter

import pytest

from maskloom.llm import language_model as lm
from maskloom.llm.queries import op4_katz_backoff

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


class Plain:
    """The same model with dictionaries; the vocabulary holds every word."""

    def __init__(self, texts):
        self.c, self.two = Counter(), Counter()
        for t in texts:
            line = [None, *words_of(t), None]
            self.c.update(line[1:])
            self.two.update(zip(line[:-1], line[1:]))
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.d = lm.good_turing(Counter(self.two.values()))
        self.follow = {}
        for (h, w), c in self.two.items():
            self.follow.setdefault(h, {})[w] = c

    def first(self, w):
        return self.c[w] / (self.n + 1) if w in self.c else 1 / (self.n + 1)

    def p(self, h, w):
        own = self.follow.get(h)
        if not own:
            return self.first(w)
        kept = {x: c * (self.d[c - 1] if c <= lm.DISCOUNTED else 1) for x, c in own.items()}
        total = sum(own.values())
        if total - sum(kept.values()) < 1e-9 * total:
            total += 1
        if w in own:
            return kept[w] / total
        return (1 - sum(kept.values()) / total) / (1 - sum(self.first(x) for x in own)) * self.first(w)

    def score(self, text):
        line = [None, *words_of(text), None]
        names = [w if w in self.c or w is None else "\0" for w in line]
        base = sum(math.log10((self.c[w] + 1) / (self.n + self.v + 1)) for w in line[1:])
        return len(line) - 1, sum(w in self.c for w in line[1:]), base, sum(math.log10(self.p(h, w)) for h, w in zip(names[:-1], names[1:]))


def check(rows, plain, texts):
    for r in rows:
        n, known, base, total = plain.score(texts[r[0]])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, plain.n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(total, rel=1e-7)


def test_probabilities_after_each_history_sum_to_one():
    plain = Plain(["a b a c", "b b b b b b b b", "c a b", "", "d"] * 3 + ["a d e f g"])
    for h in [*plain.c]:
        assert sum(plain.p(h, w) for w in plain.c) + plain.p(h, "\0") == pytest.approx(1)


@pytest.mark.parametrize("held", [lm.HELD, 5])
def test_scores_like_the_plain_model(spark, held, monkeypatch):
    monkeypatch.setattr(lm, "HELD", held)
    texts = {1: "the cat sat on the mat", 2: "The CAT\tsat\non a mat .", 3: None, 4: "", 5: "zebra zebra", 6: "the " * 500, 7: "é è the é",
             8: "the cat sat on the mat", 9: "on the mat sat zebra", 10: "cat cat"}
    rows = [(i, t, "x") for i, t in texts.items()]
    df = spark.createDataFrame(rows + [rows[0]], "region_id long, original_text string, score string")
    model = lm.learn(df.filter("region_id NOT IN (5, 9)"))
    got = lm.score(df, model).collect()
    assert len(got) == len(texts) + 1
    check(got, Plain([t for i, t, _ in rows + [rows[0]] if i not in (5, 9)]), texts)
    assert lm.score(df.limit(0), model).count() == 0
    none = lm.score(df, lm.learn(df.limit(0))).collect()
    assert {r.n_known for r in none} == {0} and all(math.isfinite(r.score) for r in none)


def test_query_against_the_plain_model_and_held_out_texts(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op4_katz_backoff(spark, sf).collect()
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 7 == 2}
    assert {r.doc_id for r in got if r.held_out} == held and len(got) == len(texts)
    plain = Plain([t for i, t in texts.items() if i not in held])
    for r in got:
        n, known, base, _ = plain.score(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, plain.n) and r.base_score == pytest.approx(base, rel=1e-9)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


@pytest.mark.parametrize("vocabulary", [3, 5, 8])
def test_words_outside_the_vocabulary_have_pairs_of_their_own(spark, vocabulary, monkeypatch):
    """With few symbols most pairs have a rare word at one end or both; scores are those of the whole model."""
    monkeypatch.setattr(lm, "VOCABULARY", vocabulary)
    texts = {1: "the cat sat on the mat", 2: "a dog sat on the red mat", 3: "the red dog the red dog the red dog", 4: "", 5: "zebra zebra cat",
             6: "the the the the the the the", 7: "red dog", 8: "dog red", 9: "mat on zebra the dog sat", 10: "cat cat cat cat cat cat cat cat"}
    rows = list(texts.items())
    df = spark.createDataFrame(rows, "region_id long, original_text string")
    got = lm.score(df, lm.learn(df.filter("region_id NOT IN (5, 8, 9)"))).collect()
    assert len(got) == len(texts)
    check(got, Plain([t for i, t in rows if i not in (5, 8, 9)]), texts)


def test_open_pairs_of_symbols_are_shuffled_as_counts(spark, monkeypatch):
    """A count packs into little, a gain does not."""
    monkeypatch.setattr(lm, "HELD", 2)
    df = spark.createDataFrame([(1, "a b a b c"), (2, "a b c d"), (3, None)], "region_id long, original_text string")
    model = lm.learn(df)
    rows = model.table.collect()
    open_ = [r for r in rows if r.n is not None]
    assert open_ and all(r.gain is None and r.base is None for r in open_)
    check(lm.score(df, model).collect(), Plain(["a b a b c", "a b c d", None]), {1: "a b a b c", 2: "a b c d", 3: None})


def test_no_row_of_the_model_is_shuffled_for_scores(spark):
    """The counts lie in buckets along their home; only the rows of the texts go there."""
    df = spark.createDataFrame([(1, "a b a b c"), (2, "a b c d"), (3, None)], "region_id long, original_text string")
    table = lm.learn(df).table
    rows = spark.createDataFrame([(1, 1)], "home long, other long")
    with lm._frugal(spark):
        plan = rows.join(table.hint("merge"), ["home", "other"], "left")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1
