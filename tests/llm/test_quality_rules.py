import re
from collections import Counter

from maskloom.llm import quality_rules as qr
from maskloom.llm.queries import op3_quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    many = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), len(set(words)),
            sum("A" <= c <= "Z" for c in text), sum(c in "!?" for c in text))


def test_counts(spark):
    texts = [None, "", " \n\t\x0b", "a", "a b c d e a b c d e", "a a a a a a a", "\n\nx\nx \nx\n\n", "É# ü| x\x0cy\rz A!?",
             "w " * 6000, " ".join(f"v{i % 700}" for i in range(2100)), "a b c d e f a b c d g a b c d e"]
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "region_id long, original_text string, n_words string")
    got = {r.region_id: r for r in qr.text_statistics(df.union(df)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                         "n_distinct_words", "n_upper", "n_marks")) == plain(t), t
    assert qr.text_statistics(df.limit(0)).count() == 0


def test_learned_list_rejects_what_the_labels_reject(spark):
    rows = []
    for i in range(3000):
        kind = i % 10
        symbols, upper = (400 if kind == 0 else i % 30), (700 if kind == 1 else i % 90)
        rows.append((i, 200, 1000, symbols, 0, i % 20, 150, upper, 0, 0 if kind < 2 else 1))
    df = spark.createDataFrame(rows, "region_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                                     "n_repeat_words long, n_distinct_words long, n_upper long, n_marks long, quality int")
    rules = qr.learn_rules(df)
    assert {c.statistic for r in rules for c in r} == {"symbol_share", "upper_share"}
    assert df.filter(qr.verdict(rules) != (df.quality == 1)).count() == 0
    assert qr.learn_rules(df.filter("quality = 1")) == [] and qr.learn_rules(df.limit(0)) == []
    assert df.filter(~qr.verdict([])).count() == 0


def test_query_against_plain_counts_and_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in op3_quality_rules(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        g, want = got[r.doc_id], plain(r.text)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want[:5]
        assert g.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (g.base_failed and g.kept)
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if not got[r.doc_id].base_failed]
    good = [got[r.doc_id].kept for r in labels if r.quality == 1]
    bad = [got[r.doc_id].kept for r in labels if r.quality == 0]
    assert sum(good) > 0.99 * len(good) and sum(bad) < 0.3 * len(bad)
