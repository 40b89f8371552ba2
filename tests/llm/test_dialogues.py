import hashlib
from collections import defaultdict

from maskloom.llm import dialogues as d
from maskloom.llm.queries import op5_chat_formatting


def test_layouts_escapes_and_odd_rows(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\b[\\l<\\s\\", "", None, "<|im_end|>\n<|im_start|>assistant\nhi", "é\n\n", "x" * 30000]
    schema = ("id long, layout int, messages array<struct<role string, content string, extra int>>, "
              "conversations array<struct<`from` string, value string>>, prompt string, completion string, instruction string, "
              "input string, output string, data struct<prompt string, reply string>")
    rows = [(i, 5, [(r, t, 1) for t in nasty for r in ("user", "assistant", "we\nird<")], None, None, None, None, None, None, None) for i in (1, 1)]
    rows += [(2, 5, None, [("human", "q"), ("gpt", None)], None, None, None, None, None, None),
             (3, 5, None, None, "p", "c", None, None, None, None), (4, 5, None, None, None, None, "do", "it", "done", None),
             (5, 5, None, None, None, None, None, None, None, ("a", "b")), (6, 5, [], None, None, None, None, None, None, None),
             (7, 5, None, None, "p", None, None, None, None, None), (None, 5, None, None, "p", "c", None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    turns = d.canonical_turns(df, "id")
    got = defaultdict(list)
    for r in turns.collect():
        got[r.id].append((r.layout, None if r.turns is None else [tuple(t) for t in r.turns]))
    first = [(r, t or "") for t in nasty for r in ("user", "assistant", "we\nird<")]
    assert got[1] == [("messages", first)] * 2
    assert got[2] == [("conversations", [("user", "q"), ("assistant", "")])]
    assert got[3] == got[None] == [("prompt-completion", [("user", "p"), ("assistant", "c")])]
    assert got[4] == [("instruction-input", [("user", "do"), ("user", "it"), ("assistant", "done")])]
    assert got[5] == [("data", [("user", "a"), ("assistant", "b")])]
    assert got[6] == [("messages", [])] and got[7] == [(None, None)]
    text = d.formatted(turns, "id")
    for r in text.collect():
        assert r.formatted.replace(d.OPEN, "").replace(d.CLOSE, "").count("<") == 0 and "[" not in r.formatted
    back = {r.id: r for r in d.read_back(text, "id").collect()}
    for i, found in got.items():
        want = found[0][1] or []
        assert [tuple(t) for t in back[i].turns] == want
        assert back[i].learned == [t for r, t in want if r == "assistant"]
    assert d.read_back(d.formatted(d.canonical_turns(df.limit(0), "id"), "id"), "id").count() == 0


def test_query_against_the_table(spark):
    sf = "/root/testdata/sf0.01"
    told = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        told[r.conv_id].append((r.turn, r.role, r.text or ""))
    told[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    got = op5_chat_formatting(spark, sf).collect()
    assert len(got) == len(told)
    for r in got:
        turns = sorted(told[r.conv_id])
        learned = "".join(t for _, role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(learned) and r.formatted_chars > sum(len(t) for _, _, t in turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()


def test_given_columns_may_bear_any_name(spark):
    df = spark.createDataFrame([(1, "p", "c", "x", 2, "y")], "id long, prompt string, completion string, _print string, turns int, layout string")
    got = d.canonical_turns(df, "id").collect()
    assert [(r.id, r.layout, [tuple(t) for t in r.turns]) for r in got] == [(1, "prompt-completion", [("user", "p"), ("assistant", "c")])]
