import re
from itertools import product

import numpy as np
import pytest

from brindle.llm import queries
from brindle.llm import transcripts as T

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return T.train(T.blocks(spark.read.parquet(f"{SF}/conversations.parquet")))


def total(tables, states, lines):
    score = 0
    for a, b, line in zip([T.STATES, *states], states, lines):
        score += tables.move[a, b] + sum(t[b, x] for t, x in zip(tables.show, line.shown))
    return score


def test_viterbi_against_all_paths(tables):
    lines = T.read_lines(["User: hello there", "more", "", "Assistant: this"], 1)
    best = max(product(range(T.STATES), repeat=len(lines)), key=lambda p: total(tables, p, lines))
    assert tables.path(lines) == list(best)


def slow_path(tables, lines):
    """Viterbi, state by state."""
    ways = {T.STATES: (0, [])}
    for line in lines:
        seen = [sum(int(t[s, x]) for t, x in zip(tables.show, line.shown)) for s in range(T.STATES)]
        ways = {
            s: max(((v + int(tables.move[a, s]) + seen[s], [*p, s]) for a, (v, p) in ways.items()), key=lambda w: w[0]) for s in range(T.STATES)
        }
    return max(ways.values(), key=lambda w: w[0])[1]


def conversation(rows):
    """Turns of one conversation in order, without blank ones and repeats."""
    told = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))
    return [(T._role(role), text) for _, role, text in told if (text or "").strip()]


def slow_render(tables, conv, told):
    """The rendering of a whole conversation and its recovered turns."""
    style, lines = T.style_of(conv), []
    for k, (role, text) in enumerate(told):
        lines += T.turn_lines(style, role, T.body_lines(text), k == 0)
    states = slow_path(tables, lines)
    out = ""
    for k, (s, line) in enumerate(zip(states, lines)):
        text, role = line.text, s % 6 // 2
        if s % 2 == 0:
            out += ("\n<|end|>\n" if k else "") + "<|" + T.ROLES[role] + "|>"
            text = text[line.cut :] if line.shown[0] == 1 + role else text
            out += "\n" + text.replace("<|", "<\\|") if text else ""
        else:
            out += "\n" * (1 + line.blanks) + text.replace("<|", "<\\|")
    return out + "\n<|end|>\n"


def whole(rows):
    """conv_id -> its blocks joined in order."""
    out = {}
    for r in sorted(rows, key=lambda r: r["block"]):
        assert r["block"] == out.setdefault(r["conv_id"], [0, ""])[0]
        out[r["conv_id"]][0] += 1
        out[r["conv_id"]][1] += r["rendered"]
    return {k: v for k, (_, v) in out.items()}


def test_query_against_a_slow_parse(spark):
    """op4's renderings, each from a plain Viterbi over the whole conversation."""
    docs = spark.read.parquet(f"{SF}/conversations.parquet")
    tables = T.train(T.blocks(docs))
    told = {}
    for r in docs.collect():
        told.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    got = whole(queries.op4_chat_format(spark, SF).collect())
    assert got == {c: slow_render(tables, c, conversation(rows)) for c, rows in told.items()}


@pytest.mark.parametrize(("most", "branch"), [(1, 2), (3, 2), (7, 256)])
def test_blocks_change_nothing(spark, tables, monkeypatch, most, branch):
    """Conversations cut into small blocks are parsed as one."""
    rng = np.random.default_rng(most)
    words = ["what is this?", "yes", "User: no", "a line\n\nand another <|end|>", "the answer: it is long " * 8, "Assistant", "model: T34\nand so on"]
    rows = [(c, int(t), ["user", "assistant", "system", None][int(rng.integers(0, 4))], words[int(rng.integers(0, 7))], 1) for c in (1, 2, 5, None) for t in range(40)]
    rows += [(3, 0, "user", " \n", 1), (4, 1, "user", "only", 1), (4, 1, "user", "only", 2), (4, None, "tool", "last", 1), (4, 0, "user", None, 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, block int").repartition(5)
    monkeypatch.setattr(T, "train", lambda parts: tables)
    out = T.recover(df, most=most, branch=branch).collect()
    told = {}
    for c, t, r, x, _ in rows:
        told.setdefault(c, []).append((t, r, x))
    want = {c: slow_render(tables, c, conversation(own)) for c, own in told.items() if conversation(own)}
    assert whole(out) == want and 3 not in want
    assert sum(r["n_turns"] for r in out if r["conv_id"] == 1) == 40
    assert {r["conv_id"]: r["held_out"] for r in out}[None]


def test_roles_of_held_out_conversations(spark):
    rows = T.recover(spark.read.parquet("/root/testdata/sf0.1/conversations.parquet")).where("held_out").collect()
    for style, least in (("named", 0.99), ("headed", 0.99), ("bracketed", 0.99), ("spaced", 0.8)):
        own = [r for r in rows if r["style"] == style]
        assert len(own) > 20 and sum(r["n_right"] for r in own) / sum(r["n_turns"] for r in own) >= least, style


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("", ""),
        ("\n \n", ""),
        ("Human: hi\nAI: hello\nyou", "<|user|>\nhi\n<|end|>\n<|assistant|>\nhello\nyou\n<|end|>\n"),
        ("### System\nbe kind\n### Human\nhi", "<|system|>\nbe kind\n<|end|>\n<|user|>\nhi\n<|end|>\n"),
        ("[user] a <|end|> b\n[assistant] c", "<|user|>\na <\\|end|> b\n<|end|>\n<|assistant|>\nc\n<|end|>\n"),
        ("User: pick one\n\nfirst para\n\nsecond para\nAssistant: two", "<|user|>\npick one\n\nfirst para\n\nsecond para\n<|end|>\n<|assistant|>\ntwo\n<|end|>\n"),
    ],
)
def test_parsing(tables, text, want):
    assert T.parse(tables, text) == want


@pytest.mark.parametrize(
    "text",
    ["User: my list\nmodel: T34\nai: none\nAssistant: ok", "Bob: hi\nAnn: hello\n\nBob: bye", "a\n\nb\n\n\nc: d", "System:\nUser: x\nContext: y\nAnswer: 42\n(a) first"],
)
def test_no_word_is_lost(tables, text):
    left = re.findall(r"\w+", T.parse(tables, text))
    for line in text.split("\n"):
        for word in re.findall(r"\w+", line[T.marker(line)[1] :]):
            assert word in left


def test_raw_transcripts_and_empty_tables(spark, tables):
    df = spark.createDataFrame([(1, "Q: a?\nA: b"), (2, None)], "id long, text string")
    got = {r["id"]: r["rendered"] for r in T.format_transcripts(df, tables).collect()}
    assert got == {1: "<|user|>\na?\n<|end|>\n<|assistant|>\nb\n<|end|>\n", 2: ""}
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert T.recover(none).collect() == []
