import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.functions import text
from brindle.operators import predicates
from brindle.sources.indexing import indexed
from brindle.sources.namespace import Namespace, SchemaError


def test_normalised_column_and_constant_agree(spark):
    cases = ["O'Neil & Sons, Inc.", "ÉCOLE", "a-b_c", "50%*", "", "Çà et là", "straße", "x@y=z|w", "[a]{b}(c)<d>", "ŁÓDŹ ſ Ā"]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = [r[0] for r in df.select(text.normalised(F.col("t"))).collect()]
    assert got == [text.normalise(c) for c in cases]
    assert got[:6] == ["oneil  sons inc", "ecole", "a-b_c", "50", "", "ca et la"]


def test_tokens_keep_repeats_and_null(spark):
    df = spark.createDataFrame([("The  cat, the\tCAT!",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(text.tokens(F.col("t"))).collect()] == [["the", "cat", "the", "cat"], None, []]
    assert [r[0] for r in df.select(text.tokens(F.col("t"), ("the",))).collect()] == [["cat", "cat"], None, []]


def test_stop_words_by_language(spark):
    assert "the" in text.stop_words("en") and "und" in text.stop_words("de") and text.stop_words("xx") == ()


@pytest.mark.parametrize(
    ("word", "stem"),
    [
        ("caresses", "caress"), ("ties", "tie"), ("cries", "cri"), ("gas", "gas"), ("gaps", "gap"), ("kiwis", "kiwi"),
        ("agreed", "agre"), ("feed", "feed"), ("hopping", "hop"), ("hoping", "hope"), ("luxuriated", "luxuri"),
        ("cry", "cri"), ("by", "by"), ("say", "say"), ("relational", "relat"), ("conditional", "condit"),
        ("vietnamization", "vietnam"), ("operator", "oper"), ("generously", "generous"), ("generate", "generat"),
        ("communism", "communism"), ("skies", "sky"), ("dying", "die"), ("succeeding", "succeed"), ("consistency", "consist"),
        ("knightly", "knight"), ("adoption", "adopt"), ("probable", "probabl"), ("controll", "control"), ("knots", "knot"),
    ],
)
def test_stem(word, stem):
    assert text.stem_english(word) == stem


@given(st.text(alphabet="abcdefghijklmnopqrstuvwxyz'", max_size=12))
def test_stem_never_fails(word):
    assert isinstance(text.stem_english(word), str)


def test_stems_column(spark):
    df = spark.createDataFrame([(["running", "dogs"],), (None,)], "w array<string>")
    assert [r[0] for r in df.select(text.stems(F.col("w"))).collect()] == [["run", "dog"], None]
    df = spark.createDataFrame([(["dogs", None, "dogs"],), ([],), (None,), (["ties"],)], "w array<string>")
    assert [r[0] for r in df.select(text.stems(F.col("w"))).collect()] == [["dog", None, "dog"], [], None, ["tie"]]


def test_marks_go_from_any_text(spark):
    rows = ["Plain, text!", "\u00c9t\u00e9 d'\u00c0", "\u0394\u03a9 stra\u00dfe", "", None, "a\u2003b\ufeffc"]
    df = spark.createDataFrame([(x,) for x in rows], "t string")
    got = df.select(text.normalised(F.col("t")), text.tokens(F.col("t"))).collect()
    assert [r[0] for r in got] == [None if x is None else text.normalise(x) for x in rows]
    assert [r[1] for r in got] == [None if x is None else text.tokenise(x) for x in rows]


def test_marks_go_from_column_and_constant_alike(spark):
    odd = "e\u0301 \u01f0 \u0130 \u03a3\u03a3 \u1100\u1161\u11a8 \uac00\u11a8 \uac01\u11a8 \u0905\u0903 \U0001d15e \uf900 \u212a \x1c\x85\u00a0".split(" ")
    df = spark.createDataFrame([(f"{a}{b}{a}",) for a in odd for b in odd], "t string")
    got = df.select("t", text.normalised(F.col("t"), wild=True), text.tokens(F.col("t")), text.tokens(F.col("t"), separators="ascii")).collect()
    for whole, bare, words, ascii_words in got:
        assert bare == text.normalise(whole, wild=True)
        assert (words, ascii_words) == (text.tokenise(whole), text.tokenise(whole, "ascii"))
    assert text.normalise("\u03a3\u03a3 e\u0301 \u1100\u1161\u11a8 \u0130") == "\u03c3\u03c3 e \uac01 i"


def test_separators_and_empty_texts_of_fields(spark):
    fields = {
        "t": {"type": "text"},
        "plain": {"type": "text", "source": "t", "separators": "ascii"},
        "told": {"type": "text", "defaultValue": "cat"},
        "both": {"type": "text", "source": "t,told"},
    }
    ns = Namespace.parse({"name": "n", "prefix": "n", "fields": fields})
    df = indexed(spark.createDataFrame([("a1\u00a0b1", "dog"), ("", ""), (None, None)], "t string, told string"), ns)
    assert [tuple(r) for r in df.select("t__tokens", "plain__tokens", "told__tokens", "both").collect()] == [
        (["a1", "b1"], ["a1\u00a0b1"], ["dog"], "a1\u00a0b1 dog"),
        ([], [], ["cat"], "cat"),
        (None, None, ["cat"], "cat"),
    ]
    count = lambda name, query: df.where(predicates.condition(ns, name, query)).count()
    assert [count("t", "b1"), count("plain", "b1"), count("t", "a1\u00a0b1"), count("plain", "a1\u00a0b1"), count("t", "*")] == [1, 0, 1, 1, 1]
    with pytest.raises(SchemaError):
        Namespace.parse({"name": "n", "prefix": "n", "fields": {"t": {"type": "text", "separators": "none"}}})
