import hashlib
import re
from collections import defaultdict

import pytest

from brindle.llm import decontaminate as D

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                got = windows.get(tuple(w[k : k + n]))
                if got:
                    hit.update(range(k, k + n))
                    found |= got
        listed = ",".join(sorted(str(x) for x in found if x is not None))
        known = len([x for x in found if x is not None])
        bad = len(hit) > 0 and 20 * len(hit) >= len(w)
        out.append((i, len(w), len(hit), known, hashlib.sha256(listed.encode()).hexdigest(), bad))
    return sorted(out, key=str)


def rows(docs, items):
    found = D.contamination(docs, items).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    return sorted(map(tuple, found.collect()), key=str)


LONG = "ΟΔΟΣ'ΑΒΓ " + "ΣΑΣ-ΣΑΣ.Σ " * 4 + "x y z u v w r s"
ITEMS = [(1, "One TWO three"), (2, "one, two; three"), (3, ""), (None, "four"), (4, None), (5, "é É 5"), (6, " ".join(f"w{i}" for i in range(20))),
         (7, " ".join(f"W{i}" for i in range(5, 30))), (8, "K k"), (9, "ΑΒΓΑΣ.ΑΒΓ one two"), (10, LONG), (11, "İstanbul IĞDIR \u212aelvin")]
DOCS = [(1, "x one-two_three y"), (2, "ONE two\nthree"), (3, "é É 5 É é 5"), (4, None), (5, ""), (6, "four"), (6, "four"),
        (7, ".." + ", ".join(f"w{i}" for i in range(40)) + ".."), (8, "w0 " * 50), (9, "one two " * 400 + "three" + " z" * 20000), (None, "four one two three"),
        (10, "K k"), (11, "K K"), (12, "ΑΒΓΑΣ.ΑΒΓ one two"), (13, LONG), (14, "αβγας αβγ one two"), (15, "İSTANBUL IĞDIR \u212aELVIN kelvin")]


def frames(spark):
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, uid string")
    return spark.createDataFrame([(i, t, 1) for i, t in DOCS], "doc_id long, text string, hits int").repartition(3), items


def test_odd_rows(spark):
    assert rows(*frames(spark)) == brute(DOCS, ITEMS)


def test_verbatim_copies_are_hit_whatever_the_script(spark):
    found = {r["doc_id"]: (r["n_words"], r["n_hit"]) for r in D.contamination(*frames(spark)).collect()}
    assert found[12] == (4, 4) and found[13] == (22, 22) and found[15][1] == 3


@pytest.mark.parametrize("join", [1 << 20, 3])
def test_a_benchmark_too_large_for_the_scan(spark, monkeypatch, join):
    monkeypatch.setattr(D, "SET_BOUND", 3)
    monkeypatch.setattr(D, "JOIN_BOUND", join)
    monkeypatch.setattr(D, "TEXT_BOUND", 0)
    assert rows(*frames(spark)) == brute(DOCS, ITEMS)


def test_documents(spark, sf, documents):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in documents.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert rows(documents, items) == want


def test_clean(spark, sf):
    docs, items = frames(spark)
    cleaned = D.clean(docs, items)
    assert cleaned.columns == docs.columns
    left = sorted(((r["doc_id"], r["text"]) for r in cleaned.collect()), key=str)
    bad = {i for i, *_, b in brute(DOCS, ITEMS) if b}
    assert [i for i, _ in left] == sorted((i for i, t in DOCS if i not in bad), key=str)
    texts = dict(left)
    assert texts[9] == "one two " * 399 + "z" + " z" * 19999
    assert texts[8] == DOCS[8][1] and texts[4] is None


@pytest.mark.parametrize("which", ["docs", "items", "both"])
def test_empty(spark, which):
    docs, items = frames(spark)
    docs = docs.limit(0) if which != "items" else docs
    items = items.limit(0) if which != "docs" else items
    got = rows(docs, items)
    assert got == ([] if which != "items" else brute(DOCS, []))
    assert D.clean(docs, items).count() == len(got)


def test_clean_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "one two three " + "x " * 99, 7, True, "a"), (2, "none", 9, None, "b")], "doc_id long, text string, __uid long, __BAD boolean, `a.b` string")
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    got = sorted(map(tuple, D.clean(docs, items).collect()))
    assert got == [(1, "x " * 99, 7, True, "a"), (2, "none", 9, None, "b")]


def test_plan_is_native(spark):
    plan = D.contamination(*frames(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
