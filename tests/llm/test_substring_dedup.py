import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import substring_dedup as S


def brute(rows, window=35):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    counts = Counter(tuple(w[k : k + window]) for _, w in split for k in range(len(w) - window + 1))
    out = []
    for i, w in split:
        covered = set()
        for k in range(len(w) - window + 1):
            if counts[tuple(w[k : k + window])] > 1:
                covered.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in covered)
        out.append((i, len(w), len(covered), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows(df, **kw):
    return sorted(map(tuple, S.remove_repeats(df, digest=True, **kw).collect()), key=str)


def test_against_brute_force(both):
    assert rows(both) == brute([tuple(r) for r in both.collect()])


@pytest.mark.parametrize("window", [1, 2, 3, 4])
def test_short_windows(spark, window):
    rng = np.random.default_rng(window)
    texts = [(i, " ".join(rng.choice(list("abcdefgh"), rng.integers(0, 30)))) for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    assert rows(df, window=window) == brute(texts, window)


def test_a_saturated_sketch_loses_nothing(both, monkeypatch):
    """However loose the estimates, results are exact: here every cell counts two."""
    monkeypatch.setattr(S, "merged_sketch", lambda rows, window, bits: np.full((S.SKETCH_ROWS, 1 << bits - 3), 255, np.uint8))
    assert rows(both, window=5) == brute([tuple(r) for r in both.collect()], 5)


def test_a_passage_in_a_third_of_all_rows(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    df = spark.range(300).selectExpr("id as doc_id", f"if(id % 3 = 0, concat('a', id, ' {passage} b', id), concat('only', id)) as text").repartition(9)
    got = {r[0]: r[2] for r in rows(df)}
    assert all(n == (60 if i % 3 == 0 else 0) for i, n in got.items())


def test_kept_words(spark):
    df = spark.createDataFrame([(1, "a b c d\te"), (2, "x b  c d")], "doc_id long, text string")
    assert {r["doc_id"]: r["kept"] for r in S.remove_repeats(df, window=3).collect()} == {1: "a e", 2: "x"}


def test_empty_and_odd(empty, odd):
    assert rows(empty) == []
    assert len(rows(odd)) == odd.count()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=30), max_size=6), st.integers(2, 9))
def test_anchors_never_count_too_low(texts, window):
    """The anchor of a window is an anchor place, so a repeated window has its anchor counted twice."""
    words = S.Words(pa.array([" ".join(t) for t in texts], pa.string()))
    where, least, chosen = S.anchors(words, window)
    counts = Counter(chosen.tolist())
    keys = Counter()
    flat = [w for t in texts for w in t]
    for k in where:
        keys[tuple(flat[k : k + window])] += 1
    for k, a in zip(where, least.tolist()):
        assert counts[a] >= min(2, keys[tuple(flat[k : k + window])])


def test_rolling_hash_depends_on_the_words_alone():
    rng = np.random.default_rng(1)
    w = rng.integers(0, 1 << 63, 50).astype(np.uint64)
    whole = S.rolling(w, 7, S.BASE[0])
    for k in (0, 13, 43):
        assert S.rolling(w[k : k + 7], 7, S.BASE[0])[0] == whole[k]


@given(st.lists(st.integers(0, 50), min_size=1, max_size=40), st.integers(1, 12))
def test_sliding(values, n):
    x = np.array(values, np.uint64)
    if len(x) >= n:
        assert S.sliding(x, n, np.minimum).tolist() == [min(values[i : i + n]) for i in range(len(x) - n + 1)]
