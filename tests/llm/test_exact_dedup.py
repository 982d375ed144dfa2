import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from brindle.llm import exact_dedup as E
from brindle.llm.common import PORTION


@given(st.sets(st.integers(0, (1 << 48) - 1), min_size=1, max_size=200), st.integers(0, 47))
def test_golomb_round_trip(values, k):
    k = max(k, 36)  # quotients stay short
    v = np.array(sorted(values), np.uint64)
    assert (E.golomb_decode(E.golomb_encode(v, k), len(v), k) == v).all()


@given(st.sets(st.integers(0, 5000), min_size=1), st.integers(0, 12))
def test_golomb_round_trip_dense(values, k):
    v = np.array(sorted(values), np.uint64)
    assert (E.golomb_decode(E.golomb_encode(v, k), len(v), k) == v).all()


@given(st.text(alphabet=" \t\n\x0b\x0c\rab\x1c\xa0é", max_size=12))
def test_normalise(text):
    assert E.normalise(text.encode()).decode() == re.sub(r"[\x20\x09-\x0D]+", " ", text)


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for t, ids in groups.items():
        first = min(ids, key=lambda x: (x is None, x or 0))
        left = [first]
        for i in ids:
            kept = i == first and bool(left)
            if kept:
                left.pop()
            out.append((i, first, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(both):
    got = sorted(map(tuple, E.duplicate_classes(both).collect()), key=str)
    assert got == brute([tuple(r) for r in both.collect()])


def test_fingerprint_collisions_are_told_apart(documents):
    """With few fingerprint bits nearly all rows are suspects; the texts decide."""
    rows = documents.select("doc_id", "text")
    got = sorted(map(tuple, E.duplicate_classes(rows, fp_bits=5).collect()), key=str)
    assert got == brute([tuple(r) for r in rows.collect()])


def test_deduplicate_keeps_columns_and_one_of_each(odd):
    kept = E.deduplicate(odd)
    assert kept.columns == odd.columns and kept.schema == odd.schema
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(i for i, t in rows if t == "one") == [4]
    assert len(rows) == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows}) == 10


def test_empty(empty):
    assert E.duplicate_classes(empty).collect() == []
    assert E.deduplicate(empty).collect() == []


@pytest.mark.parametrize("copies", [400])
def test_a_hot_group(spark, copies):
    df = spark.range(copies * 3).selectExpr("id as doc_id", f"if(id < {copies}, 'same  text', concat('t', id)) as text").repartition(7)
    rows = E.duplicate_classes(df).where("group_size > 1").collect()
    assert len(rows) == copies and {r["keep_id"] for r in rows} == {0} and sum(r["kept"] for r in rows) == 1


def test_invalid_utf8_is_compared_by_bytes(spark):
    df = spark.sql("select * from values (1L, X'61FF'), (2L, X'61FE'), (3L, X'61FF'), (4L, X'61C3') t(doc_id, b)")
    df = df.selectExpr("doc_id", "cast(b as string) as text").repartition(2)
    assert sorted((r["doc_id"], r["keep_id"]) for r in E.duplicate_classes(df).collect()) == [(1, 1), (2, 2), (3, 1), (4, 4)]
    assert sorted(r["doc_id"] for r in E.deduplicate(df).collect()) == [1, 2, 4]


def test_columns_of_any_name_stay(spark):
    df = spark.createDataFrame([(1, "a", 77, "x"), (2, "a", 78, "y"), (3, "b", 79, "z")], "doc_id long, text string, __uid long, `a.b` string")
    kept = E.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect())) == [(1, "a", 77, "x"), (3, "b", 79, "z")]


def test_a_hot_class_without_adaptive_execution(spark, monkeypatch):
    from brindle.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 50)
    monkeypatch.setattr(common, "HOT_KEYS", 4)
    df = spark.range(900).selectExpr("id as doc_id", "if(id % 3 = 0, 'same', concat('t', id div 2)) as text").repartition(5)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = sorted(map(tuple, E.duplicate_classes(df).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert rows == brute([tuple(r) for r in df.collect()])


def sent(monkeypatch, texts, owners=7, rows=None):
    """What a task with these texts, in batches of `rows`, passes on; its largest batch."""
    monkeypatch.setattr(E, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("T", (), {"partitionId": lambda self: 3})())}))
    whole = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts), pa.nulls(len(texts), pa.int64())], names=["doc_id", "text", "row_id"])
    rows = rows or len(texts)
    out, most = [], 0
    for batch in E._send(owners, E.FP_BITS)(whole.slice(i, rows) for i in range(0, len(texts), rows)):
        most = max(most, batch.nbytes)
        out += batch.to_pylist()
    return out, most


def test_a_task_passes_its_rows_on_in_portions(monkeypatch):
    """One batch of a whole chunk was held twice by Python and once more by the executor, outside its heap."""
    texts = [f"{i % 50} " + "x" * (1 << 20) for i in range(80)]
    rows, most = sent(monkeypatch, texts)
    assert most < 2 * PORTION
    assert sorted(r["doc_id"] for r in rows if r["kind"] == 0) == list(range(80))
    assert len({r["chunk"] for r in rows}) == 3  # chunks are as large as ever


@pytest.mark.parametrize("batch, portion, chunk", [(9, 40, 700), (200, 1, 1), (1, 10**6, 300), (200, 10**6, 10**6)])
def test_places_in_messages_whatever_the_portions(monkeypatch, batch, portion, chunk):
    texts = [None if i % 29 == 0 else f"text  {i % 83}" for i in range(200)]
    monkeypatch.setattr(E, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(E, "portions", lambda b, column, f=E.portions: f(b, column, portion))
    rows, _ = sent(monkeypatch, texts, rows=batch)
    span = -(-(1 << E.FP_BITS) // 7)
    prints = {
        (r["chunk"], r["owner"]): E.golomb_decode(r["payload"], r["slot"], r["pos"]) + np.uint64(r["owner"] * span) for r in rows if r["kind"] == 1
    }
    own = [r for r in rows if r["kind"] == 0]
    assert [r["doc_id"] for r in own] == list(range(200))
    assert len({(r["chunk"], r["pos"]) for r in own}) == 200
    for r in own:
        digest = hashlib.sha256((texts[r["doc_id"]] or "").replace("  ", " ").encode()).digest()
        assert r["text_sha256"] == digest.hex()
        assert prints[r["chunk"], r["owner"]][r["slot"]] == int.from_bytes(digest[:6], "big")
        assert r["twice"] == (sum(x["chunk"] == r["chunk"] and x["text_sha256"] == r["text_sha256"] for x in own) > 1)


def test_tasks_get_texts_in_small_batches(spark, monkeypatch):
    """Arrow batches of 10,000 rows of any length were up to 64 MB, in the executor and again in Python."""
    send, most = E._send, 2 * PORTION

    def watched(owners, bits):
        def run(batches):
            def small():
                for batch in batches:
                    assert batch.nbytes < most, batch.nbytes
                    yield batch

            return send(owners, bits)(small())

        return run

    monkeypatch.setattr(E, "_send", watched)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    df = spark.range(0, 3000, 1, 1).selectExpr("id as doc_id", "concat(id div 2, repeat('x', 6000)) as text")
    assert E.duplicate_classes(df).where("kept").count() == 1500
    assert spark.conf.get(key) == before
