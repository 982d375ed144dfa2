import zlib
from collections import Counter, defaultdict

from brindle.llm import sharding as S


def test_law_and_columns(both):
    rows = S.assign(both, [1.0] * 40).collect()
    texts = [(i, t or "") for i, t in both.collect()]
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter(
        (i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in texts
    )
    by_key, slots = defaultdict(set), defaultdict(list)
    for r in rows:
        by_key[r["doc_id"]].add((r["shard"], r["grown_shard"]))
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 40)
    assert all(len(x) == 1 for x in by_key.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_key_alone_decides(spark, both):
    first = {r["doc_id"]: r["shard"] for r in S.assign(both, [1.0] * 40).collect()}
    other = both.selectExpr("doc_id", "'changed' as text").repartition(2)
    assert {r["doc_id"]: r["shard"] for r in S.assign(other, [1.0] * 40).collect()} == first
    grown = {r["doc_id"]: r["grown_shard"] for r in S.assign(both, [1.0] * 40).collect()}
    assert {r["doc_id"]: r["shard"] for r in S.assign(other, [1.0] * 41).collect()} == grown


def test_weights(spark):
    keys = spark.range(20000).selectExpr("id as doc_id", "'' as text")
    got = Counter(r["shard"] for r in S.assign(keys, [1.0, 2.0, 0.0, 5.0], grown=[1.0, 2.0, 0.0, 5.0, 2.0]).collect())
    assert set(got) == {0, 1, 3}
    for shard, weight in ((0, 1), (1, 2), (3, 5)):
        assert abs(got[shard] / 20000 - weight / 8) < 0.015


def test_moves_are_few(spark):
    keys = spark.range(20000).selectExpr("id as doc_id", "'' as text")
    rows = S.assign(keys, [1.0] * 40).collect()
    assert abs(sum(r["grown_shard"] == 40 for r in rows) / 20000 - 1 / 41) < 0.006


def test_plan_is_native(both):
    plan = S.assign(both, [1.0] * 40)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty(empty):
    assert S.assign(empty, [1.0] * 40).collect() == []
