import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from brindle.llm import quality as Q

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = Q.classify(docs, labels).join(labels, "doc_id", "left").collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"] and r["quality"] is not None]
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.97
    good = [r["score"] for r in held if r["quality"] == 1]
    bad = [r["score"] for r in held if r["quality"] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.98
    assert sum(s >= 0.3 for s in good) / len(good) > 0.99


def test_held_out_labels_are_never_read(spark, documents, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.withColumn("quality", F.when(Q.fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    docs = documents.select("doc_id", "text").coalesce(1)
    first = {r["doc_id"]: r["score"] for r in Q.classify(docs, labels).collect()}
    assert {r["doc_id"]: r["score"] for r in Q.classify(docs, turned).collect()} == first


def test_sum_of_squares_identity():
    rng = np.random.default_rng(3)
    machine = Q.Machine(0.3)
    machine.w = rng.normal(size=Q.FEATURES).astype(np.float32)
    ids, x = rng.choice(Q.FEATURES, 12, replace=False), rng.random(12).astype(np.float32)
    slow = 0.3 + machine.w[ids] @ x + sum(
        machine.v[ids[i]] @ machine.v[ids[j]] * x[i] * x[j] for i in range(12) for j in range(i + 1, 12)
    )
    assert abs(machine.margins(np.array([0, 12]), ids, x)[0][0] - slow) < 1e-4


def test_features_are_per_text():
    texts = ["", None, "One two two!! 3", "é\n\nÈ", "x " * 5000]
    bounds, ids, values = Q.features(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        b, own, x = Q.features(pa.array([t], pa.string()))
        assert ids[bounds[i] : bounds[i + 1]].tolist() == own.tolist() and values[bounds[i] : bounds[i + 1]].tolist() == x.tolist()
        assert len(set(own)) == len(own) and own.max() < Q.FEATURES
    assert Q.features(pa.array([], pa.string()))[0].tolist() == [0]


def test_without_labels(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = Q.classify(odd, none).collect()
    assert len(rows) == odd.count() and {r["score"] for r in rows} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(1, 9)], "doc_id long, quality int")
    assert {r["score"] for r in Q.classify(odd, one).collect()} == {1.0}
    assert Q.classify(empty, one).collect() == []


def test_odd_rows_get_scores(spark, odd, sf, documents):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    machine = Q.train(documents, labels)
    rows = Q.score(odd, machine).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 5}) == 1


def test_keep_good(spark, documents, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = Q.keep_good(documents, labels)
    assert kept.schema == documents.schema
    want = {r["doc_id"] for r in Q.classify(documents, labels).where("predicted = 1").collect()}
    rows = kept.collect()
    assert {r["doc_id"] for r in rows} == want and len(rows) == len(want)
    assert {r["doc_id"]: r["text"] for r in rows}.items() <= {r["doc_id"]: r["text"] for r in documents.collect()}.items()


def slow_features(text):
    """Feature numbers and values of one text, word by word."""
    text = text or ""
    words = [w.decode() for w in text.encode().split()]
    n, chars = max(len(words), 1), max(sum(map(len, words)), 1)
    symbols = [sum(not c.isalpha() and not c.isdigit() for c in w) for w in words]
    shares = [
        np.log2(1 + len(words)) / 20,
        np.log2(1 + len(text.encode())) / 28,
        min(chars / n / 16, 1),
        sum(w.isupper() and sum(c.isalpha() for c in w) > 1 for w in words) / n,
        sum(symbols) / chars,
        sum(s > 0 for s in symbols) / n,
        sum(c.isdigit() for w in words for c in w) / chars,
        len(set(words)) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        min(4 * text.count("\n") / n, 1),
    ]
    buckets = {Q.xxhash.xxh64_intdigest(w.lower().encode()) >> (64 - Q.WORD_BITS) for w in words}
    out = {b: 1 / np.sqrt(len(buckets)) for b in buckets}
    out |= {(1 << Q.WORD_BITS) + k * Q.BINS + min(int(s * Q.BINS), Q.BINS - 1): 1.0 for k, s in enumerate(shares)}
    return out


def test_query_against_pairwise_interactions(spark, sf):
    """op9's scores, each recomputed from its text by summing over all pairs of features."""
    from brindle.llm import queries

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    machine = Q.train(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = queries.op9_quality(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        x = slow_features(texts[r["doc_id"]])
        ids, values = np.array(list(x)), np.array(list(x.values()))
        v = machine.v[ids] * values[:, None]
        pairs = np.triu(v @ v.T, 1).sum()
        margin = machine.bias + machine.w[ids] @ values + pairs
        assert abs(r["score"] - 1 / (1 + np.exp(-margin))) < 1e-3, r["doc_id"]
        assert r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_conflicting_labels_and_repeated_ids(spark, documents, sf):
    """Neither the order of rows nor an id labelled both ways changes what is learnt."""
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    free = [i for i in range(10_000, 10_040) if zlib.crc32(str(i).encode()) % 5]
    both = spark.createDataFrame([(i, q) for i in free for q in (0, 1)], "doc_id long, quality int")
    text = spark.createDataFrame([(i, f"odd one {i}") for i in free], "doc_id long, text string")
    some = documents.select("doc_id", "text")
    more = some.union(some.selectExpr("doc_id", "concat('zz ', text) as text")).union(some).union(text)
    first, again = Q.train(more, labels.union(both)), Q.train(more.repartition(3), both.union(labels).repartition(2))
    assert (first.w == again.w).all() and (first.v == again.v).all()
    small = Q.train(more, labels, features_bound=3000)
    assert isinstance(small, Q.Machine) and (small.w != 0).sum() < (first.w != 0).sum()
