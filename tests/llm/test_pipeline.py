"""The registered queries and the pipeline over whole small tables."""

import pytest

import __spark_entry__
import corpus_pipeline
from brindle.llm import queries
from brindle.llm.common import written

from ..oracle import connect, spark_rows, sql_rows
from .test_simhash import kept_by_brute_force


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, sf, name):
    assert spark_rows(queries.QUERIES[name](spark, sf)) == sql_rows(connect(sf), queries.SQL[name])


def test_every_query_is_registered():
    assert set(__spark_entry__.queries()) >= {*queries.QUERIES, "pipeline"}
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, count = docs.columns, docs.count()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "decontaminate", "byte_bpe"]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf), name)
        if name != "byte_bpe":
            assert docs.columns == columns
        assert 0 < docs.count() <= count
        count = docs.count()
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, docs.collect()))


def test_stages_take_odd_rows(spark, sf, odd):
    docs = odd.select("doc_id", "text", "lang", "uid")
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, sf), name)
        assert name == "byte_bpe" or out.columns == docs.columns
        assert stage(spark, docs.limit(0), sf).collect() == []


def test_near_copies_of_a_run_against_brute_force(spark, sf, tmp_path, monkeypatch):
    """The rows of run() are those of exact Jaccard components at 0.8, with longer and shorter copies
    and pairs just below among the documents."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    base = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect() if r["text"]]
    rows = {t: i for i, t in sorted(base, reverse=True)}
    long = [t for t in rows if 120 < len(t.split()) < 600][:30]
    for k, t in enumerate(long):
        words = t.split()
        for m, cut in enumerate((0.1, 0.18, 0.24, 0.29)):
            n = int(len(words) * cut)
            rows.setdefault(" ".join(words[n:]), 10_000_000 + 10 * k + m)
            rows.setdefault(" ".join(words + [f"x{k}y{j}" for j in range(n)]), 10_000_005 + 10 * k + m)
    given = [(i, t) for t, i in rows.items()]
    spark.createDataFrame(given, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    stages = [(n, f) for n, f in corpus_pipeline.STAGES if n in ("exact_dedup", "near_dedup", "byte_bpe")]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    got = sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == kept_by_brute_force(given)
