import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import url_rules as U
from brindle.llm.queries import RULES


def brute(url, rules, default="allow"):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


def judged(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, rule string").repartition(3)
    rows = U.judge(pages, U.rule_table(spark, rules)).collect()
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}


ODD = [None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.COM/en/x?q", "http://example.com", "http://example.com/en", "http://example.com/en/",
       "http://a.b.example.com/en/1", "http://notexample.com/en/1", "http://com/", "http://com", "ftp://x.net/es/#y", "a://b://c.net/fr/", "http://x.net/fr",
       "http://É.net/es/é", "http://x.com/\n/y", "http://..com//", "http://com./", "http://net?/es/", "http://user@x.net:80/es/", "http://x.net/es/" + "\U0010ffff" * 3,
       "http://" + "a." * 300 + "net/es/", "http://example.com/en/", "http://example.com/en/"]


def test_odd_urls(spark):
    got = judged(spark, ODD, RULES)
    assert got == {i: brute(u, RULES) for i, u in enumerate(ODD)}


NESTED = [("a", "", "block"), ("a", "/", "allow"), ("a", "/x", "block"), ("a", "/x/y/", "allow"), ("b.a", "/x", "allow"), ("", "/", "block"), ("c", "/é", "block")]
host = st.lists(st.sampled_from(["a", "b", "c", ""]), max_size=4).map(".".join)
path = st.lists(st.sampled_from(["/", "x", "y", "é", "/x/y/"]), max_size=4).map("".join)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(host, path), min_size=1, max_size=40))
def test_nested_rules(spark, parts):
    urls = [f"s://{h}{p}" for h, p in parts]
    rules = [r for r in NESTED if r[0]]
    got = judged(spark, urls, rules)
    assert got == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {tuple(r) for r in U.judge(pages, U.rule_table(spark, RULES)).collect()}
    assert got == {(r["page_id"], *brute(r["url"], RULES)) for r in pages.collect()}


def test_a_hot_host_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(U, "RUN", 10)
    urls = [f"http://h{i % 3}.example.com/{'en' if i % 2 else 'de'}/{i}" for i in range(500)]
    assert judged(spark, urls, RULES) == {i: brute(u, RULES) for i, u in enumerate(urls)}


def test_equal_rules_block(spark):
    rules = [("a", "/", "allow"), ("a", "/", "block")]
    assert judged(spark, ["s://a/"], rules)[0] == ("a", "/", "a/", "block")


@pytest.mark.parametrize("rules", [[], RULES])
def test_empty(spark, rules):
    assert judged(spark, ["http://x.org/"], rules)[0] == ("x.org", "/", None, "allow")
    pages = spark.createDataFrame([], "page_id long, url string")
    assert U.judge(pages, U.rule_table(spark, rules)).collect() == []


def test_plan_is_native(spark, sf):
    plan = U.judge(spark.read.parquet(f"{sf}/pages.parquet"), U.rule_table(spark, RULES))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
