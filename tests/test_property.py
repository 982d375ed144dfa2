"""Random request trees against a small model of their meaning in plain Python."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.functions import text
from brindle.plans.request import where
from brindle.sources.indexing import indexed, read_json
from brindle.sources.namespace import Namespace

NS = Namespace.parse(
    {
        "name": "p",
        "prefix": "p",
        "fields": {
            "lit": {"type": "literal", "suffix": True},
            "many": {"type": "literal", "array": True, "suffix": True},
            "num": {"type": "number"},
            "flag": {"type": "boolean"},
            "one": {"type": "text"},
            "two": {"type": "text", "source": "lit,one"},
        },
    }
)
VALUES = ["Ab", "ab c", "Abc!", "cAb", "é", "", None, "b"]
DOCS = [
    {"id": f"{i}", "lit": VALUES[i % 8], "many": [v for v in VALUES[: i % 5] if v], "num": [None, -1, 0, 2.5, 7][i % 5], "flag": [True, False, None][i % 3],
     "one": ["ab the c", None, "é b", "cab cab"][i % 4]}
    for i in range(40)
]


@pytest.fixture(scope="module")
def docs(spark):
    import json

    raw = spark.createDataFrame([(json.dumps(d),) for d in DOCS], "value string")
    df = indexed(read_json(raw, NS), NS).persist()
    yield df
    df.unpersist()


def matches_word(word, query):
    bare = text.normalise(query)
    if query == "*":
        return True
    if query.endswith("*") and query.startswith("*"):
        return word.startswith(bare) and word.endswith(bare)
    if query.endswith("*"):
        return word.startswith(bare)
    if query.startswith("*"):
        return word.endswith(bare)
    return word == bare


def words(doc, name):
    sources = {"one": ["one"], "two": ["lit", "one"]}[name]
    whole = " ".join(doc[s] for s in sources if doc[s])
    return [w for w in text.tokenise(whole) if w not in text.stop_words("en")]


def holds(doc, name, value):
    values = value if isinstance(value, list) else [value]
    if not values:
        return True
    if name in ("lit", "many"):
        own = [doc[name]] if name == "lit" else doc[name]
        own = [text.normalise(v) for v in own if v not in (None, "")]
        return any(matches_word(w, q) for w in own for q in values)
    if name == "flag":
        return any(bool(doc["flag"]) == v for v in values)
    if name in ("one", "two"):
        return any(has_text(doc, [name], q) for q in values)
    tests = []
    for v in values:
        low, high = (v.get("min"), v.get("max")) if isinstance(v, dict) else (v, v)
        if low is None and high is None:
            return True
        x = doc["num"]
        tests.append(x is not None and (low is None or x >= low) and (high is None or x <= high))
    return any(tests)


def has_text(doc, names, query):
    parts = [[t for t in text.tokenise(p) if text.normalise(t) not in text.stop_words("en")] for p in query.lower().split(" or ")]
    parts = [p for p in parts if p]
    # the text fields have no suffix option: a leading star is dropped
    strip = lambda t: t.lstrip("*") if t != "*" else t
    return not parts or any(
        any(all(any(matches_word(w, strip(t)) for w in words(doc, n)) for t in p) for n in names) for p in parts
    )


def meets(doc, clause, join="$and"):
    if isinstance(clause, list):
        return (any if join == "$or" else all)([meets(doc, c) for c in clause])
    own, subs = [], []
    for key, value in clause.items():
        if key.startswith("$text"):
            own.append(has_text(doc, ["one", "two"], value))
        elif key.startswith("$not"):
            subs.append(not meets(doc, value))
        elif key.startswith("$or"):
            subs.append(meets(doc, value, "$or"))
        elif key.startswith("$and"):
            subs.append(meets(doc, value))
        else:
            own.append(holds(doc, key, value))
    if join == "$or" and isinstance(clause, dict):
        if not subs:
            return any(own) if own else True
        return all(own) and any(subs)
    return all(own) and all(subs)


literal = st.sampled_from(["ab", "AB", "ab*", "*b", "*b*", "*", "É", "ab c", "zz"])
number = st.one_of(
    st.sampled_from([-1, 0, 2.5]),
    st.fixed_dictionaries({}, optional={"min": st.sampled_from([None, -1, 0, 3]), "max": st.sampled_from([None, 0, 2.5, 9])}),
)
listed = lambda s: st.one_of(s, st.lists(s, max_size=3))
condition = st.one_of(
    st.tuples(st.sampled_from(["lit", "many"]), listed(literal)),
    st.tuples(st.just("num"), listed(number)),
    st.tuples(st.just("flag"), st.booleans()),
    st.tuples(st.just("$text"), st.sampled_from(["ab", "the", "ab c", "cab or é", "c* b", "zz or the ab"])),
    st.tuples(st.sampled_from(["one", "two"]), st.sampled_from(["cab", "ab c", "é or ab"])),
)
flat = st.lists(condition, max_size=3).map(dict)


def deeper(inner):
    sub = st.tuples(st.sampled_from(["$and", "$or", "$not", "$or1", "$not2"]), st.one_of(inner, st.lists(inner, min_size=1, max_size=2)))
    return st.tuples(flat, st.lists(sub, min_size=1, max_size=2)).map(lambda x: x[0] | dict(x[1]))


request = st.recursive(flat, deeper, max_leaves=5)


@settings(max_examples=10, deadline=None)
@given(st.lists(request, min_size=15, max_size=15))
def test_requests(docs, requests):
    columns = []
    for i, r in enumerate(requests):
        test = where(NS, r)
        columns.append((F.lit(True) if test is None else F.coalesce(test, F.lit(False))).alias(f"r{i}"))
    rows = {r["id"]: r for r in docs.select("id", *columns).collect()}
    for i, r in enumerate(requests):
        want = [d["id"] for d in DOCS if meets(d, r)]
        assert [d["id"] for d in DOCS if rows[d["id"]][f"r{i}"]] == want, r
