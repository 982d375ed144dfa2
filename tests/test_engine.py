"""Namespaces, documents, requests and responses on hand-written documents."""

import json
from datetime import UTC, datetime

import pytest

from brindle.plans.search import Search
from brindle.sources import files, store
from brindle.sources.namespace import Namespace, SchemaError
from brindle.sources.store import Engine, read_json_lines, read_table, write_documents
from brindle.streaming.upserts import delete_stream, purge, upsert_stream

CONFIG = {
    "name": "auctions",
    "prefix": "A",
    "expirationField": "endDate",
    "fields": {
        "active": {"type": "boolean", "sort": True, "facet": True},
        "year": {"type": "smallinteger", "sort": True},
        "make": {"type": "literal", "sort": True, "facet": True, "suffix": True},
        "model": {"type": "literal", "sort": True},
        "odometer": {"type": "integer", "sort": True},
        "price": {"type": "number", "sort": True, "facet": True},
        "endDate": {"type": "date", "sort": True},
        "startDate": {"type": "date", "sort": True, "facet": True},
        "networks": {"type": "literal", "array": True, "facet": True, "sort": True},
        "network": {"type": "literal", "defaultValue": "Public", "facet": True},
        "hidden": {"type": "literal", "index": False},
        "winner": {"type": "integer"},
        "hasWinner": {"type": "boolean", "source": "winner"},
        "title": {"type": "text", "source": "year,make,model"},
        "notes": {"type": "text", "stem": True},
        "coords": {"type": "geo"},
        "reach": {"type": "number"},
    },
    "composites": {"c": {"fields": ["make", "active", "year"]}},
}

DOCS = [
    {"id": "1", "make": "O'Neil & Sons, Inc.", "model": "ÉCOLE", "year": 65537, "price": 0, "active": True, "odometer": "12abc",
     "networks": ["a", "a", "b"], "coords": [0, 0], "notes": "Running dogs of the town", "winner": 5, "startDate": "2024-01-01T00:00:00.9Z"},
    {"id": "2", "make": "Ford", "model": "F-150", "year": -1, "price": -5, "active": False, "odometer": "x",
     "networks": [], "coords": [10, 179.9], "notes": "a dog runs", "winner": 0, "startDate": "2024-01-01T00:00:00", "reach": 1000},
    {"id": "3", "make": "ford*", "model": "", "price": "3.5", "active": "false", "networks": "solo", "coords": [10, -179.9],
     "endDate": "2030-01-01", "startDate": "2024-01-02", "reach": None},
    {"id": "4", "make": "Fjord", "price": None, "active": 0, "odometer": 7.9, "coords": [86, 10], "endDate": "2020-01-01T00:00:00Z", "network": "private"},
    {"id": "5", "make": "FORD", "active": 1, "coords": [1, None], "notes": "cats", "hidden": "x", "endDate": "2030-06-01T02:00:00+02:00"},
]
NOW = datetime(2025, 1, 1, tzinfo=UTC)


@pytest.fixture(scope="module")
def cars(spark, tmp_path_factory):
    engine = Engine(spark, f"file://{tmp_path_factory.mktemp('engine')}")
    collection = engine.create_namespace(CONFIG)
    collection.add_documents(DOCS)
    held = collection.raw().persist()
    yield collection, held
    held.unpersist()


def ids(cars, query, **more):
    collection, held = cars
    rows = Search.plan(held, collection.ns, {"query": query, **more}).matches
    return [r["id"] for r in rows.orderBy("id").collect()]


@pytest.mark.parametrize(
    ("query", "want"),
    [
        (None, "12345"),
        ({}, "12345"),
        ({"make": "oneil sons"}, ""),
        ({"make": "ONEIL  sons inc"}, "1"),
        ({"make": "ford"}, "235"),
        ({"make": ["ford", "fjo*"]}, "2345"),
        ({"make": "*ord"}, "2345"),
        ({"make": "*ford*"}, "235"),
        ({"make": "f*rd"}, ""),
        ({"model": "*"}, "12"),
        ({"model": "ecole"}, "1"),
        ({"make": []}, "12345"),
        ({"year": 65536}, "1"),
        ({"year": {"max": 0}}, "2"),
        ({"price": {"max": 5}}, "123"),
        ({"price": {"min": 0, "max": 5}}, "13"),
        ({"price": {"min": -10}}, "123"),
        ({"price": {"min": None, "max": None}}, "12345"),
        ({"price": {"min": -5, "minExcl": True}}, "13"),
        ({"price": [0, {"min": 3}]}, "13"),
        ({"odometer": 12}, "1"),
        ({"odometer": 7}, "4"),
        ({"active": True}, "135"),
        ({"active": False}, "24"),
        ({"hasWinner": True}, "1"),
        ({"network": "public"}, "1235"),
        ({"networks": "a"}, "1"),
        ({"networks": ["b", "solo"]}, "13"),
        ({"networks": "*"}, "13"),
        ({"startDate": "2024-01-01"}, "12"),
        ({"startDate": {"min": "2024-01-01T00:00:01Z"}}, "3"),
        ({"coords": {"from": [10, 180], "radius": 50}}, "23"),
        ({"coords": {"from": [10, 180], "radius": 20, "unit": "mi"}}, "23"),
        ({"coords": {"from": [10, 180], "radius": 5, "unit": "km"}}, ""),
        ({"coords": {"from": [10, 180]}}, "1234"),
        ({"coords": {"from": [86, 10], "radius": 1, "unit": "ft"}}, "4"),
        ({"coords": [{"from": [0, 0], "radius": 1}, {"from": [86, 10], "radius": 1}]}, "14"),
        ({"coords": {"from": [10, 179.9], "radiusField": "reach"}}, "1234"),
        ({"coords": {"from": [11, 179.9], "radiusField": "reach"}}, "134"),
        ({"$text": "run dog"}, "12"),
        ({"$text": "the running"}, "12"),
        ({"$text": "ford 150 or cat"}, "5"),
        ({"$text": "65537 oneil"}, "1"),
        ({"$text": "f-150|ecole"}, "12"),
        ({"$text": "the"}, "12345"),
        ({"notes": "dogs"}, "12"),
        ({"notes": ["dogs", "cats"]}, "125"),
        ({"notes": ["the", "of"]}, "12345"),
        ({"notes": ["the", "dogs"]}, "12345"),
        ({"$or": [{"make": "fjord"}, {"price": 0}]}, "14"),
        ({"$or": {"make": "fjord", "price": 0}}, "14"),
        ({"make": "ford", "$or": [{"price": -5}, {"active": True}]}, "235"),
        ({"$not": {"make": "ford"}}, "14"),
        ({"$not": [{"make": "ford"}, {"active": True}]}, "124"),
        ({"$not1": {"make": "ford"}, "$not2": {"price": 0}}, "4"),
        ({"$or": [{"$not": {"make": "f*"}}, {"price": -5}]}, "12"),
        ({"$and": [{"make": "ford"}, {"active": True}]}, "35"),
        ([{"make": "ford"}, {"active": True}], "35"),
        ({"$not": {"price": {"min": 0}}}, "245"),
        ({"make": "ford", "active": True, "year": []}, "35"),
    ],
)
def test_query(cars, query, want):
    assert "".join(ids(cars, query)) == want


@pytest.mark.parametrize(
    "query",
    [{"nothing": 1}, {"hidden": "x"}, {"make": None}, {"price": None}, {"price": "abc"}, {"$foo": 1},
     {"coords": {"radius": 1}}, {"coords": {"from": [0, 0], "radius": 1, "unit": "yd"}}, {"coords": {"from": [0, 0], "radiusField": "make"}}, 7],
)
def test_bad_query(cars, query):
    with pytest.raises(SchemaError):
        ids(cars, query)


def answer(cars, **request):
    collection, held = cars
    return Search.plan(held, collection.ns, request).response()


def order(cars, **request):
    return "".join(json.loads(x)["id"] for x in answer(cars, **request)["items"])


def test_sorts(cars):
    assert order(cars) == "12345"
    assert order(cars, sort=[{"field": "price"}]) == "45213"
    assert order(cars, sort=[{"field": "price", "order": "DESC"}]) == "31245"
    assert order(cars, sort=[{"field": "make"}, {"field": "active", "order": "DESC"}]) == "43521"
    assert order(cars, sort=[{"field": "networks", "order": "DESC"}]) == "31245"
    assert order(cars, start=1, count=2) == "23"
    assert order(cars, start=9) == ""
    told = {"d": {"type": "distance", "field": "coords", "from": [10, 179.9], "unit": "km"}, "?": {"type": "other"}}
    found = answer(cars, expr=told, sort=[{"field": "d", "order": "DESC"}])
    assert [json.loads(x)["id"] for x in found["items"]][-1] == "5" and list(found["exprs"]) == ["d"]
    assert found["exprs"]["d"][3] == 0.0 and found["exprs"]["d"][-1] is None
    for bad in ([{"field": "price", "order": "UP"}], [{"field": "winner"}], [{"field": "nope"}]):
        with pytest.raises(SchemaError):
            answer(cars, sort=bad)


def test_response(cars):
    found = answer(cars, query={"make": "ford"}, count=1, idsOnly=True)
    assert (found["totalFound"], found["start"], found["count"], found["items"]) == (3, 0, 1, ['{"id":"2"}'])
    none = answer(cars, query={"make": "zzz"}, facets={"m": {"field": "make"}})
    assert none["totalFound"] == 0 and none["facets"] == {} and none["items"] == []
    counts = answer(cars, count=0, facets={"m": {"field": "make"}})
    assert counts["items"] == [] and len(counts["facets"]["m"]) == 5
    assert json.loads(answer(cars, query={"price": "3.5"})["items"][0]) == DOCS[2]


def test_facets(cars):
    told = {
        "make": {"field": "make", "count": 3},
        "active": {"field": "active", "order": "DESC"},
        "networks": {"field": "networks", "order": "DESC"},
        "start": {"field": "startDate"},
        "price": {"buckets": [{"field": "price", "max": 0, "maxExcl": True, "label": "minus"}, {"field": "price", "min": 0}, {"field": "price", "min": 99}]},
    }
    found = answer(cars, facets=told)["facets"]
    assert [(x["value"], x["count"]) for x in found["make"]] == [("Fjord", 1), ("FORD", 1), ("Ford", 1)]
    assert found["active"] == [{"value": True, "count": 3}, {"value": False, "count": 2}]
    assert found["networks"] == [{"value": "a", "count": 2}, {"value": "solo", "count": 1}, {"value": "b", "count": 1}]
    assert found["start"][0] == {"value": "2024-01-02T00:00:00+00:00", "count": 1}
    assert found["price"] == [{"value": "minus", "count": 1}, {"value": "[0,[", "count": 2}]
    with pytest.raises(SchemaError):
        answer(cars, facets={"x": {"field": "model"}})


def test_documents(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}")
    collection = engine.create_namespace(CONFIG)
    assert collection.search({})["totalFound"] == 0
    with pytest.raises(KeyError):
        collection.get("1")
    collection.add_documents(DOCS)
    assert collection.search({})["totalFound"] == 4  # document 4 has expired
    collection.add_documents([{"id": "2", "make": "Kia"}, {"id": "9", "make": "Opel"}, {"id": "2", "make": "Seat"}])
    assert collection.get(2) == {"id": "2", "make": "Seat"}
    assert [json.loads(x)["id"] for x in collection.search({})["items"]] == ["1", "2", "3", "5", "9"]
    collection.delete([1, "3", {"id": "9"}, "nobody"])
    assert [json.loads(x)["id"] for x in collection.search({})["items"]] == ["2", "5"]
    collection.add_documents([{"id": "1", "make": "back"}])
    collection.reindex()
    assert [json.loads(x)["id"] for x in collection.search({"query": {"make": "back"}})["items"]] == ["1"]
    purge(collection, NOW)
    assert collection.raw().count() == 3 and collection.search({})["totalFound"] == 3
    with pytest.raises(SchemaError):
        collection.add_documents([{"make": "no id"}])
    assert engine.use_namespace("auctions").get("5")["hidden"] == "x"
    write_documents(collection.docs(), f"{tmp_path}/out")
    assert read_json_lines(spark, f"{tmp_path}/out").count() == 3
    assert read_table(spark, "/root/testdata/sf0.001/region.parquet").count() == 5
    engine.drop_namespace("auctions")
    with pytest.raises(KeyError):
        engine.use_namespace("auctions")


def test_writers_at_once(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}")
    one = engine.create_namespace(CONFIG)
    two = engine.use_namespace("auctions")
    assert one.add_documents([{"id": "1", "make": "Kia"}]) == 1
    began = []

    def slowly(old):
        began.append(two.version())
        if len(began) == 1:  # another writer commits between this one's reading and its commit
            two.add_documents([{"id": "2", "make": "Seat"}])
        return old.where("id <> '1'")

    assert one._commit(slowly) == 3 and began == [1, 2]
    assert [r["id"] for r in one.raw().collect()] == ["2"]
    one.vacuum()
    assert [r["id"] for r in two.raw().collect()] == ["2"]
    assert len([p for p in (tmp_path / "auctions").iterdir() if p.name.startswith("v")]) == 1


def test_dead_writer(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "PATIENCE", 0.5)
    collection = Engine(spark, f"file://{tmp_path}").create_namespace(CONFIG)
    collection.add_documents([{"id": "1", "make": "Kia"}])
    assert files.create_text(spark, collection._entry(2), "")  # died before it named its folder
    assert collection.version() == 1 and collection.get("1")["make"] == "Kia"
    assert collection.add_documents([{"id": "2", "make": "Seat"}]) == 3
    assert collection.raw().count() == 2


def test_unchanged_documents_are_not_written(spark, tmp_path):
    collection = Engine(spark, f"file://{tmp_path}").create_namespace(CONFIG)
    assert collection.add_documents(DOCS) == 1 and collection.add_documents(DOCS[:2]) == 1
    assert collection.add_documents([DOCS[0], {"id": "1", "make": "other"}]) == 2
    assert collection.delete(["1"]) == 3 and collection.add_documents(DOCS[:1]) == 4
    assert collection.expire(NOW) == collection.expire(NOW)


def test_messages(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}")
    assert engine.handle({"action": "createNamespace", "input": CONFIG})["name"] == "auctions"
    assert engine.handle({"action": "addDocuments", "ns": "auctions", "input": DOCS[:2]})["success"]
    assert engine.handle({"action": "search", "ns": "auctions", "input": {"query": {"make": "ford"}}})["totalFound"] == 1
    assert engine.handle({"action": "getDocument", "ns": "auctions", "input": "1"})["id"] == "1"
    assert engine.handle({"action": "deleteDocuments", "ns": "auctions", "input": ["1"]})["success"]
    assert engine.handle({"action": "getNamespaceConfig", "ns": "auctions"}) == CONFIG
    assert list(engine.namespace_configs()) == ["auctions"]
    assert not engine.handle({"action": "getDocument", "ns": "auctions", "input": "1"})["success"]
    assert "unknown action" in engine.handle({"action": "nope", "ns": "auctions"})["error"]


def test_streams(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/engine")
    collection = engine.create_namespace(CONFIG)
    (tmp_path / "in").mkdir()
    for batch in (DOCS[:3], [{"id": "2", "make": "Kia"}, DOCS[4]]):
        (tmp_path / "in" / f"{len(batch)}.json").write_text("\n".join(map(json.dumps, batch)))
        lines = spark.readStream.text(f"file://{tmp_path}/in")
        upsert_stream(lines, collection, f"file://{tmp_path}/c1").awaitTermination()
    assert collection.search({})["totalFound"] == 4 and collection.get("2")["make"] == "Kia"
    (tmp_path / "gone").mkdir()
    (tmp_path / "gone" / "a.json").write_text('{"id": "2"}\n{"id": "3"}')
    gone = spark.readStream.schema("id string").json(f"file://{tmp_path}/gone")
    delete_stream(gone, collection, f"file://{tmp_path}/c2").awaitTermination()
    assert collection.search({})["totalFound"] == 2


@pytest.mark.parametrize(
    "config",
    [
        {"prefix": "x"},
        {"name": "x"},
        {"name": "x", "prefix": "x", "fields": {"a": {"type": "highcard"}}},
        {"name": "x", "prefix": "x", "fields": {"a": {"type": "geo", "sort": True}}},
        {"name": "x", "prefix": "x", "fields": {"a": {"type": "boolean", "source": "b"}}},
        {"name": "x", "prefix": "x", "fields": {"a": {"type": "literal"}, "t": {"type": "text"}}, "composites": {"c": {"fields": ["a", "t"]}}},
        {"name": "x", "prefix": "x", "fields": {"a": {"type": "literal"}}, "composites": {"c": {"fields": ["a"]}}},
        {"name": "x", "prefix": "x", "expirationField": "a", "fields": {"a": {"type": "literal"}}},
    ],
)
def test_bad_config(config):
    with pytest.raises(SchemaError):
        Namespace.parse(config)
