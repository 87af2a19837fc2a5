"""Document-style predicates over nested JSON items."""

import json

import pytest
from pyspark.sql import functions as F

from corpuskit.functions import jsonq
from corpuskit.operators import items as I



def _item(key, title, short, doi, *creators):
    return {"key": key, "data": {"title": title, "shortTitle": short, "DOI": doi, "url": f"https://library.test/{key}",
                                 "creators": [{"lastName": n, "creatorType": kind} for n, kind in creators]}}


ITEMS = [_item("k1", "On Tides", "Tides", "10.5555/t.1", ("Okafor", "author"), ("Lind", "author")),
         _item("k2", "Salt Marshes", "Marsh", "10.5555/t.2", ("Reyes", "author")),
         _item("k3", "River Deltas", "Deltas", "10.5555/t.3", ("Mori", "author"), ("Lind", "editor"))]
ALL = ["k1", "k2", "k3"]
CASES = [
    # one key: top level, nested in an array, absent value
    ({"title": "Salt Marshes"}, ["k2"]), ({"DOI": "10.5555/t.3"}, ["k3"]), ({"creators.lastName": "Lind"}, ["k1", "k3"]),
    ({"shortTitle": "Dunes"}, []),
    # nothing asked for finds nothing
    ({}, []), ([], []),
    # a list of queries: all must hold
    ([{"title": "On Tides"}, {"shortTitle": "Tides"}], ["k1"]), ([{"title": "On Tides"}, {"shortTitle": "Marsh"}], []),
    ([{"creators.lastName": "Lind"}, {"DOI": "10.5555/t.3"}], ["k3"]),
    # operators
    ({"url": {"$exists": True}}, ALL), ({"parentItem": {"$exists": False}}, ALL), ({"url": {"$exists": "yes"}}, []),
    ({"title": {"$ne": "River Deltas"}}, ["k1", "k2"]), ({"creators.creatorType": {"$ne": "author"}}, ["k3"]),
]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(it["key"], json.dumps(it)) for it in ITEMS], "item_key string, item_data string")


@pytest.mark.parametrize("query,want", CASES)
def test_find(items, query, want):
    got = items.filter(jsonq.compile_query(F.parse_json("item_data"), query)).select("item_key").collect()
    assert sorted(r.item_key for r in got) == want


def test_intersect_equals_filter(items):
    q = [{"creators.lastName": "Lind"}, {"title": "River Deltas"}]
    assert [r.item_key for r in I.intersect_keys(items, q).collect()] == ["k3"]


def test_upsert_last_write_wins(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "item_key string, version int, item_data string")
    new = spark.createDataFrame([("a", 2, "x2"), ("c", 1, "z")], "item_key string, version int, item_data string")
    got = {r.item_key: (r.version, r.item_data) for r in I.upsert(old, new).collect()}
    assert got == {"a": (2, "x2"), "b": (1, "y"), "c": (1, "z")}


def test_json_booleans_are_one_and_zero(spark):
    rows = [("t", json.dumps({"data": {"f": True}})), ("f", json.dumps({"data": {"f": False}})),
            ("one", json.dumps({"data": {"f": 1}})), ("word", json.dumps({"data": {"f": "true"}})), ("none", json.dumps({"data": {}}))]
    df = spark.createDataFrame(rows, "item_key string, item_data string")

    def keys(q):
        return sorted(r.item_key for r in df.filter(jsonq.compile_query(F.parse_json("item_data"), q)).collect())
    assert keys({"f": 1}) == keys({"f": True}) == ["one", "t"]
    assert keys({"f": False}) == ["f"]
    assert keys({"f": {"$ne": 1}}) == ["f", "word"]


def test_held_by_url_or_doi(spark):
    def row(key, **data):
        return key, json.dumps({"data": data})
    lib = spark.createDataFrame([
        row("a", url="https://nature.com/x"), row("b", DOI="10.1234/abc"),
        row("c", url="https://nature.com/file", itemType="attachment"), row("d", url="https://nature.com/kid", parentItem="a")],
        "item_key string, item_data string")
    urls = [("https://nature.com/x",), ("https://nature.com/articles/10.1234/abc.pdf",), ("https://nature.com/file",),
            ("https://nature.com/kid",), ("https://nature.com/x",), (None,)]
    got = I.held(spark.createDataFrame(urls, "url string"), lib).collect()
    assert len(got) == len(urls)        # repeated and null URLs keep their rows
    assert {r.url: r.held for r in got} == {"https://nature.com/x": True, "https://nature.com/articles/10.1234/abc.pdf": True,
                                            "https://nature.com/file": False, "https://nature.com/kid": False, None: False}


def test_keys_of_all_conditions_in_one_scan(spark, capsys):
    """Conditions may be met in different rows of a key; a null key is a key; items are read once."""
    rows = [("a", {"x": 1, "y": 1}), ("b", {"x": 1}), ("b", {"y": 1}), (None, {"x": 1}), (None, {"y": 1}),
            ("c", {"x": 1}), ("c", {"x": 1}), ("d", {"y": 1}), ("e", {"x": None, "y": 1}), ("a", {})]
    df = spark.createDataFrame([(k, json.dumps({"data": d})) for k, d in rows], "item_key string, item_data string")
    got = I.intersect_keys(df, {"x": 1, "y": 1})
    got.explain("simple")
    plan = capsys.readouterr().out
    assert "LeftSemi" not in plan and plan.count("Scan") == 1
    assert sorted((r.item_key for r in got.collect()), key=str) == [None, "a", "b"]
    assert I.intersect_keys(df, {}).count() == 0
