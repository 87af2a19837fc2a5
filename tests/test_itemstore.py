"""Stored items: the same matches as the parsed documents, predicates pushed down."""

import json

import pytest
from pyspark.sql import functions as F

from corpuskit.functions import jsonq
from corpuskit.operators import itemstore as IS

DATA = [{"title": "a", "priority": 1, "url": "http://x", "creators": [{"lastName": "P"}]}, {"title": "1", "priority": "1"},
        {"title": None, "priority": True, "url": "http://y"}, {"priority": 0.5, "status": ["x"]}, {"status": {"a": 1}, "title": ""},
        {}, {"title": "A", "priority": False, "creators": [{"lastName": "Q"}, {"lastName": None}]}, {"title": 5, "other": "x"}]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    rows = [(f"k{i}", i, "2024", json.dumps({"key": f"k{i}", "data": d})) for i, d in enumerate(DATA)]
    rows += [("bad", 1, None, "no json"), ("none", 1, None, None), ("list", 1, None, "[1]"), ("flat", 1, None, '{"data": 3}')]
    items = spark.createDataFrame(rows, "item_key string, version int, date_modified string, item_data string")
    return items, IS.write_items(items, str(tmp_path_factory.mktemp("items") / "store"))


@pytest.mark.parametrize("query", [
    {"title": "a"}, {"title": "1"}, {"priority": 1}, {"priority": "1"}, {"priority": True}, {"priority": 0}, {"priority": 0.5},
    {"title": {"$ne": "a"}}, {"priority": {"$ne": 1}}, {"title": {"$exists": True}}, {"title": {"$exists": False}},
    {"status": {"$exists": True}}, {"status": "x"}, {"status": {"$ne": 4}}, {"title": None}, {"title": {"$ne": None}}, {}, [], 5,
    [{"title": "A"}, {"priority": False}], {"creators.lastName": "P"}, {"creators.lastName": {"$ne": "P"}}, {"other": "x"},
    {"other": {"$exists": False}}, {"title": {"$gt": 1}}, {"url": {"$exists": "yes"}}, {"title": 5}])
def test_matches_equal_those_of_the_documents(store, query):
    items, stored = store
    want = items.withColumn("v", F.try_parse_json("item_data")).filter(jsonq.compile_query(F.col("v"), query))
    assert sorted(r["item_key"] for r in stored.find(query).collect()) == sorted(r["item_key"] for r in want.collect())
    each = stored.find_each({"q": query, "all": {"nosuch": {"$exists": False}}})
    assert sorted(r["item_key"] for r in each.filter("query_name = 'q'").collect()) == sorted(r["item_key"] for r in want.collect())


def test_hot_predicates_reach_the_scan(store, capsys):
    _, stored = store
    stored.find([{"url": "http://x"}, {"priority": 1}]).select("item_key").explain("formatted")
    plan = capsys.readouterr().out
    pushed = plan.split("PushedFilters: [", 1)[1].split("]")[0]
    assert "EqualTo(url_s,http://x)" in pushed and "EqualTo(priority_n,1.0)" in pushed
    schema = plan.split("ReadSchema: ", 1)[1].split("\n")[0]
    assert "doc" not in schema and "title" not in schema
    stored.find({"other": "x"}).select("item_key").explain("formatted")
    assert "doc" in capsys.readouterr().out.split("ReadSchema: ", 1)[1].split("\n")[0]


def test_an_empty_store(spark, store, tmp_path):
    items, _ = store
    empty = IS.write_items(items.limit(0), str(tmp_path / "empty"))
    assert empty.find({"title": "a"}).count() == 0 and empty.hot == IS.HOT


def test_paths_and_arrays_are_read_once_for_all_queries(store):
    """Unstored documents: a path or an array that several queries compare stands once in the plan, with the same matches."""
    items, _ = store
    documents = items.select("item_key", F.try_parse_json("item_data").alias("doc"))
    queries = {"one": {"priority": 1}, "ne": {"priority": {"$ne": 1}}, "text": {"priority": "1"}, "no": {"priority": {"$exists": False}},
               "last": {"creators.lastName": "P"}, "other": {"creators.lastName": {"$ne": "P"}}, "none": {}}
    each = IS.ItemStore(documents, ()).find_each(queries)
    plan = each._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("$.data.priority") == 1 and plan.count("$.data.creators") == 1
    want = {(n, r["item_key"]) for n, q in queries.items() for r in documents.filter(jsonq.compile_query(F.col("doc"), q)).collect()}
    got = [tuple(r) for r in each.collect()]
    assert set(got) == want and len(got) == len(want) > 8
    assert IS.ItemStore(documents, ()).find_each({}).count() == 0
