"""Find, distinct and updates on typed DataFrames."""

import pytest

from docquire import Change, Find, InvalidDocument, InvalidUpdateDocument, distinct
from docquire.operators.find import Projection, sort_spec


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(0, 3, "x", [1, 2]), (1, None, "y", []), (2, 3, "x", None), (3, 1, None, [2, 5])], "_id long, n int, s string, l array<int>").cache()


def ids(q):
    return [r["_id"] for r in q.frame().collect()]


def test_sorts_are_stable_with_nulls_last_up_and_first_down(table):
    q = Find(table, ("_id",))
    assert ids(q.sort("n")) == [3, 0, 2, 1]
    assert ids(q.sort("n", -1)) == [1, 0, 2, 3]
    assert ids(q.sort([("s", -1), ("n", 1)])) == [3, 1, 0, 2]
    assert ids(q.sort("n").skip(1).limit(2)) == [0, 2]
    assert ids(q.sort("n", -1)[1:3]) == [0, 2]
    assert ids(q[2:2]) == [] and ids(q[1]) == [1]
    assert ids(q.limit(0)) == [0, 1, 2, 3]
    for bad in (lambda: q.skip(-1), lambda: q.limit(-1)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(IndexError):
        q[-1]
    assert sort_spec({"a": 1, "b": -1}) == (("a", False), ("b", True))


def test_projections(table):
    q = Find(table, ("_id",))
    assert q.project(["s", "n"]).frame().columns == ["s", "n", "_id"]
    assert q.project({"n": 1, "_id": 0}).frame().columns == ["n"]
    assert q.project({"n": 0}).frame().columns == ["_id", "s", "l"]
    assert q.project({"_id": 1}).frame().columns == ["_id", "n", "s", "l"]
    assert q.project({"no_such": 1}).frame().columns == ["_id"]
    with pytest.raises(ValueError):
        Projection.of({"a": 1, "b": 0})


def test_distinct(table):
    assert [r[0] for r in distinct(table, "n", seq=["_id"]).collect()] == [3, None, 1]
    assert [r[0] for r in distinct(table, "l", seq=["_id"]).collect()] == [1, 2, 5]
    assert distinct(table, "nothing").count() == 0
    assert [r[0] for r in distinct(table, "s", {"n": 1}).collect()] == [None]


def test_updates(table):
    every = lambda df: [tuple(r) for r in df.orderBy("_id").collect()]
    c = Change(table, ("_id",), {"n": 3})
    assert [r[1] for r in every(c.update({"$inc": {"n": 2}}))] == [5, None, 5, 1]
    assert [r[1] for r in every(Change(table, ("_id",), {"n": 3}, first=True).update({"$inc": {"n": 2}}))] == [5, None, 3, 1]
    assert [r[2] for r in every(c.update({"$unset": {"s": ""}}))] == [None, "y", None, None]
    grown = c.update({"$set": {"a.b": 1, "n": 0.5}})
    assert [r["n"] for r in grown.orderBy("_id").collect()] == [0.5, None, 0.5, 1.0]
    assert [r["a"] and r["a"]["b"] for r in grown.orderBy("_id").collect()] == [1, None, 1, None]
    deeper = Change(grown, ("_id",), {"_id": 1}).update({"$set": {"a.c": "z"}})
    assert [r["a"] and tuple(r["a"]) for r in deeper.orderBy("_id").collect()] == [(1, None), (None, "z"), (1, None), None]
    assert tuple(c.result({"$set": {"s": "x"}}).first()) == (2, 0)
    assert tuple(c.result({"$set": {"s": "q"}}).first()) == (2, 2)
    assert c.delete().count() == 2 and Change(table, ("_id",), {"n": 3}, first=True).delete().count() == 3
    assert Change(table, ("_id",), {"n": 77}).upsert({"$set": {"s": "new"}}).filter("n = 77 and s = 'new'").count() == 1
    assert c.upsert({"$set": {"s": "new"}}).count() == 4
    assert [r["s"] for r in every_row(Change(table, ("_id",), {"_id": 0}, first=True).replace({"s": "r"}))] == ["r", "y", "x", None]


def every_row(df):
    return df.orderBy("_id").collect()


def test_bad_updates(table):
    c = Change(table, ("_id",), {})
    for bad in ({}, {"a": 1}, {"$push": {"a": 1}}, {"$set": {}}, {"$set": 1}):
        with pytest.raises(InvalidUpdateDocument):
            c.update(bad)
    for bad in ({"$inc": {"s": 1}}, {"$inc": {"n": True}}, {"$unset": {"_id": 1}}):
        with pytest.raises(InvalidDocument):
            c.update(bad)
    with pytest.raises(InvalidDocument):
        c.replace({"$set": {"a": 1}})


def test_filters_of_changes_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(100).selectExpr("id AS _id", "id % 7 AS k", "CAST(id AS STRING) AS s").write.parquet(path)
    df = spark.read.parquet(path)
    plan = lambda out: out._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,3)" in plan(Change(df, ("_id",), {"k": 3}).images())
    one = Change(df, ("_id",), {"k": 3}, first=True)
    assert plan(one.images()).count("EqualTo(k,3)") >= 2 and "EqualTo(k,3)" in plan(one.update({"$set": {"s": "x"}}))
    assert [r._id for r in one.images().collect()] == [3] and one.result({"$set": {"s": "x"}}).first().matched_count == 1
    assert one.update({"$set": {"s": "x"}}).filter("s = 'x'").count() == 1 and one.delete().count() == 99
    after = one.images(one.update({"$inc": {"k": 5}})).collect()
    assert [(r._id, r.k) for r in after] == [(3, 8)]
