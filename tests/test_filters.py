"""Filters: the typed compiler and the document matcher against a table of expected results."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from docquire import InvalidDocument, compile_filter
from docquire.operators.find import Find
from docquire.plans.filters import parse
from docquire.plans.matcher import matches

ROWS = [
    {"_id": 0, "n": 1, "x": 1.0, "s": "a", "b": True, "tags": ["a", "b"], "os": [{"p": 1, "q": 1}, {"p": 9, "q": 2}], "sub": {"u": 1, "v": "x"}, "nest": [[1, 2], [3]]},
    {"_id": 1, "n": None, "x": float("nan"), "s": None, "b": None, "tags": [], "os": [], "sub": {"u": None, "v": "x"}, "nest": []},
    {"_id": 2, "n": 3, "x": None, "s": "b", "b": False, "tags": None, "os": None, "sub": None, "nest": None},
    {"_id": 3, "n": -4, "x": -2.5, "s": "", "b": True, "tags": ["c", None], "os": [{"p": None, "q": 3}], "sub": {"u": 5, "v": None}, "nest": [[]]},
    {"_id": 4, "n": 1 << 40, "x": 1e300, "s": "ab", "b": False, "tags": ["b"], "os": [{"p": 5, "q": 3}], "sub": {"u": 1, "v": "y"}, "nest": [[9]]},
]
SCHEMA = "_id long, n long, x double, s string, b boolean, tags array<string>, os array<struct<p: int, q: int>>, sub struct<u: int, v: string>, nest array<array<int>>"

CASES = [
    ({}, [0, 1, 2, 3, 4]),
    (None, [0, 1, 2, 3, 4]),
    ({"n": 1}, [0]),
    ({"n": 1.0}, [0]),
    ({"n": 1.5}, []),
    ({"n": True}, []),
    ({"n": {"$ne": True}}, [0, 1, 2, 3, 4]),
    ({"n": "1"}, []),
    ({"n": None}, [1]),
    ({"n": {"$ne": None}}, [0, 2, 3, 4]),
    ({"n": {"$ne": 1}}, [1, 2, 3, 4]),
    ({"n": {"$gt": 1.5}}, [2, 4]),
    ({"n": {"$gte": 0.5}}, [0, 2, 4]),
    ({"n": {"$lt": 1e30}}, [0, 2, 3, 4]),
    ({"n": {"$not": {"$lt": 1e30}}}, [1]),
    ({"n": {"$lt": float("inf")}}, [0, 2, 3, 4]),
    ({"n": {"$gt": float("nan")}}, []),
    ({"n": {"$gt": 1 << 70}}, []),
    ({"n": {"$gte": None}}, []),
    ({"x": {"$gt": 0}}, [0, 4]),
    ({"x": {"$not": {"$gt": 0}}}, [1, 2, 3]),
    ({"x": {"$lt": 0}}, [3]),
    ({"x": {"$not": {"$lte": 0}}}, [0, 1, 2, 4]),
    ({"x": float("nan")}, []),
    ({"x": {"$ne": float("nan")}}, [0, 1, 2, 3, 4]),
    ({"x": 1}, [0]),
    ({"s": {"$gte": "a"}}, [0, 2, 4]),
    ({"s": {"$gt": 5}}, []),
    ({"s": {"$in": ["a", None, 7]}}, [0, 1]),
    ({"s": {"$nin": ["a", None]}}, [2, 3, 4]),
    ({"s": {"$nin": ["a"]}}, [1, 2, 3, 4]),
    ({"s": {"$in": []}}, []),
    ({"s": {"$nin": []}}, [0, 1, 2, 3, 4]),
    ({"b": True}, [0, 3]),
    ({"b": 1}, []),
    ({"b": {"$gt": False}}, []),
    ({"n": {"$gt": 0, "$lt": 3}}, [0]),
    ({"$or": [{"n": 3}, {"s": "a"}]}, [0, 2]),
    ({"$and": [{"b": True}, {"n": {"$lt": 0}}]}, [3]),
    ({"$or": []}, []),
    ({"$and": []}, [0, 1, 2, 3, 4]),
    ({"n": {"$not": 1}}, [1, 2, 3, 4]),
    ({"n": {"$not": {"$gte": 0, "$lt": 2}}}, [1, 2, 3, 4]),
    ({"nothing": None}, [0, 1, 2, 3, 4]),
    ({"nothing": 1}, []),
    ({"nothing": {"$ne": 1}}, [0, 1, 2, 3, 4]),
    ({"tags": "b"}, [0, 4]),
    ({"tags": {"$ne": "b"}}, [1, 2, 3]),
    ({"tags": ["a", "b"]}, [0]),
    ({"tags": []}, [1]),
    ({"tags": ["c", None]}, [3]),
    ({"tags": None}, [2, 3]),
    ({"tags.0": "b"}, [4]),
    ({"tags.-1": "b"}, [0, 4]),
    ({"tags": {"$gt": ["a", "a"]}}, [0, 3, 4]),
    ({"tags": {"$lt": ["a", "b", "c"]}}, [0, 1]),
    ({"tags": {"$gte": ["a", "b"]}}, [0, 3, 4]),
    ({"tags": {"$lte": ["b", 1]}}, [0, 1, 4]),
    ({"nest": {"$gt": [2]}}, [0, 4]),
    ({"os.p": {"$gt": 4}}, [0, 4]),
    ({"os.p": {"$gt": 4, "$lt": 2}}, [0]),
    ({"os.1.p": 9}, [0]),
    ({"os.-1.p": 5}, [4]),
    ({"os": {"q": 3, "p": 5}}, [4]),
    ({"os": {"p": 5}}, []),
    ({"os.p": {"$in": [1, 5]}}, [0, 4]),
    ({"os.p": {"$nin": [1, 5]}}, [1, 2, 3]),
    ({"sub.u": 1}, [0, 4]),
    ({"sub.u": {"$ne": 1}}, [1, 2, 3]),
    ({"sub": {"v": "x", "u": 1}}, [0]),
    ({"sub.v.deep": None}, [0, 1, 2, 3, 4]),
    ({"nest": [1, 2]}, [0]),
    ({"nest.0": 1}, [0]),
    ({"nest.0": 9}, [4]),
]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([tuple(r.values()) for r in ROWS], SCHEMA).cache()


def _bare(v):
    """A document as a typed table has it: null fields are missing ones, but list elements stay."""
    if isinstance(v, dict):
        return {k: _bare(x) for k, x in v.items() if x is not None}
    return [_bare(x) for x in v] if isinstance(v, list) else v


@pytest.mark.parametrize("filter, expected", CASES, ids=[str(c[0])[:60] for c in CASES])
def test_matcher(filter, expected):
    assert [r["_id"] for r in ROWS if matches(_bare(r), parse(filter))] == expected


def test_compiled(table):
    """All cases in one plan."""
    row = table.agg(*[F.collect_list(F.when(compile_filter(table, f), F.col("_id"))).alias(f"c{i}") for i, (f, _) in enumerate(CASES)]).first()
    wrong = [(CASES[i][0], sorted(got), CASES[i][1]) for i, got in enumerate(row) if sorted(got) != CASES[i][1]]
    assert not wrong


@pytest.mark.parametrize("filter", [{"$bogus": 1}, {"a": {"$bogus": 1}}, {"$and": 1}, {"a": {"$in": 1}}, {"$not": {"a": 1}}, {"a": 1, "b": {"$x": 1}}, [1]])
def test_bad_filters(filter):
    with pytest.raises(InvalidDocument):
        parse(filter)


def test_empty_and_mixed_conditions_are_literals():
    assert matches({"a": {}}, parse({"a": {}}))
    assert matches({"a": {"$gt": 1, "x": 2}}, parse({"a": {"$gt": 1, "x": 2}}))
    assert matches({"a": [True]}, parse({"a": [1]}))


def test_times(spark):
    rows = spark.createDataFrame([(dt.datetime(2020, 1, 1),), (dt.datetime(2021, 1, 1),)], "t timestamp")
    assert rows.filter(compile_filter(rows, {"t": {"$lt": dt.datetime(2020, 6, 1)}})).count() == 1
    plain = rows.select(F.col("t").cast("timestamp_ntz").alias("t"))
    assert plain.filter(compile_filter(plain, {"t": dt.datetime(2021, 1, 1)})).count() == 1


def test_random_filters_agree(spark):
    """Random filters on random scalar documents: the compiled column selects what the matcher does."""
    rng = random.Random(7)
    docs = [{"_id": i, "n": rng.choice([None, 0, 1, 2, -1]), "x": rng.choice([None, 0.0, 1.0, 1.5, float("nan")]), "s": rng.choice([None, "", "a", "b"]), "l": rng.choice([None, [], [1], [1, 2], [2, 2]])} for i in range(200)]
    df = spark.createDataFrame([tuple(d.values()) for d in docs], "_id long, n long, x double, s string, l array<long>").cache()

    def condition(depth=0):
        op = rng.choice(["lit", "$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$not"])
        value = lambda: rng.choice([None, 0, 1, 1.5, "a", "b", True, float("nan")])
        if op == "lit":
            return value()
        if op in ("$in", "$nin"):
            return {op: [value() for _ in range(rng.randint(0, 3))]}
        if op == "$not":
            return {op: condition(depth + 1)} if depth < 2 else {"$ne": value()}
        return {op: value()}

    def filter(depth=0):
        if depth < 2 and rng.random() < 0.3:
            return {rng.choice(["$and", "$or"]): [filter(depth + 1) for _ in range(rng.randint(0, 3))]}
        return {rng.choice("nxsl"): condition() for _ in range(rng.randint(1, 2))}

    filters = [filter() for _ in range(80)]
    row = df.agg(*[F.collect_list(F.when(compile_filter(df, f), F.col("_id"))).alias(f"c{i}") for i, f in enumerate(filters)]).first()
    for f, got in zip(filters, row, strict=True):
        assert sorted(got) == [d["_id"] for d in docs if matches(_bare(d), parse(f))], f


def test_pushed_down(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(10).select(F.col("id").alias("n"), F.col("id").cast("string").alias("s"), F.lit("wide").alias("unused")).write.parquet(path)
    df = spark.read.parquet(path)
    for filter, want in [({"n": {"$ne": 3}}, "Or(IsNull(n),Not(EqualTo(n,3)))"), ({"n": {"$gte": 2, "$lt": 5}}, "GreaterThanOrEqual(n,2)"), ({"s": {"$in": ["1", "2"]}}, "In(s, [1,2])")]:
        plan = Find(df, ("n",), filter=filter).project(["n", "s"]).frame()._jdf.queryExecution().executedPlan().toString()
        assert want in plan, plan
        assert "unused" not in plan.split("ReadSchema")[1]
    top = Find(df, ("n",)).sort("s", -1).skip(2).limit(3).frame()._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in top
