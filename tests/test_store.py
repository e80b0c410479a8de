"""Collections: the same cases from the manifest alone and from segments."""

import pytest
from pyspark.sql import functions as F

from docquire import DocStore, DuplicateKeyError, InvalidDocument, InvalidUpdateDocument, ObjectId, OperationFailure, UnsupportedType, decode, encode
from docquire import store as store_module
from docquire.functions.bson import bson_from_json


@pytest.fixture(params=["inline", "segments"])
def coll(request, spark, tmp_path, monkeypatch):
    if request.param == "segments":
        monkeypatch.setattr(store_module, "INLINE_ROWS", 0)
    return DocStore(spark, str(tmp_path / "data")).db.people


def names(found):
    return [d.get("name") for d in found]


def test_insert_and_find(coll):
    given = {"name": "Ada", "age": 36, "tags": ["x", "y"]}
    assert isinstance(coll.insert_one(given).inserted_id, ObjectId) and "_id" not in given
    coll.insert_many([{"name": "Bo", "age": 20}, {"_id": 7, "name": "Cy", "age": None}, {"name": "Di"}])
    assert names(coll.find()) == ["Ada", "Bo", "Cy", "Di"]
    assert list(coll.find_one({"name": "Ada"})) == ["name", "age", "tags", "_id"]
    assert names(coll.find({"age": None})) == ["Cy", "Di"]
    assert names(coll.find({"tags": "y"})) == ["Ada"]
    assert names(coll.find().sort("age")) == ["Bo", "Ada", "Cy", "Di"]
    assert names(coll.find().sort("age", -1)) == ["Cy", "Di", "Ada", "Bo"]
    assert coll.find({}, {"name": 1, "_id": 0}, skip=1, limit=2).to_list() == [{"name": "Bo"}, {"name": "Cy"}]
    assert coll.find().sort("age")[0]["name"] == "Bo" and names(coll.find()[1:3]) == ["Bo", "Cy"] and coll.find()[2:1] == []
    assert coll.count_documents({"age": {"$gte": 20}}) == 2 and coll.estimated_document_count() == 4
    assert coll.distinct("age") == [36, 20, None] and coll.distinct("tags") == ["x", "y"]
    cursor = coll.find()
    assert cursor.to_list(1)[0]["name"] == "Ada" and cursor.alive
    with pytest.raises(RuntimeError):
        cursor.sort("age")
    assert names(cursor.clone()) == names(cursor.rewind())
    with pytest.raises(IndexError):
        coll.find()[99]
    with pytest.raises(InvalidDocument):
        coll.find({"$bad": 1})


def test_records(coll):
    coll.insert_many([{"i": i} for i in range(4)])
    coll.delete_one({"i": 1})
    assert decode(coll.record(0))["i"] == 0 and coll.record(1) is None and coll.next_live(0) == 2 and coll.next_live(3) is None
    with pytest.raises(LookupError):
        coll.record(99)
    rows = coll._spark.range(6).repartition(3).select((F.col("id") + 10).alias("i"))
    assert coll.insert_frame(rows.select(bson_from_json(F.to_json(F.struct("i"))).alias("doc"))) == 6
    assert coll.stats()["records"] == 10 and coll.stats()["live"] == 9
    numbers = [r[0] for r in coll.frame().select("_seq").collect()]
    assert all(coll.record(n) for n in numbers) and decode(coll.record(max(numbers)))["i"] >= 10
    with pytest.raises(LookupError):
        coll.record(max(numbers) - 1 if max(numbers) - 1 not in numbers else max(numbers) + 1)
    coll.delete_many({"i": {"$gte": 10}})
    assert coll.record(max(numbers)) is None
    assert [d["i"] for d in coll.range("i", 0, 3, with_low=False)] == [2, 3] and len(coll.range("i").to_list()) == 3


def test_mixed_kinds(coll):
    coll.insert_many([{"v": v} for v in (True, 1, False, 0, 1.0, float("nan"))])
    assert coll.distinct("v")[:4] == [True, 1, False, 0]
    assert coll.count_documents({"v": 1}) == 2 and coll.count_documents({"v": True}) == 1 and coll.count_documents({"v": {"$gt": 0}}) == 2
    coll.insert_one({"v": "text"})
    with pytest.raises(TypeError):
        coll.find().sort("v").to_list()


def test_updates(coll):
    coll.insert_many([{"i": i, "tag": "x" if i < 3 else "y"} for i in range(5)])
    assert coll.update_many({"tag": "x"}, {"$inc": {"i": 10}}).modified_count == 3
    assert [d["i"] for d in coll.find()] == [3, 4, 10, 11, 12]
    done = coll.update_one({"tag": "y"}, {"$set": {"a.b": 1}})
    assert (done.matched_count, done.modified_count) == (1, 1) and [d["i"] for d in coll.find()] == [4, 10, 11, 12, 3]
    assert coll.update_one({"i": 4}, {"$set": {"i": 4}}).modified_count == 0 and coll.find_one()["i"] == 4
    assert coll.update_one({"i": 4}, {"$set": {"i": 4.0}}).modified_count == 1
    assert coll.update_many({}, {"$unset": {"tag": ""}}).matched_count == 5 and coll.count_documents({"tag": None}) == 5
    up = coll.update_one({"name": "new", "n": {"$gt": 1}}, {"$inc": {"k": 2}}, upsert=True)
    assert (up.matched_count, up.modified_count) == (0, 0) and {k: v for k, v in coll.find_one({"_id": up.upserted_id}).items() if k != "_id"} == {"name": "new", "k": 2}
    assert coll.replace_one({"name": "new"}, {"z": 1}).modified_count == 1 and list(coll.find_one({"z": 1})) == ["z", "_id"]
    assert coll.replace_one({"q": 5}, {"w": 1}, upsert=True).upserted_id is not None
    assert coll.find_one_and_update({"z": 1}, {"$set": {"z": 2}})["z"] == 1
    assert coll.find_one_and_update({"z": 2}, {"$set": {"z": 3}}, return_document=True)["z"] == 3
    assert coll.find_one_and_replace({"z": 3}, {"z": 4}, return_document=True)["z"] == 4
    assert coll.find_one_and_delete({"z": 4})["z"] == 4 and coll.find_one_and_delete({"z": 4}) is None
    n = coll.count_documents()
    assert coll.delete_one({"i": {"$gte": 10}}).deleted_count == 1 and coll.delete_many({"i": {"$gte": 10}}).deleted_count == 2
    assert coll.count_documents() == n - 3 == coll.estimated_document_count()
    before = coll.find().to_list()
    coll.compact()
    assert coll.find().to_list() == before
    for bad, kind in (({"$push": {"a": 1}}, InvalidUpdateDocument), ({"$set": {"_id": 5}}, InvalidDocument), ({"$inc": {"tag": "x"}}, InvalidDocument)):
        with pytest.raises(kind):
            coll.update_one({"i": 3}, bad)
    with pytest.raises(InvalidDocument):
        coll.replace_one({}, {"$set": {"a": 1}})
    assert coll.find().to_list() == before


def test_a_failing_document_fails_the_whole_statement(coll):
    coll.insert_many([{"n": 1}, {"n": None}, {"n": "text"}])
    before = coll.find().to_list()
    with pytest.raises(InvalidDocument):
        coll.update_many({}, {"$inc": {"n": 1}})
    with pytest.raises(UnsupportedType):
        coll.create_index("n")
    assert coll.find().to_list() == before and coll.list_indexes() == []
    assert coll.stats()["live"] == 3 == coll.stats()["records"]


def test_indexes(coll):
    coll.insert_many([{"u": 1}, {"u": 2}])
    assert coll.create_index("u", unique=True) == "u_1" and coll.create_index([("u", 1)], unique=True) == "u_1"
    assert coll.list_indexes() == [{"name": "u_1", "key": {"u": 1}, "unique": True}]
    with pytest.raises(OperationFailure):
        coll.create_index("u")
    with pytest.raises(DuplicateKeyError):
        coll.insert_one({"u": 1.0})
    coll.insert_one({})
    with pytest.raises(DuplicateKeyError):
        coll.insert_one({"u": None})
    with pytest.raises(DuplicateKeyError):
        coll.update_one({"u": 2}, {"$set": {"u": 1}})
    with pytest.raises(UnsupportedType):
        coll.insert_one({"u": "text"})
    assert [d.get("u") for d in coll.find()] == [1, 2, None]
    with pytest.raises(DuplicateKeyError):
        coll.insert_many([{"u": 5}, {"u": 5}, {"u": 6}])
    assert coll.count_documents({"u": 5}) == 1 and coll.count_documents({"u": 6}) == 0
    with pytest.raises(DuplicateKeyError):
        coll.insert_many([{"u": 5}, {"u": 7}], ordered=False)
    assert coll.count_documents({"u": 7}) == 1
    with pytest.raises(UnsupportedType):
        coll.create_index([("a", 1), ("b", 1)])
    coll.drop_index("u")
    with pytest.raises(OperationFailure):
        coll.drop_index("u")
    coll.insert_one({"u": 1})
    with pytest.raises(DuplicateKeyError):
        coll.create_index("u", unique=True)
    assert coll.list_indexes() == []


def test_indexed_reads(spark, tmp_path):
    """Equalities and ranges on an index reach the scan and change no result, for keys of all kinds and lists on the way."""
    c = DocStore(spark, str(tmp_path / "i")).d.c
    c.create_index("u"), c.create_index("a.b")
    docs = [{"u": v} for v in (1, 1.0, True, None, 2.5, 1 << 60, (1 << 60) + 1, -3)] + [{}] + [{"a": {"b": 5}}, {"a": [{"b": 5}, {"b": 6}]}, {"a": {"b": None}}, {"u": 7, "a": {"b": True}}]
    rows = spark.createDataFrame([(i, bytearray(encode({"i": i, **d}))) for i, d in enumerate(docs)], "n int, doc binary")
    plain = DocStore(spark, str(tmp_path / "p")).d.c
    c.insert_frame(rows, order=["n"]), plain.insert_frame(rows, order=["n"])
    filters = [{"u": v} for v in (1, True, None, 2.5, 1 << 60, "x", 99)] + [{"a.b": 5}, {"a.b": None}, {"a.b": {"$gt": 4}}, {"u": {"$gt": 1, "$lte": 1 << 60}}, {"u": {"$gte": (1 << 60) + 1}}, {"u": {"$ne": 1}}, {"$or": [{"u": 1}, {"a.b": 5}]}, {"u": {"$lt": 0}, "i": 7}]
    for compacted in (False, True):
        for f in filters:
            assert [d["i"] for d in c.find(f)] == [d["i"] for d in plain.find(f)], f
        plan = c.plan({"u": 1})._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [Or(EqualTo(key_" in plan
        assert "GreaterThanOrEqual(num_" in c.plan({"u": {"$gt": 1}})._jdf.queryExecution().executedPlan().toString()
        c.compact()


def test_bulk_inserts_check_unique_indexes(spark, tmp_path):
    c = DocStore(spark, str(tmp_path / "b")).d.c
    c.create_index("u", unique=True)
    frame = lambda keys: spark.createDataFrame([(bytearray(encode({"u": k})),) for k in keys], "doc binary")
    assert c.insert_frame(frame(range(5))) == 5
    c.insert_one({"u": 10})
    for bad in ([7, 7], [8, 3], [10], [8, 3.0]):
        with pytest.raises(DuplicateKeyError):
            c.insert_frame(frame(bad))
    with pytest.raises(UnsupportedType):
        c.insert_frame(frame([11, "text"]))
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("bulk", "")
    assert len(c.insert_many([{"u": 100 + i} for i in range(20)]).inserted_ids) == 20
    assert len(jobs.getJobIdsForGroup("bulk")) < 6
    with pytest.raises(DuplicateKeyError):
        c.insert_many([{"u": 300}, {"u": 4}, {"u": 301}], ordered=False)
    assert c.count_documents({"u": {"$gte": 300}}) == 2 and c.estimated_document_count() == 28


def test_readers_outlive_compaction(spark, tmp_path):
    c = DocStore(spark, str(tmp_path / "r")).d.c
    rows = spark.createDataFrame([(i, bytearray(encode({"i": i}))) for i in range(9)], "n int, doc binary")
    c.insert_frame(rows, order=["n"])
    opened = c.frame("i int")
    c.delete_many({"i": 3})
    c.compact()
    assert opened.count() == 9 and c.count_documents() == 8
    for i in range(store_module.KEPT + 1):
        c.insert_one({"i": 100 + i})
    names = c._folder.names()
    assert sum(n.startswith("segment") for n in names) == 1 and not any(n.startswith("tombstones") for n in names)
    c._folder.publish("segment-of-a-dead-writer.parquet", b"x")
    c.vacuum()
    assert "segment-of-a-dead-writer.parquet" in c._folder.names()
    c.vacuum(0)
    assert len(c._folder.names()) == 2 and c.count_documents() == 8 + store_module.KEPT + 1


def test_a_collection_made_anew_is_seen(spark, tmp_path):
    one, other = (DocStore(spark, str(tmp_path / "n")).d.c for _ in range(2))
    one.insert_one({"i": 1})
    assert other.find_one()["i"] == 1
    one.drop()
    assert other.find_one() is None
    one.insert_one({"i": 2, "longer": True})
    assert other.find_one()["i"] == 2 == one.find_one()["i"]


def test_catalogue_and_bulk(spark, tmp_path):
    with DocStore(spark, str(tmp_path / "s")) as s:
        assert s.list_database_names() == []
        s.a.x.insert_one({"i": 1})
        s["b"]["y"].insert_one({"i": 2})
        assert s.list_database_names() == ["a", "b"] and s.a.list_collection_names() == ["x"]
        s.a.drop_collection("x")
        assert s.a.list_collection_names() == [] and s.a.x.count_documents() == 0
        s.drop_database("b"), s.drop_database("none")
        assert s.list_database_names() == ["a"]
        for bad in (lambda: s.drop_database(5), lambda: s.a.drop_collection(5)):
            with pytest.raises(TypeError):
                bad()
        with pytest.raises(AttributeError):
            s._x
        with pytest.raises(FileNotFoundError):
            s.none.list_collection_names()
        rows = spark.createDataFrame([(i, bytearray(encode({"i": i, "s": str(i)}))) for i in range(20)], "n int, doc binary")
        assert s.a.bulk.insert_frame(rows, order=["n"]) == 20
        assert [d["i"] for d in s.a.bulk.find(limit=3)] == [0, 1, 2] and s.a.bulk.estimated_document_count() == 20
        assert s.a.bulk.update_many({"i": {"$lt": 5}}, {"$set": {"s": "low"}}).modified_count == 5
        assert [d["i"] for d in s.a.bulk.find({"s": "low"})] == [0, 1, 2, 3, 4] and [d["i"] for d in s.a.bulk.find()][-5:] == [0, 1, 2, 3, 4]
        typed = s.a.bulk.frame("i int, s string")
        assert typed.filter("i > 17").count() == 2


def test_reader_keeps_its_version_and_writers_collide(spark, tmp_path):
    c = DocStore(spark, str(tmp_path / "v")).d.c
    c.insert_many([{"i": i} for i in range(3)])
    old = c._manifest()
    c.delete_many({"i": 1})
    assert [d["i"] for _, d in c._rows(old, None)] == [0, 1, 2] and c.count_documents() == 2
    with pytest.raises(OperationFailure):
        c._commit(old)
