"""The registered queries over the driver's tables, each with its SQL.

The tables hold neither nulls nor documents, so nullable orders (``o``) and customers with arrays of
their orders (``d``) are derived, alike in Spark and in SQL.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import DocumentError, DuplicateKeyError, OperationFailure, UnsupportedType
from .functions.bson import bson_from_json, bson_is_valid, bson_to_json, decode, utf8_is_valid
from .functions.objectid import ObjectId, object_id, object_id_from_hex, object_id_hex, object_id_time
from .operators.constraints import unique_violations
from .operators.distinct import distinct
from .operators.find import Find
from .operators.update import Change
from .sources.storage import shared_dir
from .store import Collection, DocStore

KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "orders": "o_orderkey", "part": "p_partkey", "events": "event_id", "embeddings": "vec_id", "labels": "doc_id"}
Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _o(spark: SparkSession, sf: str) -> DataFrame:
    price = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice"))
    prio = F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority"))
    return _read(spark, sf, "orders").select(F.col("o_orderkey").alias("_id"), "o_custkey", F.col("o_orderstatus").alias("st"), price.alias("price"), prio.alias("prio"))


def _d(spark: SparkSession, sf: str) -> DataFrame:
    rows = _read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("_id"))
    found = F.sort_array(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p"), F.col("o_orderstatus").alias("s"))))
    rows = rows.agg(found.alias("x"))
    return rows.select("_id", F.col("x.s").alias("sts"), F.transform("x", lambda e: F.struct(e["k"].alias("k"), e["p"].alias("p"))).alias("os"))


def _customer(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "customer").withColumnRenamed("c_custkey", "_id")


O_SQL = """WITH o AS (SELECT o_orderkey AS _id, o_custkey, o_orderstatus AS st,
 CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price,
 CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS prio FROM orders) """
D_SQL = """WITH d AS (SELECT o_custkey AS _id, list(o_orderstatus ORDER BY o_orderkey) AS sts,
 list(struct_pack(k := o_orderkey, p := o_totalprice) ORDER BY o_orderkey) AS os FROM orders GROUP BY o_custkey) """

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, sql: str | None, query: Query) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


def _find(table: str | Callable, **how) -> Query:
    """A find over a table; ``how`` gives filter, sort, skip, limit, project, columns."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df, seq = (_read(spark, sf, table), KEYS.get(table, "l_orderkey")) if isinstance(table, str) else (table(spark, sf), "_id")
        q = Find(df, (seq,), filter=how.get("filter"))
        if "sort" in how:
            q = q.sort(how["sort"])
        q = q.skip(how.get("skip", 0)).limit(how.get("limit", 0)).project(how.get("project"))
        if "slice" in how:
            q = q[how["slice"]]
        return q.frame().select(*how["columns"]) if "columns" in how else q.frame()

    return run


def _of_o(name: str, filter: dict, where: str) -> None:
    _add(name, f"{O_SQL}SELECT * FROM o WHERE {where}", _find(_o, filter=filter))


def _of_d(name: str, filter: dict, where: str) -> None:
    _add(name, f"{D_SQL}SELECT _id FROM d WHERE {where}", _find(_d, filter=filter, columns=["_id"]))


_add("find_all", "SELECT * FROM customer", _find("customer", filter={}))
_add("filter_eq", "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'", _find("customer", filter={"c_mktsegment": "BUILDING"}))
_add("filter_eq_op", "SELECT * FROM customer WHERE c_nationkey = 7", _find("customer", filter={"c_nationkey": {"$eq": 7.0}}))
_add("filter_bool_not_int", "SELECT * FROM labels WHERE FALSE", _find("labels", filter={"quality": True}))
_add("filter_type_mismatch", "SELECT * FROM customer WHERE FALSE", _find("customer", filter={"c_name": {"$gt": 5}}))
_add("filter_not_type_mismatch", "SELECT * FROM customer", _find("customer", filter={"c_name": {"$not": {"$gt": 5}}}))
_of_o("filter_null", {"price": None}, "price IS NULL")
_add("filter_unknown_field_null", "SELECT * FROM region", _find("region", filter={"no_such": None}))
_of_o("filter_ne", {"prio": {"$ne": "5-LOW"}}, "prio IS DISTINCT FROM '5-LOW'")
_of_o("filter_ne_null", {"prio": {"$ne": None}}, "prio IS NOT NULL")
_of_o("filter_gt", {"price": {"$gt": 300000}}, "price > 300000")
_add("filter_gte", "SELECT * FROM lineitem WHERE l_quantity >= 49", _find("lineitem", filter={"l_quantity": {"$gte": 49}}))
_add("filter_lt", "SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-07-01'", _find("lineitem", filter={"l_shipdate": {"$lt": dt.datetime(1995, 7, 1)}}))
_add("filter_lte", "SELECT * FROM part WHERE p_size <= 3", _find("part", filter={"p_size": {"$lte": 3}}))
_of_o("filter_range", {"price": {"$gte": 1e5, "$lt": 2e5}}, "price >= 100000 AND price < 200000")
_of_o("filter_in", {"st": {"$in": ["F", "P"]}}, "st IN ('F', 'P')")
_of_o("filter_in_null", {"prio": {"$in": ["1-URGENT", None]}}, "prio = '1-URGENT' OR prio IS NULL")
_of_o("filter_in_empty", {"st": {"$in": []}}, "FALSE")
_of_o("filter_nin", {"prio": {"$nin": ["5-LOW", "1-URGENT"]}}, "prio IS NULL OR prio NOT IN ('5-LOW', '1-URGENT')")
_of_o("filter_nin_null", {"prio": {"$nin": ["5-LOW", None]}}, "prio IS NOT NULL AND prio <> '5-LOW'")
_of_o("filter_nin_empty", {"prio": {"$nin": []}}, "TRUE")
_of_o("filter_not_gt", {"price": {"$not": {"$gt": 100000}}}, "price IS NULL OR price <= 100000")
_of_o("filter_not_literal", {"st": {"$not": "F"}}, "st <> 'F' OR st IS NULL")
_of_o("filter_and", {"$and": [{"st": "F"}, {"price": {"$gt": 2e5}}]}, "st = 'F' AND price > 200000")
_of_o("filter_or", {"$or": [{"price": None}, {"prio": "2-HIGH"}]}, "price IS NULL OR prio = '2-HIGH'")
_of_o("filter_or_empty", {"$or": []}, "FALSE")
_of_o("filter_and_empty", {"$and": []}, "TRUE")
_of_d("array_contains", {"sts": "P"}, "list_contains(sts, 'P')")
_of_d("array_not_contains", {"sts": {"$ne": "P"}}, "NOT list_contains(sts, 'P')")
_of_d("array_equals", {"sts": ["F", "O", "F"]}, "sts = ['F', 'O', 'F']")
_of_d("array_greater", {"sts": {"$gt": ["O", "O"]}}, "sts > ['O', 'O']")
_of_d("array_broadcast", {"os.p": {"$gt": 490000}}, "len(list_filter(os, lambda x: x.p > 490000)) > 0")
_of_d("array_two_ops", {"os.p": {"$gt": 450000, "$lt": 20000}}, "len(list_filter(os, lambda x: x.p > 450000)) > 0 AND len(list_filter(os, lambda x: x.p < 20000)) > 0")
_of_d("array_index", {"os.0.p": {"$lt": 50000}}, "os[1].p < 50000")
_of_d("array_neg_index", {"sts.-1": "F"}, "sts[-1] = 'F'")


def _holding(spark: SparkSession, sf: str) -> DataFrame:
    """Customers that have a document among their orders, its fields given in another order."""
    price = _read(spark, sf, "orders").filter("o_orderkey = 7").first()["o_totalprice"]
    return Find(_d(spark, sf), ("_id",), filter={"os": {"p": price, "k": 7}}).frame().select("_id")


_add("array_document", f"{D_SQL}SELECT _id FROM d, (SELECT o_totalprice AS q FROM orders WHERE o_orderkey = 7) WHERE len(list_filter(os, lambda x: x.k = 7 AND x.p = q)) > 0", _holding)
_add("embedding_any_gt", "SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda x: x > 0.35::DOUBLE)) > 0", _find("embeddings", filter={"embedding": {"$gt": 0.35}}, columns=["vec_id"]))
_add("project_include", "SELECT c_name, c_acctbal, c_custkey AS _id FROM customer", _find(_customer, project=["c_name", "c_acctbal"]))
_add("project_exclude", "SELECT c_custkey AS _id, c_nationkey, c_acctbal, c_mktsegment FROM customer", _find(_customer, project={"c_name": 0}))
_add("project_no_id", "SELECT c_name FROM customer", _find(_customer, project={"c_name": 1, "_id": 0}))
_add("project_only_id", "SELECT c_custkey AS _id, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer", _find(_customer, project={"_id": 1}))
_add("sort_asc_topk", f"{O_SQL}SELECT * FROM o ORDER BY price ASC NULLS LAST, _id LIMIT 50", _find(_o, sort="price", limit=50))
_add("sort_desc_topk", f"{O_SQL}SELECT * FROM o ORDER BY prio DESC NULLS FIRST, _id LIMIT 50", _find(_o, sort=[("prio", -1)], limit=50))
_add("sort_multi", f"{O_SQL}SELECT * FROM o ORDER BY st ASC NULLS LAST, price DESC NULLS FIRST, _id LIMIT 100", _find(_o, sort=[("st", 1), ("price", -1)], limit=100))
_add("skip_limit", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 100", _find("orders", skip=100, limit=25))
_add("find_one", f"{O_SQL}SELECT * FROM o WHERE st = 'P' ORDER BY _id LIMIT 1", _find(_o, filter={"st": "P"}, limit=1))
_add("cursor_slice", f"{O_SQL}SELECT * FROM o ORDER BY price DESC NULLS FIRST, _id LIMIT 10 OFFSET 10", _find(_o, sort=[("price", -1)], slice=slice(10, 20)))
_add("index_range", "SELECT * FROM orders WHERE o_orderkey BETWEEN 100 AND 200", _find("orders", filter={"o_orderkey": {"$gte": 100, "$lte": 200}}))
_add(
    "top_customers",
    "SELECT c_name, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal >= 5000 AND c_mktsegment IN ('BUILDING', 'MACHINERY') ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 5",
    _find("customer", filter={"c_acctbal": {"$gte": 5000}, "c_mktsegment": {"$in": ["BUILDING", "MACHINERY"]}}, sort=[("c_acctbal", -1)], skip=5, limit=20, project=["c_name", "c_acctbal", "c_mktsegment"]),
)


def _props(spark: SparkSession, sf: str) -> DataFrame:
    events = _read(spark, sf, "events")
    # the props are JSON of one shape; parsed once into a document, its fields are paths like any other
    events = events.withColumn("props", F.from_json("props", "k INT"))
    return Find(events, ("event_id",), filter={"props.k": {"$gte": 50}}).frame().select("event_id", "user_id")


_add("filter_dot_path", "SELECT event_id, user_id FROM events WHERE CAST(props->>'$.k' AS INT) >= 50", _props)
_add("count_documents", f"{O_SQL}SELECT count(*) AS n FROM o WHERE st = 'F'", lambda s, d: Find(_o(s, d), ("_id",), filter={"st": "F"}).count())
_add("distinct_scalar", f"{O_SQL}SELECT DISTINCT prio AS value FROM o", lambda s, d: distinct(_o(s, d), "prio"))
_add("distinct_array", f"{D_SQL}SELECT DISTINCT unnest(sts) AS value FROM d", lambda s, d: distinct(_d(s, d), "sts"))
_add("distinct_filtered", f"{O_SQL}SELECT DISTINCT st AS value FROM o WHERE price > 400000", lambda s, d: distinct(_o(s, d), "st", {"price": {"$gt": 4e5}}))


def _change(table: Callable, filter: dict, do: Callable[[Change], DataFrame], first: bool = False, seq: str = "_id") -> Query:
    return lambda s, d: do(Change(table(s, d), (seq,), filter, first))


def _table(name: str) -> Callable:
    return lambda s, d: _read(s, d, name)


_add("update_set", f"{O_SQL}SELECT _id, o_custkey, st, price, CASE WHEN st = 'P' THEN 'X' ELSE prio END AS prio FROM o", _change(_o, {"st": "P"}, lambda c: c.update({"$set": {"prio": "X"}})))
_add("update_set_path", f"{O_SQL}SELECT _id, CASE WHEN st = 'P' THEN 'X' END AS tag FROM o", _change(_o, {"st": "P"}, lambda c: c.update({"$set": {"meta.tag": "X"}}).select("_id", F.col("meta.tag").alias("tag"))))
_add("update_unset", f"{O_SQL}SELECT _id, o_custkey, st, CASE WHEN st = 'F' THEN NULL ELSE price END AS price, prio FROM o", _change(_o, {"st": "F"}, lambda c: c.update({"$unset": {"price": ""}})))
_add(
    "update_inc",
    "SELECT p_partkey, CAST(CASE WHEN p_size < 10 THEN p_size + 5 ELSE p_size END AS INTEGER) AS p_size FROM part",
    _change(_table("part"), {"p_size": {"$lt": 10}}, lambda c: c.update({"$inc": {"p_size": 5}}).select("p_partkey", "p_size"), seq="p_partkey"),
)
_add("update_result", f"{O_SQL}SELECT count(*) AS matched_count, count(*) FILTER (WHERE prio IS DISTINCT FROM '5-LOW') AS modified_count FROM o WHERE st = 'P'", _change(_o, {"st": "P"}, lambda c: c.result({"$set": {"prio": "5-LOW"}})))
_add("update_one", f"{O_SQL}SELECT _id, CASE WHEN _id = (SELECT min(_id) FROM o WHERE st = 'P') THEN 'X' ELSE st END AS st FROM o", _change(_o, {"st": "P"}, lambda c: c.update({"$set": {"st": "X"}}).select("_id", "st"), first=True))
_add(
    "upsert",
    "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 99, 'ATLANTIS' WHERE NOT EXISTS (SELECT 1 FROM region WHERE r_name = 'ATLANTIS')",
    _change(_table("region"), {"r_name": "ATLANTIS"}, lambda c: c.upsert({"$set": {"r_regionkey": 99}}), seq="r_regionkey"),
)
_add(
    "replace_one",
    "SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'NEW' ELSE n_name END AS n_name, CASE WHEN n_nationkey = 3 THEN NULL ELSE n_regionkey END AS n_regionkey FROM nation",
    _change(_table("nation"), {"n_nationkey": 3}, lambda c: c.replace({"n_name": "NEW"}, id_col="n_nationkey"), first=True, seq="n_nationkey"),
)
_add("delete_one", f"{O_SQL}SELECT * FROM o WHERE _id <> (SELECT min(_id) FROM o WHERE st = 'F')", _change(_o, {"st": "F"}, lambda c: c.delete(), first=True))
_add("delete_many", f"{O_SQL}SELECT * FROM o WHERE NOT coalesce(price < 200000, FALSE)", _change(_o, {"price": {"$lt": 200000}}, lambda c: c.delete()))
_add(
    "find_one_and_update",
    "SELECT p_partkey, CAST(p_size + 1 AS INTEGER) AS p_size FROM part WHERE p_size = 1 ORDER BY p_partkey LIMIT 1",
    _change(_table("part"), {"p_size": 1}, lambda c: c.images(c.update({"$inc": {"p_size": 1}})).select("p_partkey", "p_size"), first=True, seq="p_partkey"),
)
_add("find_one_and_delete", f"{O_SQL}SELECT * FROM o WHERE st = 'F' ORDER BY _id LIMIT 1", _change(_o, {"st": "F"}, lambda c: c.images(), first=True))
_add(
    "find_one_and_replace",
    "SELECT 'before' AS image, n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'after', n_nationkey, 'NEW', NULL FROM nation WHERE n_nationkey = 3",
    _change(
        _table("nation"), {"n_nationkey": 3}, first=True, seq="n_nationkey",
        do=lambda c: c.images().select(F.lit("before").alias("image"), "*").unionByName(c.images(c.replace({"n_name": "NEW"}, id_col="n_nationkey")).select(F.lit("after").alias("image"), "*")),
    ),
)
_add("unique_violations", "SELECT o_custkey AS key, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1", lambda s, d: unique_violations(_read(s, d, "orders"), "o_custkey"))


def _as_bson(df: DataFrame) -> DataFrame:
    return df.withColumn("doc", bson_from_json(F.to_json(F.struct(*df.columns))))


def _store(spark: SparkSession) -> DocStore:
    """A new store in the folder that all executors share."""
    return DocStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")


def _collection(spark: SparkSession) -> Collection:
    return _store(spark).db.coll


def _roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    df = _read(spark, sf, "customer")
    return _as_bson(df).select(F.from_json(bson_to_json(F.col("doc")), df.schema).alias("d")).select("d.*")


def _compact(spark: SparkSession, sf: str) -> DataFrame:
    """Insert, delete, compact, read back."""
    df, coll = _read(spark, sf, "customer"), _collection(spark)
    coll.insert_frame(_as_bson(df), order=["c_custkey"])
    coll.delete_many({"c_mktsegment": "BUILDING"})
    coll.compact()
    return coll.frame(df.schema).drop("_seq")


def _store_update(spark: SparkSession, sf: str) -> DataFrame:
    df, coll = _read(spark, sf, "part"), _collection(spark)
    coll.insert_frame(_as_bson(df), order=["p_partkey"])
    coll.update_many({"p_size": {"$lt": 10}}, {"$inc": {"p_size": 5}})
    return coll.frame(df.schema).select("p_partkey", "p_size")


def _store_find(spark: SparkSession, sf: str) -> DataFrame:
    df, coll = _read(spark, sf, "customer"), _collection(spark)
    coll.insert_frame(_as_bson(df), order=["c_custkey"])
    found = coll.find({"c_acctbal": {"$gte": 9000}}, ["c_custkey", "c_name"]).sort("c_acctbal", -1).limit(30)
    return spark.createDataFrame([(d["c_custkey"], d["c_name"]) for d in found], "c_custkey long, c_name string")


def _unordered(spark: SparkSession, sf: str) -> DataFrame:
    """A duplicate key in the middle of an unordered insert costs only its own row."""
    coll = _collection(spark)
    coll.create_index("n_nationkey", unique=True)
    rows = [r.asDict() for r in _read(spark, sf, "nation").collect()]  # 25 rows
    try:
        coll.insert_many([*rows[:3], rows[0], *rows[3:]], ordered=False)
    except DuplicateKeyError:
        pass
    return coll.frame("n_nationkey int, n_name string, n_regionkey int").drop("_seq")


def _indexes(spark: SparkSession, sf: str) -> DataFrame:
    coll = _collection(spark)
    coll.create_index("a"), coll.create_index([("b", -1)], unique=True)
    return spark.createDataFrame([(x["name"], x["unique"]) for x in coll.list_indexes()], "name string, is_unique boolean")


def _filled(spark: SparkSession, sf: str, name: str, key: str, *fields: str, index: str | None = None) -> Collection:
    """A collection of a table's rows in the order of a key."""
    df, coll = _read(spark, sf, name), _collection(spark)
    if index:
        coll.create_index(index)
    coll.insert_frame(_as_bson(df.select(*fields) if fields else df), order=[key])
    return coll


def _estimated(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(_filled(spark, sf, "customer", "c_custkey", "c_custkey").estimated_document_count(),)], "n long")


def _indexed(spark: SparkSession, sf: str) -> DataFrame:
    """An equality on an index that the stored layout is clustered by."""
    coll = _filled(spark, sf, "orders", "o_orderkey", "o_orderkey", "o_custkey", "o_totalprice", index="o_custkey")
    coll.compact()
    return coll.plan({"o_custkey": 77}).select(F.from_json(bson_to_json(F.col("doc")), "o_orderkey long, o_custkey long, o_totalprice double").alias("d")).select("d.*")


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """The next live record after some are deleted, read by its number, and the counters."""
    coll = _filled(spark, sf, "nation", "n_nationkey")
    coll.delete_many({"n_nationkey": {"$lt": 5}})
    doc, stats = decode(coll.record(coll.next_live())), coll.stats()
    return spark.createDataFrame([(doc["n_name"], stats["live"], stats["records"])], "n_name string, live long, records long")


def _names(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of a store's databases and collections after some are dropped."""
    with _store(spark) as store:
        for database, name in (("a", "x"), ("a", "y"), ("b", "z"), ("c", "w")):
            store[database][name].insert_one({"i": 1})
        store.a.drop_collection("y"), store.drop_database("c"), store.b.z.drop()
        store.b.u.insert_one({})
        rows = [(d, c) for d in store.list_database_names() for c in store[d].list_collection_names()]
    return spark.createDataFrame(rows, "database string, collection string")


def _ordered_insert(spark: SparkSession, sf: str) -> DataFrame:
    """An ordered insert ends at a duplicate key and keeps what came before."""
    coll = _collection(spark)
    coll.create_index("r_name", unique=False), coll.drop_index("r_name")
    coll.create_index("r_regionkey", unique=True)
    rows = [r.asDict() for r in _read(spark, sf, "region").orderBy("r_regionkey").collect()]  # 5 rows
    coll.insert_one(rows[0])
    try:
        coll.insert_many([*rows[1:3], rows[0], *rows[3:]])
    except DuplicateKeyError:
        pass
    return coll.frame("r_regionkey int, r_name string").drop("_seq")


def _no_indexes(spark: SparkSession, sf: str) -> DataFrame:
    coll = _collection(spark)
    coll.create_index("a"), coll.create_index([("b", -1)]), coll.create_index("c", unique=True)
    coll.drop_index("b")
    left = [x["name"] for x in coll.list_indexes()]
    coll.drop_indexes()
    return spark.createDataFrame([(left, len(coll.list_indexes()))], "names array<string>, n int").select(F.explode("names").alias("name"), "n")


def _cursor(spark: SparkSession, sf: str) -> DataFrame:
    """A cursor read, rewound and cloned with another projection gives the same documents."""
    cursor = _filled(spark, sf, "nation", "n_nationkey").find().sort("n_name", -1)
    first = cursor.to_list(4)
    again = cursor.rewind().to_list(4)
    names = cursor.clone().projection(["n_name"]).to_list(4)
    return spark.createDataFrame([(a["n_nationkey"], b["n_regionkey"], *c.values()) for a, b, c in zip(first, again, names, strict=True)], "n_nationkey int, n_regionkey int, n_name string")


def _reopened(spark: SparkSession, sf: str) -> DataFrame:
    """What a store wrote, another handle of it reads."""
    coll = _filled(spark, sf, "region", "r_regionkey")
    coll.update_one({"r_regionkey": 2}, {"$set": {"r_name": "NEW"}})
    return DocStore(spark, coll.database.store.path).db.coll.frame("r_regionkey int, r_name string").drop("_seq")


def _rejected(spark: SparkSession, sf: str) -> DataFrame:
    """Filters and updates are checked as a whole, whatever the documents hold."""
    coll, rows = _collection(spark), []
    cases = {
        "filter operator": lambda: coll.find({"a": {"$near": 1}}), "filter list": lambda: coll.find({"$or": {"a": 1}}), "update operator": lambda: coll.update_one({}, {"$push": {"a": 1}}),
        "update empty": lambda: coll.update_many({}, {}), "update number": lambda: coll.update_one({}, {"$inc": {"a": "1"}}), "replacement": lambda: coll.replace_one({}, {"$set": {"a": 1}}), "fine": lambda: coll.find({"a": {"$in": [1]}}),
    }
    for name, run in cases.items():
        try:
            run()
            rows.append((name, False))
        except DocumentError:
            rows.append((name, True))
    return spark.createDataFrame(rows, "name string, rejected boolean")


def _object_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids to hexadecimal digits and back, with their order among all ids."""
    ids = _read(spark, sf, "region").select("r_regionkey", object_id(F.col("r_regionkey") * 1000, F.col("r_regionkey")).alias("id"))
    back = object_id_from_hex(object_id_hex(F.col("id")))
    below = ids.alias("a").join(F.broadcast(ids.alias("b")), F.col("b.id") < F.col("a.id"), "left").groupBy("a.r_regionkey").agg(F.count("b.id").alias("below"))  # 5 rows
    return ids.select("r_regionkey", F.substring(object_id_hex(F.col("id")), 1, 8).alias("seconds"), (back == F.col("id")).alias("same")).join(below, "r_regionkey")


def _utf8(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.col("text").cast("binary")
    broken = F.when(F.col("doc_id") % 3 == 0, F.concat(raw, F.unhex(F.lit("C0AF")))).when(F.col("doc_id") % 3 == 1, F.concat(F.unhex(F.lit("EDA080")), raw)).otherwise(raw)
    return _read(spark, sf, "documents").select("doc_id", utf8_is_valid(broken).alias("valid"))


def _index_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Which kinds of values an index holds; null and missing are keys too."""
    coll, rows = _collection(spark), []
    coll.create_index("a")
    values = {"number": 1, "fraction": 1.5, "boolean": True, "null": None, "time": dt.datetime(1969, 1, 1), "id": ObjectId(), "string": "x", "bytes": b"x", "list": [1], "document": {"b": 1}, "nan": float("nan")}
    for name, v in [*values.items(), ("missing", ...)]:
        try:
            coll.insert_one({} if v is ... else {"a": v})
            rows.append((name, True))
        except (UnsupportedType, ValueError):
            rows.append((name, False))
    return spark.createDataFrame(rows, "name string, held boolean")


def _maintained(spark: SparkSession, sf: str) -> DataFrame:
    """A unique index follows updates, deletions and replacements: what they free can be used again."""
    coll = _filled(spark, sf, "nation", "n_nationkey", index=None)
    coll.create_index("n_nationkey", unique=True)
    coll.delete_one({"n_nationkey": 3}), coll.insert_one({"n_nationkey": 3, "n_name": "A"})
    coll.update_one({"n_nationkey": 4}, {"$inc": {"n_nationkey": 100}}), coll.insert_one({"n_nationkey": 4, "n_name": "B"})
    coll.replace_one({"n_nationkey": 5}, {"n_nationkey": 105, "n_name": "C"}), coll.insert_one({"n_nationkey": 5, "n_name": "D"})
    try:
        coll.update_many({"n_nationkey": {"$gte": 6}}, {"$set": {"n_nationkey": 6}})
    except DuplicateKeyError:
        pass
    return coll.frame("n_nationkey int, n_name string").drop("_seq")


def _times(spark: SparkSession, sf: str) -> DataFrame:
    """Times before and after the epoch, stored in milliseconds and compared as moments."""
    coll, day = _collection(spark), dt.timedelta(days=1, microseconds=1500)
    keys = [r[0] for r in _read(spark, sf, "nation").select("n_nationkey").collect()]  # 25 rows
    coll.insert_many([{"k": k, "t": dt.datetime(1969, 12, 29) + k * day} for k in keys])
    found = coll.find({"t": {"$lt": dt.datetime(1970, 1, 3, 2, tzinfo=dt.timezone(dt.timedelta(hours=2)))}}).sort("t")
    return spark.createDataFrame([(d["k"], (d["t"] - dt.datetime(1970, 1, 1)) // dt.timedelta(milliseconds=1)) for d in found], "n_nationkey int, ms long")


def _collision(spark: SparkSession, sf: str) -> DataFrame:
    """Of two writers that start from one version the second fails, and changes nothing."""
    coll = _filled(spark, sf, "region", "r_regionkey")
    version, failed = coll._manifest(), 0
    coll.delete_one({"r_regionkey": 0})
    try:
        coll._commit(version | {"live": 99})
    except OperationFailure:
        failed = 1
    return spark.createDataFrame([(failed, coll.estimated_document_count())], "failed int, n long")


_add("estimated_count", "SELECT count(*) AS n FROM customer", _estimated)
_add("index_equality", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = 77", _indexed)
_add("record_read", "SELECT n_name, CAST(20 AS BIGINT) AS live, CAST(25 AS BIGINT) AS records FROM nation WHERE n_nationkey = 5", _records)
_add("drop_collections", "SELECT * FROM (VALUES ('a', 'x'), ('b', 'u')) AS t(database, collection)", _names)
_add("insert_many_ordered", "SELECT r_regionkey, r_name FROM region WHERE r_regionkey < 3", _ordered_insert)
_add("drop_indexes", "SELECT * FROM (VALUES ('a_1', 0), ('c_1', 0)) AS t(name, n)", _no_indexes)
_add("cursor_rewind", "SELECT n_nationkey, n_regionkey, n_name FROM nation ORDER BY n_name DESC LIMIT 4", _cursor)
_add("store_reopen", "SELECT r_regionkey, CASE WHEN r_regionkey = 2 THEN 'NEW' ELSE r_name END AS r_name FROM region", _reopened)
_add("validation", "SELECT * FROM (VALUES ('filter operator', TRUE), ('filter list', TRUE), ('update operator', TRUE), ('update empty', TRUE), ('update number', TRUE), ('replacement', TRUE), ('fine', FALSE)) AS t(name, rejected)", _rejected)
_add("objectid_hex", "SELECT r_regionkey, printf('%08x', r_regionkey * 1000) AS seconds, TRUE AS same, CAST(r_regionkey AS BIGINT) AS below FROM region", _object_ids)
_add(
    "index_keys",
    "SELECT * FROM (VALUES ('number', TRUE), ('fraction', TRUE), ('boolean', TRUE), ('null', TRUE), ('time', TRUE), ('id', TRUE), ('missing', TRUE), ('string', FALSE), ('bytes', FALSE), ('list', FALSE), ('document', FALSE), ('nan', FALSE)) AS t(name, held)",
    _index_keys,
)
_add(
    "index_maintenance",
    "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (3, 4, 5) UNION ALL SELECT 104, n_name FROM nation WHERE n_nationkey = 4 UNION ALL SELECT * FROM (VALUES (3, 'A'), (4, 'B'), (105, 'C'), (5, 'D'))",
    _maintained,
)
_add("times", "SELECT n_nationkey, CAST((n_nationkey - 3) * 86400000 + n_nationkey * 1500 // 1000 AS BIGINT) AS ms FROM nation WHERE n_nationkey < 5", _times)
_add("writers_collide", "SELECT 1 AS failed, CAST(4 AS BIGINT) AS n", _collision)
_add("utf8_validate", "SELECT doc_id, doc_id % 3 = 2 AS valid FROM documents", _utf8)
_add("bson_roundtrip", "SELECT * FROM customer", _roundtrip)
_add("bson_validate", "SELECT count(*) AS n FROM orders", lambda s, d: _as_bson(_read(s, d, "orders").select("o_orderkey", "o_totalprice")).filter(bson_is_valid(F.col("doc"))).agg(F.count(F.lit(1)).alias("n")))
_add(
    "objectid_time",
    "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM events",
    lambda s, d: _read(s, d, "events").select("event_id", F.unix_timestamp(object_id_time(object_id(F.unix_timestamp(F.col("ts").cast("timestamp")), F.col("event_id")))).alias("seconds")),
)
_add("objectid_generate", "SELECT event_id, CAST(12 AS INTEGER) AS n_bytes FROM events", lambda s, d: _read(s, d, "events").select("event_id", F.octet_length(object_id(F.lit(0), F.col("event_id"), "events")).alias("n_bytes")))
_add("compact", "SELECT * FROM customer WHERE NOT (c_mktsegment = 'BUILDING')", _compact)
_add("store_update", "SELECT p_partkey, CAST(CASE WHEN p_size < 10 THEN p_size + 5 ELSE p_size END AS INTEGER) AS p_size FROM part", _store_update)
_add("store_find", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal >= 9000 ORDER BY c_acctbal DESC, c_custkey LIMIT 30", _store_find)
_add("insert_many_unordered", "SELECT n_nationkey, n_name, n_regionkey FROM nation", _unordered)
_add("list_indexes", "SELECT * FROM (VALUES ('a_1', FALSE), ('b_-1', TRUE)) AS t(name, is_unique)", _indexes)
