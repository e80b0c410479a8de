"""The codec: round trips, limits, damage."""

import datetime as dt
import math
import random
import struct

import pytest

from docquire import DocumentTooLarge, InvalidBSON, InvalidDocument, ObjectId, UnsupportedType, decode, encode
from docquire.functions.bson import bson_from_json, bson_is_valid, bson_to_json, decode_fields, is_valid
from docquire.sources.files import read_bson, records

VALUES = [None, True, False, 0, -1, 2**31 - 1, 2**31, -(2**63), 2**63 - 1, 0.0, -0.0, 1.5, math.inf, "", "é😀", "a\0b", b"", b"\x00\xff", ObjectId("0123456789abcdef01234567"), dt.datetime(1969, 1, 1), {}, [], [1, "a", None, [2]], {"a": {"b": {"c": 1}}}, {"a.b": 1, "$x": 2}]


@pytest.mark.parametrize("v", VALUES, ids=repr)
def test_round_trip(v):
    out = decode(encode({"v": v, "w": 1}))
    assert out == {"v": v, "w": 1} and list(out) == ["v", "w"] and type(out["v"]) is type(v)


def test_conversions():
    assert math.isnan(decode(encode({"v": math.nan}))["v"])
    assert decode(encode({"v": (1, 2)}))["v"] == [1, 2]
    assert decode(encode({"v": dt.datetime(2020, 1, 1, 12, microsecond=1999)}))["v"] == dt.datetime(2020, 1, 1, 12, microsecond=1000)
    east = dt.timezone(dt.timedelta(hours=2))
    assert decode(encode({"v": dt.datetime(2020, 1, 1, 12, tzinfo=east)}))["v"] == dt.datetime(2020, 1, 1, 10)
    assert decode(memoryview(encode({"v": 1}))) == {"v": 1}


def test_limits():
    with pytest.raises(TypeError):
        encode([1])
    for bad in ({1: 1}, {"a\0": 1}, {"a": {1}}, {"a": dt.date(2020, 1, 1)}):
        with pytest.raises(InvalidDocument):
            encode(bad)
    with pytest.raises(OverflowError):
        encode({"a": 2**63})
    with pytest.raises(DocumentTooLarge):
        encode({"a": "x" * (16 << 20)})
    deep: dict = {}
    for _ in range(200):
        deep = {"a": deep}
    with pytest.raises(InvalidBSON):
        encode(deep)
    with pytest.raises(OverflowError):
        decode(b"\x10\x00\x00\x00\x09a\x00" + struct.pack("<q", 1 << 60) + b"\x00")


def test_damage():
    good = encode({"a": "hello", "b": [1, 2], "c": {"d": 1.5}})
    for bad in (b"", good[:-1], good + b"\0", good[:4], b"\xff" + good[1:], b"\x05\x00\x00\x00\x01"):
        with pytest.raises(InvalidBSON):
            decode(bad)
    assert is_valid(b"\x08\x00\x00\x00\xffa\x00\x00")
    with pytest.raises(UnsupportedType):
        decode(b"\x08\x00\x00\x00\xffa\x00\x00")
    rng = random.Random(3)
    for _ in range(300):
        raw = bytearray(good)
        raw[rng.randrange(len(raw))] = rng.randrange(256)
        try:
            decode(raw)
        except (InvalidBSON, UnsupportedType, OverflowError, DocumentTooLarge):
            pass


def test_object_ids():
    a, b = ObjectId(), ObjectId()
    assert a != b and len(a.binary) == 12 and ObjectId(str(a)) == a and ObjectId(bytes(a)) == a and hash(ObjectId(a)) == hash(a)
    assert ObjectId("507f1f77bcf86cd799439011").generation_time == dt.datetime(2012, 10, 17, 21, 13, 27, tzinfo=dt.timezone.utc)
    assert ObjectId("0" * 24) < ObjectId("1" * 24)
    for bad in ("xyz", b"short", "g" * 24):
        with pytest.raises(ValueError):
            ObjectId(bad)
    with pytest.raises(TypeError):
        ObjectId(5)


def test_columns(spark):
    from pyspark.sql import functions as F

    from docquire.functions.objectid import object_id, object_id_from_hex, object_id_hex, object_id_time

    rows = spark.createDataFrame([(bytearray(encode({"a": 1, "t": dt.datetime(2020, 1, 1)})),), (bytearray(b"bad"),)], "doc binary")
    assert [r[0] for r in rows.select(bson_is_valid(F.col("doc"))).collect()] == [True, False]
    text = rows.filter(bson_is_valid(F.col("doc"))).select(bson_to_json(F.col("doc")).alias("j"))
    assert decode(text.select(bson_from_json(F.col("j"))).first()[0]) == {"a": 1, "t": dt.datetime(2020, 1, 1)}
    ids = spark.range(3).select(object_id(F.lit(1350508407), F.col("id"), "s").alias("o"))
    assert ids.distinct().count() == 3
    back = ids.select(object_id_from_hex(object_id_hex(F.col("o"))).alias("o"), F.unix_timestamp(object_id_time(F.col("o"))).alias("t")).first()
    assert len(back[0]) == 12 and back[1] == 1350508407


def test_files(spark, tmp_path):
    docs = [encode({"i": i}) for i in range(5)]
    (tmp_path / "a.bson").write_bytes(b"".join(docs) + b"\x99tail")
    log = b"CBD1" + bytes(60) + b"".join((b"\x02" if i == 1 else b"\x01") + d for i, d in enumerate(docs)) + b"\x01\x00bad"
    (tmp_path / "b.log").write_bytes(log)
    assert [decode(d)["i"] for _, d in records(log)] == [0, 2, 3, 4]
    rows = read_bson(spark, str(tmp_path)).collect()
    assert sorted((r.path[-1], decode(r.doc)["i"]) for r in rows) == [("g", 0), ("g", 2), ("g", 3), ("g", 4)] + [("n", i) for i in range(5)]


def test_some_fields_alone():
    doc = {"a": 1, "b": 1 << 40, "c": 2.5, "d": "é" * 9, "e": b"\0x", "f": None, "g": True, "h": [1, {"x": "y"}], "i": {"a": {"b": 1}}, "j": ObjectId(), "k": dt.datetime(2020, 1, 2), "": "empty", "a.b": 7}
    raw = encode(doc)
    for n in range(len(doc) + 1):
        names = list(doc)[::-1][:n]
        assert decode_fields(raw, names) == {k: doc[k] for k in doc if k in names}
    for name in doc:
        assert decode_fields(raw, [name, "no such"]) == {name: doc[name]}
    assert decode_fields(encode({}), ["a"]) == {}
