"""The BSON codec, for single documents and for columns."""

from __future__ import annotations

import datetime as dt
import json
import struct
from collections.abc import Callable, Collection, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import DocumentError, DocumentTooLarge, InvalidBSON, InvalidDocument, UnsupportedType
from .objectid import ObjectId

MOST_BYTES, MOST_DEPTH = 16 << 20, 100
_EPOCH = dt.datetime(1970, 1, 1)
_MS = dt.timedelta(milliseconds=1)

#: Fixed values of the format: type bytes.
DOUBLE, STRING, DOCUMENT, ARRAY, BINARY, OBJECT_ID, BOOLEAN, DATETIME, NULL, INT32, INT64 = 0x01, 0x02, 0x03, 0x04, 0x05, 0x07, 0x08, 0x09, 0x0A, 0x10, 0x12
#: Kinds of the format that aren't held: undefined, regex, pointer, code, symbol, scoped code, timestamp, decimal128, max key, min key.
NOT_HELD = {0x06, 0x0B, 0x0C, 0x0D, 0x0E, 0x0F, 0x11, 0x13, 0x7F, 0xFF}


def _milliseconds(v: dt.datetime) -> int:
    if v.tzinfo is not None:
        v = v.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return (v - _EPOCH) // _MS


def _name(key: Any) -> bytes:
    if not isinstance(key, str):
        raise InvalidDocument(f"keys are strings, not {type(key).__name__}")
    if "\0" in key:
        raise InvalidDocument("keys hold no NUL")
    try:
        return key.encode() + b"\0"
    except UnicodeEncodeError:
        raise InvalidDocument("keys are valid UTF-8") from None


def _document(items, depth: int) -> bytes:
    if depth > MOST_DEPTH:
        raise InvalidBSON("documents are nested too deeply")
    body = b"".join(_element(k, v, depth) for k, v in items)
    if len(body) + 5 > MOST_BYTES:
        raise DocumentTooLarge("a document has at most 16 MiB")
    return struct.pack("<i", len(body) + 5) + body + b"\0"


def _element(key: Any, v: Any, depth: int) -> bytes:
    name = _name(key)
    if v is None:
        return bytes([NULL]) + name
    if isinstance(v, bool):
        return bytes([BOOLEAN]) + name + bytes([v])
    if isinstance(v, int):
        if -(1 << 31) <= v < 1 << 31:
            return bytes([INT32]) + name + struct.pack("<i", v)
        if -(1 << 63) <= v < 1 << 63:
            return bytes([INT64]) + name + struct.pack("<q", v)
        raise OverflowError("whole numbers have at most 64 bits")
    if isinstance(v, float):
        return bytes([DOUBLE]) + name + struct.pack("<d", v)
    if isinstance(v, str):
        try:
            raw = v.encode() + b"\0"
        except UnicodeEncodeError:
            raise InvalidDocument("strings are valid UTF-8") from None
        return bytes([STRING]) + name + struct.pack("<i", len(raw)) + raw
    if isinstance(v, (bytes, bytearray)):
        return bytes([BINARY]) + name + struct.pack("<iB", len(v), 0) + bytes(v)
    if isinstance(v, ObjectId):
        return bytes([OBJECT_ID]) + name + v.binary
    if isinstance(v, dt.datetime):
        return bytes([DATETIME]) + name + struct.pack("<q", _milliseconds(v))
    if isinstance(v, Mapping):
        return bytes([DOCUMENT]) + name + _document(v.items(), depth + 1)
    if isinstance(v, (list, tuple)):
        return bytes([ARRAY]) + name + _document(((str(i), x) for i, x in enumerate(v)), depth + 1)
    raise InvalidDocument(f"documents hold no {type(v).__name__}")


def encode(document: Mapping) -> bytes:
    """A document's bytes."""
    if not isinstance(document, Mapping):
        raise TypeError("only mappings are encoded")
    return _document(document.items(), 0)


class _Reader:
    def __init__(self, data: bytes):
        self.data = data

    def unpack(self, form: str, at: int, end: int) -> tuple[Any, int]:
        size = struct.calcsize(form)
        if at + size > end:
            raise InvalidBSON("a value ends early")
        return struct.unpack_from(form, self.data, at)[0], at + size

    def name(self, at: int, end: int) -> tuple[str, int]:
        stop = self.data.find(b"\0", at, end)
        if stop < 0:
            raise InvalidBSON("a key has no end")
        try:
            return self.data[at:stop].decode(), stop + 1
        except UnicodeDecodeError:
            raise InvalidBSON("a key isn't UTF-8") from None

    def document(self, at: int, limit: int, depth: int, array: bool) -> tuple[Any, int]:
        if depth > MOST_DEPTH:
            raise InvalidBSON("documents are nested too deeply")
        size, start = self.unpack("<i", at, limit)
        end = at + size
        if size < 5 or end > limit:
            raise InvalidBSON("a document's length is wrong")
        if self.data[end - 1]:
            raise InvalidBSON("a document has no end")
        out: Any = [] if array else {}
        at = start
        while at < end - 1:
            kind = self.data[at]
            key, at = self.name(at + 1, end - 1)
            v, at = self.value(kind, at, end - 1, depth)
            if array:
                out.append(v)
            else:
                out[key] = v
        if at != end - 1:
            raise InvalidBSON("a document's length is wrong")
        return out, end

    def value(self, kind: int, at: int, end: int, depth: int) -> tuple[Any, int]:
        if kind == DOUBLE:
            return self.unpack("<d", at, end)
        if kind == INT32:
            return self.unpack("<i", at, end)
        if kind == INT64:
            return self.unpack("<q", at, end)
        if kind == STRING:
            size, at = self.unpack("<i", at, end)
            if size < 1 or at + size > end or self.data[at + size - 1]:
                raise InvalidBSON("a string's length is wrong")
            try:
                return self.data[at : at + size - 1].decode(), at + size
            except UnicodeDecodeError:
                raise InvalidBSON("a string isn't UTF-8") from None
        if kind in (DOCUMENT, ARRAY):
            return self.document(at, end, depth + 1, kind == ARRAY)
        if kind == BINARY:
            size, at = self.unpack("<i", at, end)
            _, at = self.unpack("<B", at, end)
            if size < 0 or at + size > end:
                raise InvalidBSON("a binary's length is wrong")
            return self.data[at : at + size], at + size
        if kind == OBJECT_ID:
            if at + 12 > end:
                raise InvalidBSON("a value ends early")
            return ObjectId(self.data[at : at + 12]), at + 12
        if kind == BOOLEAN:
            v, at = self.unpack("<B", at, end)
            return v != 0, at
        if kind == DATETIME:
            ms, at = self.unpack("<q", at, end)
            try:
                return _EPOCH + ms * _MS, at
            except OverflowError:
                raise OverflowError("the time is outside the years 1 to 9999") from None
        if kind == NULL:
            return None, at
        if kind in NOT_HELD:
            raise UnsupportedType(f"values of type 0x{kind:02x} aren't held")
        raise InvalidBSON(f"there is no type 0x{kind:02x}")


def decode(data: bytes | bytearray | memoryview) -> dict:
    """The document in ``data``, which holds nothing else."""
    raw = bytes(data)
    if len(raw) > MOST_BYTES:
        raise DocumentTooLarge("a document has at most 16 MiB")
    out, end = _Reader(raw).document(0, len(raw), 0, False)
    if end != len(raw):
        raise InvalidBSON("there are bytes after the document")
    return out


#: Bytes of the values of types that have a fixed size.
_FIXED = {DOUBLE: 8, INT32: 4, INT64: 8, DATETIME: 8, BOOLEAN: 1, NULL: 0, OBJECT_ID: 12}


def decode_fields(data: bytes | bytearray | memoryview, names: Collection[str]) -> dict:
    """The top-level fields with some names, of a document that is known to be well-formed: all others are skipped over unread."""
    raw = bytes(data)
    reader, wanted, at, end, out = _Reader(raw), {n.encode(): n for n in names}, 4, len(raw) - 1, {}
    while at < end:
        kind, stop = raw[at], raw.index(b"\0", at + 1)
        name, at = raw[at + 1 : stop], stop + 1
        if name in wanted:
            out[wanted[name]], at = reader.value(kind, at, end, 0)
        elif kind in _FIXED:
            at += _FIXED[kind]
        else:
            size = int.from_bytes(raw[at : at + 4], "little")
            at += size if kind in (DOCUMENT, ARRAY) else 4 + size + (kind == BINARY)
    return out


def is_valid(data: bytes | None) -> bool:
    """Whether bytes are a well-formed document, of values held here or not."""
    if data is None:
        return False
    try:
        decode(data)
    except UnsupportedType:
        return True
    except (DocumentError, OverflowError):
        return False
    return True


def _plain(v: Any) -> Any:
    """A value as JSON holds it; what JSON lacks is tagged."""
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    if isinstance(v, list):
        return [_plain(x) for x in v]
    if isinstance(v, ObjectId):
        return {"$oid": str(v)}
    if isinstance(v, bytes):
        return {"$binary": v.hex()}
    if isinstance(v, dt.datetime):
        return {"$date": v.isoformat(timespec="milliseconds") + "Z"}
    if isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))):
        return {"$double": repr(v)}
    return v


def _tagged(v: Any) -> Any:
    if isinstance(v, dict):
        if len(v) == 1:
            (k, x), make = next(iter(v.items())), {"$oid": ObjectId, "$binary": bytes.fromhex, "$double": float, "$date": lambda s: dt.datetime.fromisoformat(s.removesuffix("Z"))}
            if k in make:
                return make[k](x)
        return {k: _tagged(x) for k, x in v.items()}
    return [_tagged(x) for x in v] if isinstance(v, list) else v


def _column(f: Callable, kind: str) -> Callable[[Column], Column]:
    def batch(s: pd.Series) -> pd.Series:
        return s.map(f)

    batch.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return lambda c: F.pandas_udf(batch, kind)(c)


bson_is_valid = _column(is_valid, "boolean")
#: BSON to JSON text and back; object ids, bytes, times and odd doubles are tagged documents.
bson_to_json = _column(lambda b: None if b is None else json.dumps(_plain(decode(b)), ensure_ascii=False), "string")
bson_from_json = _column(lambda t: None if t is None else encode(_tagged(json.loads(t))), "binary")


def utf8_is_valid(c: Column) -> Column:
    """Whether bytes are valid UTF-8, without overlong forms, surrogates and what lies beyond U+10FFFF; null for null."""
    return F.is_valid_utf8(c.cast("string"))
