"""Compile filters to columns of a typed DataFrame.

In a typed schema a missing field and a null are one: NULL. A path through structs to a scalar becomes a plain
comparison, which the scan can push down; its negation is spelled out with its nulls. Where an array stands on the
path, any candidate may match, each operator by itself: the elements of an array on the way, and the array as a whole or any element at the end.
Operands whose kind can't match a column's become constants, so nothing is ever cast.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .filters import All, Any_, Leaf, index_of, parse

TRUE, FALSE = True, False
FLIPPED = {"gt": "lte", "gte": "lt", "lt": "gte", "lte": "gt"}


def column(name: str) -> Column:
    """A top-level column by its whole name."""
    return F.col("`" + name.replace("`", "``") + "`")


def kind_of_type(t: T.DataType) -> str:
    for kind, types in (
        ("bool", T.BooleanType),
        ("number", T.NumericType),
        ("string", T.StringType),
        ("binary", T.BinaryType),
        ("time", (T.TimestampType, T.TimestampNTZType)),
        ("array", T.ArrayType),
        ("document", T.StructType),
    ):
        if isinstance(t, types):
            return kind
    return "other"


def kind_of_value(v: Any) -> str:
    for kind, types in (("null", type(None)), ("bool", bool), ("number", (int, float)), ("string", str), ("binary", (bytes, bytearray)), ("time", dt.datetime), ("array", (list, tuple)), ("document", Mapping)):
        if isinstance(v, types):
            return kind
    return "binary" if hasattr(v, "binary") else "other"


def literal(v: Any, t: T.DataType) -> Column:
    """A literal of a scalar column's type."""
    if isinstance(v, dt.datetime):
        if v.tzinfo is not None:
            v = v.astimezone(dt.timezone.utc).replace(tzinfo=None)
        text = v.isoformat(sep=" ")
        return F.lit(text).cast("timestamp_ntz") if isinstance(t, T.TimestampNTZType) else F.lit(text + "+00:00").cast("timestamp")
    if isinstance(v, (bytes, bytearray)) or hasattr(v, "binary"):
        return F.lit(bytearray(getattr(v, "binary", v)))
    if isinstance(t, T.NumericType):
        return F.lit(v).cast(t)
    return F.lit(v)


_BITS = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}


def _compare(c: Column, t: T.DataType, op: str, v: Any, guard: bool = True) -> Column | bool:
    """``c op v`` for a scalar column and an operand of its kind. True or False if it holds for all or no values."""
    if kind_of_type(t) == "number":
        if isinstance(v, float) and math.isnan(v):
            return FALSE
        if type(t) in _BITS:
            limit = 1 << _BITS[type(t)]
            if isinstance(v, float) and not v.is_integer():
                if op == "eq":
                    return FALSE
                if math.isinf(v):
                    return (v > 0) == (op in ("lt", "lte"))
                # between two whole numbers, both bounds of a kind mean the same
                op, v = ("gt", math.floor(v)) if op in ("gt", "gte") else ("lt", math.ceil(v))
            v = int(v)
            if not -limit <= v < limit:
                return FALSE if op == "eq" else (v > 0) == (op in ("lt", "lte"))
        elif isinstance(v, int):
            try:
                near = float(v)
            except OverflowError:
                return FALSE if op == "eq" else (v > 0) == (op in ("lt", "lte"))
            if isinstance(t, T.FractionalType) and not isinstance(t, T.DecimalType):
                if near != v:
                    if op == "eq":
                        return FALSE
                    above = near > v
                    op = {"gt": "gte" if above else "gt", "gte": "gte" if above else "gt", "lt": "lt" if above else "lte", "lte": "lt" if above else "lte"}[op]
                v = near
    # a 32-bit column is compared as what its values are, not by rounding the operand
    if isinstance(t, T.FloatType):
        c, t = c.cast("double"), T.DoubleType()
    x = literal(v, t)
    out = {"eq": lambda: c == x, "gt": lambda: c > x, "gte": lambda: c >= x, "lt": lambda: c < x, "lte": lambda: c <= x}[op]()
    if isinstance(t, T.DoubleType) and op in ("gt", "gte") and guard:
        out = out & ~F.isnan(c)
    return out


def _same(c: Column, t: T.DataType, v: Any) -> Column:
    """Equality inside arrays and documents: booleans equal 0 and 1 there. Never NULL."""
    if v is None:
        return c.isNull()
    kind, want = kind_of_type(t), kind_of_value(v)
    if kind == "bool" and want == "number":
        return F.coalesce(c == F.lit(bool(v)), F.lit(False)) if v in (0, 1) else F.lit(False)
    if kind == "number" and want == "bool":
        want, v = "number", int(v)
    if kind != want:
        return F.lit(False)
    if kind == "array":
        parts = [F.size(c) == len(v), *(_same(F.get(c, F.lit(i)), t.elementType, x) for i, x in enumerate(v))]
    elif kind == "document":
        names = {f.name: f.dataType for f in t.fields}
        if set(v) - set(names):
            return F.lit(False)
        # what the operand lacks has to be absent
        parts = [c.isNotNull(), *(_same(c.getField(n), d, v.get(n)) for n, d in names.items())]
    else:
        found = _compare(c, t, "eq", v)
        return F.lit(found) if isinstance(found, bool) else F.coalesce(found, F.lit(False))
    return F.coalesce(reduce(lambda a, b: a & b, parts), F.lit(False))


def _list_order(c: Column, t: T.ArrayType, op: str, v: Any) -> Column:
    """Lists in the order of their first difference; where that has no order, none. Never NULL."""
    strict = op[:2]
    parts, same = [], F.lit(True)
    for i, x in enumerate(v):
        element = F.get(c, F.lit(i))
        inside = same & (F.size(c) > i)
        if strict == "lt":
            parts.append(same & (F.size(c) == i))
        parts.append(inside & F.coalesce(_candidate(strict, x)(element, t.elementType), F.lit(False)))
        same = inside & _same(element, t.elementType, x)
    if strict == "gt":
        parts.append(same & (F.size(c) > len(v)))
    if op.endswith("e"):
        parts.append(same & (F.size(c) == len(v)))
    return F.coalesce(reduce(lambda a, b: a | b, parts, F.lit(False)), F.lit(False))


def _candidate(op: str, v: Any) -> Callable[[Column, T.DataType], Column]:
    """The test of one candidate that isn't null; may be NULL for "no"."""

    def test(c: Column, t: T.DataType) -> Column:
        kind, want = kind_of_type(t), kind_of_value(v)
        if kind != want or kind == "other":
            return F.lit(False)
        if kind in ("array", "document") and op == "eq":
            return _same(c, t, v)
        if kind == "document" or (kind == "bool" and op != "eq"):
            return F.lit(False)
        if kind == "array":
            return _list_order(c, t, op, v)
        found = _compare(c, t, op, v)
        return F.lit(found) & c.isNotNull() if isinstance(found, bool) else found

    return test


class Compiler:
    """Compiles trees for one schema."""

    def __init__(self, schema: T.StructType):
        self.schema = schema

    def __call__(self, node: All | Any_ | Leaf) -> Column:
        if isinstance(node, Leaf):
            return self._leaf(node)
        if not node.parts:
            return F.lit(isinstance(node, All))
        parts = [self(p) for p in node.parts]
        return reduce((lambda a, b: a & b) if isinstance(node, All) else (lambda a, b: a | b), parts)

    def _leaf(self, leaf: Leaf) -> Column:
        scalar = self._scalar(leaf.path)
        if scalar is not None:
            return self._plain(leaf, *scalar)
        operands = leaf.operand if leaf.op == "in" else (leaf.operand,)
        op = "eq" if leaf.op == "in" else leaf.op
        found = [self._any(None, self.schema, leaf.path, op, v) for v in operands]
        out = reduce(lambda a, b: a | b, found) if found else F.lit(False)
        return ~F.coalesce(out, F.lit(False)) if leaf.negated else out

    def _scalar(self, path: tuple[str, ...]) -> tuple[Column, T.DataType] | None:
        """The column of a path through structs to a scalar."""
        c, t = None, self.schema
        for name in path:
            found = next((f for f in t.fields if f.name == name), None) if isinstance(t, T.StructType) else None
            if found is None:
                return None
            c, t = column(name) if c is None else c.getField(name), found.dataType
        return None if kind_of_type(t) in ("array", "document", "other") else (c, t)

    def _plain(self, leaf: Leaf, c: Column, t: T.DataType) -> Column:
        if leaf.op == "in":
            values = [v for v in leaf.operand if v is not None and kind_of_value(v) == kind_of_type(t)]
            kept = [v for v in values if not isinstance(_compare(c, t, "eq", v), bool)]
            wide = isinstance(t, T.FloatType)
            # a null in IN would make the whole test NULL
            inside = (c.cast("double") if wide else c).isin([literal(int(v) if type(t) in _BITS else v, T.DoubleType() if wide else t) for v in kept]) if kept else None
            null = None in leaf.operand
            if leaf.negated:
                if null:
                    return c.isNotNull() & ~inside if kept else c.isNotNull()
                return c.isNull() | ~inside if kept else F.lit(True)
            if null:
                return c.isNull() | inside if kept else c.isNull()
            return inside if kept else F.lit(False)
        v = leaf.operand
        if v is None:
            hit = leaf.op == "eq"
            return (c.isNotNull() if leaf.negated else c.isNull()) if hit else F.lit(leaf.negated)
        if kind_of_value(v) != kind_of_type(t) or (isinstance(v, bool) and leaf.op != "eq"):
            return F.lit(leaf.negated)
        found = _compare(c, t, leaf.op, v)
        if isinstance(found, bool):
            # true for all values, but not for nulls, nor for NaN
            nan = F.isnan(c) if isinstance(t, (T.DoubleType, T.FloatType)) else F.lit(False)
            return (c.isNull() | nan if leaf.negated else c.isNotNull() & ~nan) if found else F.lit(leaf.negated)
        if not leaf.negated:
            return found
        if leaf.op == "eq":
            return c.isNull() | ~found
        other = ~_compare(c, t, leaf.op, v, guard=False)
        return c.isNull() | F.isnan(c) | other if isinstance(t, (T.DoubleType, T.FloatType)) else c.isNull() | other

    def _any(self, c: Column | None, t: T.DataType, path: tuple[str, ...], op: str, v: Any) -> Column:
        """Whether any candidate on the path passes. With a null operand of eq: none there, or one is null."""
        null = v is None and op == "eq"
        if v is None and not null:
            return F.lit(False)
        if not path:
            test = _candidate(op, v)
            here = c.isNull() if null else F.coalesce(test(c, t), F.lit(False))
            if isinstance(t, T.ArrayType):
                inside = F.exists(c, lambda e: e.isNull() if null else F.coalesce(test(e, t.elementType), F.lit(False)))
                here = here | F.coalesce(inside, F.lit(False))
            return here
        name, rest = path[0], path[1:]
        if isinstance(t, T.StructType):
            found = next((f for f in t.fields if f.name == name), None)
            if found is None:
                return F.lit(null)
            return self._any(column(name) if c is None else c.getField(name), found.dataType, rest, op, v)
        if isinstance(t, T.ArrayType):
            spread = self._spread(c, t, path, op, v, null)
            at = index_of(name)
            if at is None:
                return spread
            element = F.get(c, F.lit(at)) if at >= 0 else F.try_element_at(c, F.lit(at))
            inside = F.coalesce(F.size(c) > at if at >= 0 else F.size(c) >= -at, F.lit(False))
            one = self._any(element, t.elementType, rest, op, v)
            if null:
                return F.when(inside & ~F.lit(self._reaches(t.elementType, path)), one).when(inside, one | spread).otherwise(spread)
            return (inside & one) | spread
        return F.lit(null)

    def _spread(self, c: Column, t: T.ArrayType, path: tuple[str, ...], op: str, v: Any, null: bool) -> Column:
        if not self._reaches(t.elementType, path):
            return F.lit(null)
        inside = F.coalesce(F.exists(c, lambda e: self._any(e, t.elementType, path, op, v)), F.lit(False))
        return c.isNull() | (F.size(c) == 0) | inside if null else inside

    def _reaches(self, t: T.DataType, path: tuple[str, ...]) -> bool:
        """Whether a path leads anywhere from values of a type."""
        if not path:
            return True
        if isinstance(t, T.StructType):
            return any(f.name == path[0] and self._reaches(f.dataType, path[1:]) for f in t.fields)
        if isinstance(t, T.ArrayType):
            return self._reaches(t.elementType, path) or (index_of(path[0]) is not None and self._reaches(t.elementType, path[1:]))
        return False


def compile_filter(df: DataFrame, filter: Mapping | None) -> Column:
    """The condition of a filter document on the rows of ``df``."""
    return Compiler(df.schema)(parse(filter))
