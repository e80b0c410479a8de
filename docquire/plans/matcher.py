"""Match single documents (dictionaries) exactly, for data without a schema."""

from __future__ import annotations

import datetime as dt
import operator
from collections.abc import Iterator, Mapping
from typing import Any

from .filters import All, Leaf, index_of

_ORDER = {"gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}


def candidates(value: Any, path: tuple[str, ...]) -> Iterator[Any]:
    """Every value that a path leads to."""
    if not path:
        yield value
        if isinstance(value, list):
            yield from value
    elif isinstance(value, Mapping):
        if path[0] in value:
            yield from candidates(value[path[0]], path[1:])
    elif isinstance(value, list):
        at = index_of(path[0])
        if at is not None and -len(value) <= at < len(value):
            yield from candidates(value[at], path[1:])
        for element in value:
            if isinstance(element, (Mapping, list)):
                yield from candidates(element, path)


def equal(a: Any, b: Any) -> bool:
    """Equality of values: a boolean is no number; lists are compared as lists."""
    if isinstance(a, bool) != isinstance(b, bool):
        return False
    if isinstance(b, tuple):
        b = list(b)
    return a == b


def _naive(v: Any) -> Any:
    """Stored times are naive UTC; an aware operand means the same moment."""
    if isinstance(v, dt.datetime) and v.tzinfo is not None:
        return v.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return v


def _ordered(op: str, a: Any, b: Any) -> bool:
    if isinstance(a, bool) or isinstance(b, bool):
        return False
    try:
        return bool(_ORDER[op](a, b))
    except TypeError:
        return False


def matches(document: Mapping, node) -> bool:
    """Whether a document passes a parsed filter."""
    if not isinstance(node, Leaf):
        test = all if isinstance(node, All) else any
        return test(matches(document, p) for p in node.parts)
    found = list(candidates(document, node.path))
    if node.op in _ORDER:
        operand = list(node.operand) if isinstance(node.operand, tuple) else _naive(node.operand)
        hit = any(_ordered(node.op, c, operand) for c in found)
    else:
        operands = node.operand if node.op == "in" else (node.operand,)
        hit = any((v is None and not found) or any(equal(c, _naive(v)) for c in found) for v in operands)
    return hit != node.negated
