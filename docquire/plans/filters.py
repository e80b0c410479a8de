"""Filter documents to a tree in negation-normal form.

Negations are pushed to the leaves while parsing, so that a compiler can emit, for each negated leaf, a form that
is true for nulls and that the scan can still push down.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from ..errors import InvalidDocument

COMPARISONS = {"$eq": "eq", "$gt": "gt", "$gte": "gte", "$lt": "lt", "$lte": "lte"}


@dataclass(frozen=True)
class All:
    """Conjunction; empty is true."""

    parts: tuple


@dataclass(frozen=True)
class Any_:
    """Disjunction; empty is false."""

    parts: tuple


@dataclass(frozen=True)
class Leaf:
    """One operator on one path: eq, gt, gte, lt, lte or in, perhaps negated."""

    path: tuple[str, ...]
    op: str
    operand: Any
    negated: bool = False


def is_operators(condition: Any) -> bool:
    """Whether a condition consists of operators; an empty or mixed mapping is a literal document."""
    return isinstance(condition, Mapping) and bool(condition) and all(isinstance(k, str) and k.startswith("$") for k in condition)


def parse(filter: Mapping | None, negated: bool = False):
    """The tree of a whole filter; every part is checked, whatever the documents hold."""
    if filter is None:
        return All(())
    if not isinstance(filter, Mapping):
        raise InvalidDocument(f"a filter is a mapping, not {type(filter).__name__}")
    parts = []
    for key, value in filter.items():
        if not isinstance(key, str):
            raise InvalidDocument("filter keys are strings")
        if key in ("$and", "$or"):
            if not isinstance(value, (list, tuple)):
                raise InvalidDocument(f"{key} takes a list")
            inner = tuple(parse(v, negated) for v in value)
            parts.append((All if (key == "$and") != negated else Any_)(inner))
        elif key.startswith("$"):
            raise InvalidDocument(f"unknown operator {key}")
        else:
            parts.append(_condition(tuple(key.split(".")), value, negated))
    if len(parts) == 1:
        return parts[0]
    return (Any_ if negated else All)(tuple(parts))


def _condition(path: tuple[str, ...], condition: Any, negated: bool):
    if not is_operators(condition):
        return Leaf(path, "eq", condition, negated)
    parts = []
    for op, operand in condition.items():
        if op in COMPARISONS:
            parts.append(Leaf(path, COMPARISONS[op], operand, negated))
        elif op == "$ne":
            parts.append(Leaf(path, "eq", operand, not negated))
        elif op in ("$in", "$nin"):
            if not isinstance(operand, (list, tuple)):
                raise InvalidDocument(f"{op} takes a list")
            parts.append(Leaf(path, "in", tuple(operand), negated != (op == "$nin")))
        elif op == "$not":
            parts.append(_condition(path, operand, not negated))
        else:
            raise InvalidDocument(f"unknown operator {op}")
    if len(parts) == 1:
        return parts[0]
    return (Any_ if negated else All)(tuple(parts))


def index_of(segment: str) -> int | None:
    """The list index that a path segment means, if any."""
    digits = segment[1:] if segment.startswith("-") else segment
    return int(segment) if digits.isascii() and digits.isdigit() else None
