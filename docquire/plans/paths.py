"""Documents rebuilt along a path. Nothing is changed in place; what lies beside the path is shared with the old document."""

from __future__ import annotations

import copy
import enum
import functools
from collections.abc import Callable, Mapping
from typing import Any

from ..errors import InvalidDocument
from .filters import All, Leaf, parse


class Absent(enum.Enum):
    """What a path that leads nowhere leads to; one and the same in every process."""

    MISSING = "missing"


MISSING = Absent.MISSING


def at(doc: Any, path: str) -> Any:
    """The value at a path through documents, or MISSING."""
    return functools.reduce(lambda d, name: d.get(name, MISSING) if isinstance(d, Mapping) else MISSING, path.split("."), doc)


def rebuilt(doc: Mapping, path: str, make: Callable[[Any], Any]) -> dict:
    """The document with ``make(old)`` at a path: MISSING is what an absent value gives, and what removes one.

    What stands in the way of a new value becomes a document; a removal leaves it alone.
    """
    name, _, rest = path.partition(".")
    old = doc.get(name, MISSING)
    if not rest:
        new = make(old)
    elif isinstance(old, Mapping):
        new = rebuilt(old, rest, make)
    else:
        new = rebuilt({}, rest, make) or old  # nothing was made
    if new is MISSING:
        return {k: v for k, v in doc.items() if k != name}
    return {**doc, name: new}


def _sum(path: str, n: int | float) -> Callable[[Any], Any]:
    def make(old: Any) -> Any:
        if old is MISSING:
            return n
        if isinstance(old, bool) or not isinstance(old, (int, float)):
            raise InvalidDocument(f"$inc of {path} needs a number")
        return old + n

    return make


#: What each operator makes of the value at a path, in the order in which they take effect.
MAKERS: dict[str, Callable[[str, Any], Callable[[Any], Any]]] = {
    "$set": lambda path, v: lambda old: copy.deepcopy(v),
    "$unset": lambda path, _: lambda old: MISSING,
    "$inc": _sum,
}


def changed(doc: Mapping, update: Mapping) -> dict:
    """The document after an update."""
    new = functools.reduce(lambda d, step: rebuilt(d, step[0], step[1]), ((path, maker(path, v)) for op, maker in MAKERS.items() for path, v in update.get(op, {}).items()), doc)
    if "_id" in doc and not same(doc["_id"], new.get("_id", MISSING)):
        raise InvalidDocument("_id can't change")
    return dict(new)


def same(a: Any, b: Any) -> bool:
    """Equality in which a boolean is no number."""
    return a == b and isinstance(a, bool) == isinstance(b, bool)


def seeded(filter: Mapping | None) -> dict:
    """The document that an upsert starts from: the equalities that the filter asks of all documents, but for literal documents."""
    doc: dict = {}
    for key, condition in (filter or {}).items():
        node = parse({key: condition})
        if key.startswith("$") or isinstance(node, All) or not isinstance(node, Leaf) or node.op != "eq" or node.negated:
            continue
        if isinstance(condition, Mapping) and set(condition) != {"$eq"}:
            continue
        doc = rebuilt(doc, key, lambda old, v=node.operand: copy.deepcopy(v))
    return doc
