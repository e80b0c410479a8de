"""Find: filter, sort, skip, limit, project, as one lazy plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.typed import column, compile_filter

SortSpec = tuple[tuple[str, bool], ...]


def sort_spec(key: Any, direction: int | None = None) -> SortSpec:
    """(name, descending) pairs from a name, a mapping, or a sequence of names or (name, direction)."""
    if isinstance(key, str):
        return ((key, (direction or 1) < 0),)
    if isinstance(key, Mapping):
        key = list(key.items())
    if not isinstance(key, Sequence):
        raise TypeError("sort takes a name, a mapping or a sequence")
    out = []
    for part in key:
        if isinstance(part, str):
            out.append((part, (direction or 1) < 0))
        elif isinstance(part, Sequence) and len(part) == 2 and isinstance(part[0], str):
            out.append((part[0], part[1] < 0))
        else:
            raise ValueError("sort entries are names or (name, direction)")
    return tuple(out)


@dataclass(frozen=True)
class Projection:
    """Which top-level fields to return. Neither including nor excluding any means all."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    with_id: bool = True

    @classmethod
    def of(cls, spec: Mapping | Sequence | None) -> Projection:
        if not spec:
            return cls()
        if not isinstance(spec, Mapping):
            spec = dict.fromkeys(spec, 1)
        include = tuple(k for k, v in spec.items() if v and k != "_id")
        exclude = tuple(k for k, v in spec.items() if not v and k != "_id")
        if include and exclude:
            raise ValueError("a projection includes or excludes, not both")
        return cls(include, exclude, bool(spec.get("_id", True)))

    def fields(self, names: Sequence[str]) -> list[str]:
        """The names that remain of ``names``, in the order of the result."""
        if self.include:
            out = [n for n in self.include if n in names]
            return out + ["_id"] * (self.with_id and "_id" in names and "_id" not in out)
        return [n for n in names if n not in self.exclude and (n != "_id" or self.with_id)]

    def document(self, doc: Mapping) -> dict:
        return {k: doc[k] for k in self.fields(list(doc))}


def nulls_placed(c: Column, descending: bool) -> Column:
    """Nulls come last ascending and first descending."""
    return c.desc_nulls_first() if descending else c.asc_nulls_last()


@dataclass(frozen=True)
class Find:
    """An immutable query on a typed DataFrame; ``frame()`` is its plan.

    ``seq`` names the columns that give insertion order; ties of a sort keep it.
    """

    source: DataFrame
    seq: tuple[str, ...]
    filter: Mapping | None = None
    order: SortSpec = ()
    skipped: int = 0
    limited: int = 0
    shown: Projection = field(default_factory=Projection)

    def where(self, filter: Mapping | None) -> Find:
        return replace(self, filter=filter)

    def sort(self, key: Any, direction: int | None = None) -> Find:
        return replace(self, order=sort_spec(key, direction))

    def skip(self, n: int) -> Find:
        if n < 0:
            raise ValueError("skip is not negative")
        return replace(self, skipped=n)

    def limit(self, n: int) -> Find:
        """At most n rows; 0 is no limit."""
        if n < 0:
            raise ValueError("limit is not negative")
        return replace(self, limited=n)

    def project(self, spec: Mapping | Sequence | None) -> Find:
        return replace(self, shown=Projection.of(spec))

    def __getitem__(self, at: int | slice) -> Find:
        """A slice replaces skip and limit; an empty one is empty."""
        if isinstance(at, slice):
            start, stop = at.start or 0, at.stop
            if start < 0 or (stop is not None and stop < 0):
                raise IndexError("slices are not negative")
            if stop is None:
                return replace(self, skipped=start)
            if stop <= start:
                return replace(self, filter={"$or": []})
            return replace(self, skipped=start, limited=stop - start)
        if at < 0:
            raise IndexError("indexes are not negative")
        return replace(self, skipped=at, limited=1)

    def rows(self) -> DataFrame:
        """The plan without its projection."""
        df = self.source
        if self.filter:
            df = df.filter(compile_filter(df, self.filter))
        if self.order or self.skipped or self.limited:
            keys = [nulls_placed(column(n), down) for n, down in self.order if n in df.columns]
            df = df.orderBy(*keys, *[column(s).asc() for s in self.seq])
        if self.skipped:
            df = df.offset(self.skipped)
        if self.limited:
            df = df.limit(self.limited)
        return df

    def frame(self) -> DataFrame:
        return self.rows().select(*[column(n) for n in self.shown.fields(self.source.columns)])

    def one(self) -> Find:
        return replace(self, limited=1)

    def count(self) -> DataFrame:
        """One row ``n``; skip, limit and sort don't count."""
        df = self.source
        if self.filter:
            df = df.filter(compile_filter(df, self.filter))
        return df.agg(F.count(F.lit(1)).alias("n"))
