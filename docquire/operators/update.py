"""Updates, replacements and deletions as plans: a DataFrame before, a DataFrame after."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidDocument, InvalidUpdateDocument
from ..plans.paths import changed, seeded
from ..plans.typed import column, compile_filter, kind_of_type, kind_of_value, literal

OPERATORS = ("$set", "$unset", "$inc")


def check_update(update: Mapping) -> None:
    """An update is a non-empty mapping of operators to non-empty mappings of paths."""
    if not isinstance(update, Mapping) or not update:
        raise InvalidUpdateDocument("an update is a mapping of operators")
    for op, fields in update.items():
        if op not in OPERATORS:
            raise InvalidUpdateDocument(f"unknown update operator {op}")
        if not isinstance(fields, Mapping) or not fields:
            raise InvalidUpdateDocument(f"{op} takes a mapping of fields")
    for op in ("$unset", "$inc"):
        if "_id" in update.get(op, ()):
            raise InvalidDocument("_id can't change")
    for path, n in update.get("$inc", {}).items():
        if isinstance(n, bool) or not isinstance(n, (int, float)):
            raise InvalidDocument(f"$inc of {path} takes a number")


def value_type(v: Any) -> T.DataType:
    """The column type of a value."""
    kind = kind_of_value(v)
    if kind == "number":
        return T.DoubleType() if isinstance(v, float) else (T.IntegerType() if -(1 << 31) <= v < 1 << 31 else T.LongType())
    if kind == "document":
        return T.StructType([T.StructField(k, value_type(x)) for k, x in v.items()])
    if kind == "array":
        kinds = {value_type(x).simpleString(): value_type(x) for x in v if x is not None}
        if len(kinds) > 1:
            raise InvalidUpdateDocument("a typed array holds one kind of value")
        return T.ArrayType(next(iter(kinds.values()), T.StringType()))
    return {"null": T.NullType(), "bool": T.BooleanType(), "string": T.StringType(), "binary": T.BinaryType(), "time": T.TimestampType()}[kind]


def value_column(v: Any, t: T.DataType) -> Column:
    """A value as a column of a type; fields that it lacks are null."""
    if v is None:
        return F.lit(None).cast(t)
    if isinstance(t, T.StructType):
        return F.struct(*[value_column(v.get(f.name), f.dataType).alias(f.name) for f in t.fields])
    if isinstance(t, T.ArrayType):
        return F.array(*[value_column(x, t.elementType) for x in v]).cast(t)
    return literal(v, t).cast(t)


_WIDTH = [T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DoubleType]


def common_type(old: T.DataType, new: T.DataType) -> T.DataType:
    """The type of a column that held ``old`` and shall hold ``new`` too."""
    if isinstance(new, T.NullType) or old == new:
        return old
    if isinstance(old, T.NullType):
        return new
    if isinstance(old, T.StructType) and isinstance(new, T.StructType):
        names = {f.name: f.dataType for f in old.fields}
        for f in new.fields:
            names[f.name] = common_type(names[f.name], f.dataType) if f.name in names else f.dataType
        return T.StructType([T.StructField(n, t) for n, t in names.items()])
    if isinstance(old, T.ArrayType) and isinstance(new, T.ArrayType):
        return T.ArrayType(common_type(old.elementType, new.elementType))
    if type(old) in _WIDTH and type(new) in _WIDTH:
        return max((old, new), key=lambda t: _WIDTH.index(type(t)))
    if kind_of_type(old) == kind_of_type(new):
        return old
    raise InvalidUpdateDocument(f"a column of {old.simpleString()} can't hold {new.simpleString()}; use a collection for fields of mixed kinds")


def _put(c: Column | None, t: T.DataType | None, path: Sequence[str], make) -> tuple[Column, T.DataType]:
    """``c`` with the value at ``path`` made anew by ``make(old column or None, old type or None)``.

    Missing parents are created; a struct is rebuilt field by field, as its type may grow.
    """
    if not path:
        return make(c, t)
    fields = {f.name: f.dataType for f in t.fields} if isinstance(t, T.StructType) else {}
    if t is not None and not isinstance(t, (T.StructType, T.NullType)):
        raise InvalidUpdateDocument(f"{path[0]} stands below a {t.simpleString()}; use a collection to replace it by a document")
    old = c.getField(path[0]) if path[0] in fields else None
    new, kind = _put(old, fields.get(path[0]), path[1:], make)
    parts = {n: (c.getField(n), d) for n, d in fields.items()} | {path[0]: (new, kind)}
    return F.struct(*[x.alias(n) for n, (x, _) in parts.items()]), T.StructType([T.StructField(n, d) for n, (_, d) in parts.items()])


def _setter(v: Any):
    def make(c: Column | None, t: T.DataType | None):
        kind = common_type(t, value_type(v)) if t is not None else value_type(v)
        return value_column(v, kind), kind

    return make


def _adder(path: str, n: int | float):
    def make(c: Column | None, t: T.DataType | None):
        if c is None:
            return value_column(n, value_type(n)), value_type(n)
        if kind_of_type(t) != "number":
            raise InvalidDocument(f"$inc of {path} needs a number")
        # a whole number stays in its type, where it overflows with an error, as everywhere in ANSI mode
        kind = common_type(t, T.DoubleType()) if isinstance(n, float) else t
        return (F.coalesce(c.cast(kind), F.lit(0).cast(kind)) + F.lit(n).cast(kind)).cast(kind), kind

    return make


def _remover(c: Column | None, t: T.DataType | None):
    return F.lit(None).cast(t if t is not None else T.NullType()), t if t is not None else T.NullType()


def _exists(t: T.DataType, path: Sequence[str]) -> bool:
    return not path or (isinstance(t, T.StructType) and any(f.name == path[0] and _exists(f.dataType, path[1:]) for f in t.fields))


def updated(df: DataFrame, update: Mapping) -> dict[str, tuple[Column, T.DataType]]:
    """The changed top-level columns of every row, as if all matched: $set, then $unset, then $inc."""
    check_update(update)
    columns = {f.name: (column(f.name), f.dataType) for f in df.schema.fields}
    changed: dict[str, tuple[Column, T.DataType]] = {}
    steps = [(p, _setter(v)) for p, v in update.get("$set", {}).items()]
    steps += [(p, _remover) for p in update.get("$unset", {}) if _exists(df.schema, p.split("."))]
    steps += [(p, _adder(p, n)) for p, n in update.get("$inc", {}).items()]
    for path, make in steps:
        top, *rest = path.split(".")
        c, t = changed.get(top) or columns.get(top) or (None, None)
        changed[top] = _put(c, t, rest, make)
    return changed


@dataclass(frozen=True)
class Change:
    """A change to the rows of ``source`` that pass ``filter``: all of them, or the first in ``seq`` order."""

    source: DataFrame
    seq: tuple[str, ...]
    filter: Mapping | None
    first: bool = False

    def _condition(self) -> Column:
        """True for those rows, and false or null for others: as it stands, scans can push it down."""
        if not self.first:
            return compile_filter(self.source, self.filter)
        # the first one is found by a scalar subquery, one partial minimum per task
        place = F.struct(*[column(s) for s in self.seq]) if len(self.seq) > 1 else column(self.seq[0])
        least = self.source.filter(compile_filter(self.source, self.filter)).agg(F.min(place).alias("least")).scalar()
        return place == least

    def matched(self) -> Column:
        """Whether a row is one of those, for projections."""
        return F.coalesce(self._condition(), F.lit(False))

    def rows(self) -> DataFrame:
        """Those rows. Of several, the first also passes the filter itself, so that it reaches the scan as well."""
        found = self.source.filter(compile_filter(self.source, self.filter)) if self.first else self.source
        return found.filter(self._condition())

    def update(self, update: Mapping) -> DataFrame:
        """All rows after the update."""
        new, hit = updated(self.source, update), self.matched()
        out = [F.when(hit, new[f.name][0]).otherwise(_cast(column(f.name), f.dataType, new[f.name][1])).alias(f.name) if f.name in new else column(f.name) for f in self.source.schema.fields]
        out += [F.when(hit, c).otherwise(F.lit(None).cast(t)).alias(n) for n, (c, t) in new.items() if n not in self.source.columns]
        return self.source.select(*out)

    def result(self, update: Mapping) -> DataFrame:
        """One row: ``matched_count, modified_count``. A row that the update leaves as it is isn't modified."""
        new = updated(self.source, update)
        old = {f.name: f.dataType for f in self.source.schema.fields}
        differs = F.lit(False)
        for name, (c, t) in new.items():
            differs = differs | (~c.eqNullSafe(_cast(column(name), old[name], t)) if name in old else c.isNotNull())
        rows = self.rows().select(differs.alias("differs"))
        return rows.agg(F.count(F.lit(1)).alias("matched_count"), F.count(F.when(F.col("differs"), 1)).alias("modified_count"))

    def upsert(self, update: Mapping) -> DataFrame:
        """All rows after the update, and the seeded one if none matches."""
        after = self.update(update)
        return after.unionByName(self._absent(after, changed(seeded(self.filter), update)))

    def _absent(self, after: DataFrame, doc: Mapping) -> DataFrame:
        spark = self.source.sparkSession
        n = self.source.filter(compile_filter(self.source, self.filter)).agg(F.count(F.lit(1)).alias("n")).scalar()
        row = spark.range(1).filter(n == 0)
        return row.select(*[value_column(doc.get(f.name), f.dataType).alias(f.name) for f in after.schema.fields])

    def replace(self, replacement: Mapping, id_col: str = "_id") -> DataFrame:
        """All rows after the first match is replaced; what the replacement lacks is null, the id stays."""
        check_replacement(replacement)
        hit = self.matched()
        out = []
        for f in self.source.schema.fields:
            if f.name == id_col:
                out.append(column(f.name))
                continue
            kind = common_type(f.dataType, value_type(replacement.get(f.name)))
            out.append(F.when(hit, value_column(replacement.get(f.name), kind)).otherwise(_cast(column(f.name), f.dataType, kind)).alias(f.name))
        return self.source.select(*out)

    def delete(self) -> DataFrame:
        """The rows that stay."""
        return self.source.filter(~self.matched())

    def images(self, after: DataFrame | None = None) -> DataFrame:
        """The matching rows as they are before the change; with ``after``, the same rows in it."""
        before = self.rows()
        if after is None:
            return before
        return after.join(before.select(*self.seq), list(self.seq), "left_semi").select(*[column(n) for n in after.columns])


def _cast(c: Column, old: T.DataType, new: T.DataType) -> Column:
    """A column in a type that has grown."""
    if old == new:
        return c
    if isinstance(old, T.StructType) and isinstance(new, T.StructType):
        names = {f.name: f.dataType for f in old.fields}
        parts = [(_cast(c.getField(f.name), names[f.name], f.dataType) if f.name in names else F.lit(None).cast(f.dataType)).alias(f.name) for f in new.fields]
        return F.when(c.isNotNull(), F.struct(*parts))
    return c.cast(new)


def check_replacement(replacement: Mapping) -> None:
    if not isinstance(replacement, Mapping) or any(isinstance(k, str) and k.startswith("$") for k in replacement):
        raise InvalidDocument("a replacement is a document without operators")
